"""URL filters: allow and block rules (host, path prefix) applied by a sorted sweep of range intervals.

A key is the host with its labels reversed, a zero character, and the path. A rule's prefix is an interval of keys. A url probes once
for each suffix of its host, as a rule also fits subdomains. Rules and probes fall into ranges of keys by splitters from a sample of
both, are sorted there, and swept: each rule carries the stack of rules whose intervals hold it, innermost last; the stack of the
latest rule at or below a probe holds every rule whose interval holds the probe. Of those that truly fit, the longest decides:
most characters of host and path, then the longer host, then block before allow.

The splitters take the row's own hash as a second key, so one very common url is still dealt over several ranges; rules are copied
into each range that their interval meets.

Defined cases: host and path of a null url, or one without `://`, are empty, and no rule fits; without a rule the verdict is
`allow`; a rule with an empty host never fits; repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.llm.shared import partitions, quantile_splitters, range_of, written

#: The rules of the query (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
OTHERWISE = "allow"
#: Sampled keys a range on average, and most ranges, whatever the input.
SAMPLED, MOST_RANGES = 32, 256
#: Characters of a key that splitters hold.
START = 256


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("\0"), path)


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules as a table; longer ones come from a file."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def stacked(rules: DataFrame) -> DataFrame:
    """(key, stack): for each distinct rule key, the rules whose key is a prefix of it. A key has as many prefixes as characters."""
    known = rules.where("host != ''").select(key_of(F.col("host"), F.col("path")).alias("key"), F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), F.col("verdict").alias("verdict"), F.col("host").alias("host"), F.col("path").alias("path")).alias("rule"))
    inner = known.select("key").distinct()
    prefixes = inner.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("key", F.expr("left(key, n)").alias("prefix"))
    outer = known.withColumnRenamed("key", "prefix")
    return prefixes.join(outer, "prefix").groupBy("key").agg(F.array_sort(F.collect_set("rule")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = OTHERWISE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages (page_id, url); rules has (verdict, host, path)."""
    spark = pages.sparkSession
    url = F.col("url").cast("string")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    seen = written(seen)
    labels = F.split("host", "\\.")
    suffix = F.array_join(F.slice(labels, F.col("k"), F.size(labels)), ".")
    probes = seen.select("page_id", "host", "path", "copies", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: k)).alias("nth", "k"))
    probes = probes.withColumn("suffix", suffix).withColumn("key", key_of(F.col("suffix"), F.col("path"))).withColumn("tie", F.xxhash64("page_id", "host", "path")).drop("k")
    ranges = max(1, min(MOST_RANGES, 2 * partitions(spark)))
    n = seen.count()
    drawn = F.pmod(F.xxhash64(F.lit(5), "tie"), F.lit(1 << 40)) / float(1 << 40) < F.lit(SAMPLED * ranges / max(1, 3 * n))
    # Ranges go by the first characters of a key, then by the row's hash, so that urls with a longer common start are dealt over several.
    probes = probes.withColumn("start", F.substring("key", 1, START))
    splitters = quantile_splitters(probes.where(drawn).select("start", "tie").limit(8 * SAMPLED * ranges).collect(), ranges)
    probes = probes.withColumn("range", range_of(("start", "tie"), splitters).cast("int"))
    # A rule's stack answers for keys from its own up to the next rule's, so it goes to all ranges between, both included.
    steps = stacked(rules).withColumn("start", F.substring("key", 1, START))
    for name, tie in (("from", -(1 << 63)), ("upto", (1 << 63) - 1)):
        steps = steps.withColumn("tie", F.lit(tie)).withColumn(name, range_of(("start", "tie"), splitters).cast("int"))
    following = Window.orderBy("key")  # over the rules alone
    steps = steps.withColumn("to", F.coalesce(F.lead("upto").over(following), F.lit(len(splitters))))
    steps = steps.select(F.explode(F.sequence("from", "to")).alias("range"), "key", "stack")
    row = F.struct("page_id", "host", "path", "copies", "nth", "suffix").alias("row")
    events = steps.select("range", "key", F.lit(0).alias("kind"), "stack", F.lit(None).cast(probes.select(row).schema[0].dataType).alias("row"))
    events = events.unionByName(probes.select("range", "key", F.lit(1).alias("kind"), F.lit(None).cast(steps.schema["stack"].dataType).alias("stack"), row))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").select("row.*", "active")
    fit = F.filter("active", lambda r: (r["host"] == F.col("suffix")) & F.startswith(F.col("path"), r["path"]))
    best = swept.select("page_id", "host", "path", "copies", F.array_max(F.transform(fit, lambda r: F.struct(r["length"].alias("length"), r["host_length"].alias("host_length"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule")))).alias("best"))
    best = best.groupBy("page_id", "host", "path", "copies").agg(F.max("best").alias("best"))
    out = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")
