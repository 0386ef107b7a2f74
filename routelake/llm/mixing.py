"""Mixing sources to target weights by systematic sampling.

Sources in code point order, null last, weigh 5, 2, 1 in turn and share the whole size by weight. A target stops at LIMIT times its
source's size; the excess is shared again by weight until no target is above. That is a water level: the sources are sorted by size
per weight, and the level is where the limits of those below it and the shares of the rest make up the whole.

Within a source every document is expected target / size times. The documents are lined up by falling size, their expected copies
are summed along the line, one random offset of the source is added, and a document is emitted once for each integer boundary that
its stretch crosses. As neighbours are alike in size, a source's taken words miss its target by about its largest document at most.

The prefix sums are two-level: documents fall in lots of a source, a size class and a salt, counts of lots are combined before the
shuffle, and only the rank within a lot is a window over rows. So a source with a third of all rows is spread over many tasks.

Defined cases: a null or empty text has size 0 and is emitted like the others of its source, adding no words; a source without any
words has target 0 and emits nothing; a null source is a source; repeated rows are drawn each by itself, in any order among
themselves; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.llm.shared import word_count, written

#: Weights of the sources in turn, and how often a document may be taken.
WEIGHTS, LIMIT = (5.0, 2.0, 1.0), 3
SEED = 17
#: Documents of one size class of a source are spread over so many salts; the prefix sums stay exact.
SALTS = 16


def targets(sources: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sources (source, source_size long, n_docs) with weight and target; one row a source, so these windows are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    out = sources.withColumn("weight", weight).withColumn("ratio", limit * F.col("source_size") / F.col("weight"))
    out = out.withColumn("total", F.sum("source_size").over(whole))
    # The level if all before this source are at their limit and it and the rest share what is left.
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum(limit * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after))
    out = out.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    return out.withColumn("target", F.least(limit * F.col("source_size").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)))).drop("ratio", "total", "level")


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, limit: int = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) and the columns named in keep, of each row of docs (doc_id, source, text)."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("tie"), *[F.struct(*keep).alias("kept")] * bool(keep))
    sized = sized.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 16).cast("int")).withColumn("salt", F.pmod(F.col("tie"), F.lit(SALTS)).cast("int"))
    if not keep:
        sized = written(sized)
    lots = sized.groupBy("source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    line = Window.partitionBy("source").orderBy(F.desc("class"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    lots = written(lots.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))))
    planned = targets(lots.groupBy("source").agg(F.sum("words").alias("source_size")), weights, limit)
    # At most sources x classes (16 for each doubling of the size) x SALTS rows.
    plan = lots.alias("l").join(planned.alias("p"), F.expr("l.source <=> p.source")).select(F.col("l.source").alias("p_source"), F.col("class").alias("p_class"), F.col("salt").alias("p_salt"), "before", "source_size", "target")
    own = Window.partitionBy("source", "class", "salt").orderBy(F.desc("size"), "tie", "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # The offset is a multiple of 1/1024, so that whole rates give whole copies in floating point too.
    offset = (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1023)) + 1) / 1024
    ranked = sized.withColumn("rank", F.row_number().over(own))
    ranked = ranked.join(plan, F.expr("source <=> p_source AND class = p_class AND salt = p_salt"))
    place = F.col("before") + F.col("rank")
    ranked = ranked.withColumn("rate", rate)
    copies = F.floor(F.col("rate") * place + offset) - F.floor(F.col("rate") * (place - 1) + offset)
    out = ranked.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", *["kept"] * bool(keep))
