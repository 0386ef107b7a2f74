"""Sharding into a fixed number of shards of nearly equal bytes, by sampled splitters.

Records are in order of (text hash, hash of doc_id, doc_id), so equal texts are neighbours. A sample whose rate grows with a record's
size gives quantile boundaries; records are range-partitioned by them with a tree of comparisons. The true bytes of each range are
then counted, and ranges above twice the mean are subdivided by a second hash into as many lanes as they are too large. So a text
with a third of all rows is cut like anything else. Prefix sums of the ranges' bytes and rows give each record its exact place in
the whole order without a global sort; the place decides the shard and the slot.

The law is `bytes`: a record goes to the shard in whose stretch of the total bytes its middle lies. Equal texts stand together in the
order, and a group of them of at most WHOLE of a shard's mean bytes goes by the group's middle, so it stays in one shard; larger
groups are cut where shards meet. The rule is the same share at every size. A shard's bytes are so within its largest record and WHOLE of the mean.

Defined cases: a null text has no bytes, so size 8, and is a group like any other text; repeated rows get a slot each; an empty
table gives no rows; other columns are ignored. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.llm.shared import partitions, quantile_splitters, range_of, written

SHARDS, OVERHEAD, SEED = 24, 8, 29
#: Sampled records a range on average, and most ranges: the sample and the splitters on the driver have at most so many rows, whatever the input.
SAMPLED, MOST_RANGES = 48, 512
#: Groups of equal texts up to this share of a shard's mean bytes are kept together.
WHOLE = 0.02


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text, text.isNull()).alias("h"), F.xxhash64(F.lit(seed), "doc_id").alias("t"))
    keyed = written(keyed)
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(1, min(MOST_RANGES, max(partitions(spark) * 4, shards), rows))
    # Kept with a chance in proportion to its size; the hash of the row stands for the random number, so that reruns agree.
    chance = F.col("size") * (SAMPLED * ranges / max(total, 1))
    drawn = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "h"), F.lit(1 << 40)) / float(1 << 40) < chance
    splitters = quantile_splitters(keyed.where(drawn).select("h", "t").limit(8 * SAMPLED * ranges).collect(), ranges)
    ranged = keyed.withColumn("range", range_of(("h", "t"), splitters).cast("int"))
    over = 2.0 * total / max(ranges, 1)
    lanes = ranged.groupBy("range").agg(F.sum("size").alias("b")).where(F.col("b") > over).select("range", F.ceil(F.col("b") / F.lit(over / 2)).cast("int").alias("lanes"))
    ranged = ranged.join(F.broadcast(lanes), "range", "left")  # at most MOST_RANGES rows
    ranged = written(ranged.withColumn("lane", F.when(F.col("lanes").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("lanes")).cast("int"))).drop("lanes"))
    counted = ranged.groupBy("range", "lane").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    line = Window.orderBy("range", "lane").rowsBetween(Window.unboundedPreceding, -1)  # over MOST_RANGES rows and their lanes
    counted = counted.select("range", "lane", F.coalesce(F.sum("b").over(line), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("rows_before"))
    own = Window.partitionBy("range", "lane").orderBy("h", "t", "doc_id")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "lane").orderBy("h").rangeBetween(Window.currentRow, Window.currentRow)
    placed = ranged.join(F.broadcast(counted), ["range", "lane"])
    placed = placed.withColumn("start", F.col("bytes_before") + F.sum("size").over(so_far) - F.col("size")).withColumn("row", F.col("rows_before") + F.row_number().over(own) - 1)
    placed = placed.withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_start", F.min("start").over(group))
    whole = F.col("group_bytes") <= F.lit(WHOLE * total / shards)
    middle = F.when(whole, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("start") + F.col("size") / 2)
    placed = written(placed.select("doc_id", "size", "text_crc32", "row", F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard")))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")  # a row for each shard
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
