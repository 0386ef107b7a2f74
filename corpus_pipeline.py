"""The training-data pipeline: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
documents. What happens in each case is told in the operators' modules; here, besides: a document that loses words keeps the rest,
joined by spaces, even if nothing is left, and n_chars follows; mixing repeats a document's row once for each copy drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelake.llm import mixing, packing, queries, shared, simhash, substrings, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = substrings.without_repeats(docs, keep=others, untouched=True)
    columns = {c: F.col(f"kept.{c}") for c in others} | {"text": F.col("text"), "n_chars": F.length("text")}
    return cut.select(*[columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, keep=tuple(docs.columns)).where("copies > 0")
    return mixed.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("kept.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Fingerprints, tokens and trained scores have no SQL form: tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
