"""What several operators of this folder use: words, tables in the shared folder, splitters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, 0x20 and 0x09 to 0x0D. bytes.split() splits at the same ones.
BLANKS = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset and all runs in one process, as in tests, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="shared-"))


def _found(spark: SparkSession, path: str) -> tuple:
    """The path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """df as a table in the shared folder: it is computed once and outlives the loss of executors. It goes with forget(), or else when the application ends."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _found(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written(), and those that a result was made of, that no later plan reads."""
    for df in tables:
        forget(*getattr(df, "_made_of", ()))
        path = getattr(df, "_written_at", None)
        if path is None:
            continue
        at, fs = _found(df.sparkSession, path)
        fs.delete(at, True)


#: What workers keep from task to task, by operator.
kept_caches: dict[str, dict] = {}
_running = [""]


def _enter(name: str) -> None:
    if _running[0] != name:
        for other, cache in kept_caches.items():
            if other != name:
                cache.clear()
        _running[0] = name


def _leave() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(name: str, run: Callable) -> Callable:
    """run for mapInArrow, with memory given back: a worker first drops what other operators kept, and at the end what the allocators hold free."""

    def wrapped(batches):
        _enter(name)
        try:
            yield from run(batches)
        finally:
            _leave()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of the words of text, without Python; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def below(keys: Sequence[str], splitter: Sequence) -> Column:
    """(keys) < (splitter), compared as tuples."""
    out = F.lit(False)
    for name, value in reversed(list(zip(keys, splitter, strict=True))):
        out = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def range_of(keys: Sequence[str], splitters: Sequence[Sequence], first: int = 0) -> Column:
    """Number of sorted splitters at or below the keys, by a balanced tree of comparisons."""
    if not splitters:
        return F.lit(first)
    mid = len(splitters) // 2
    left = range_of(keys, splitters[:mid], first)
    right = range_of(keys, splitters[mid + 1 :], first + mid + 1)
    return F.when(below(keys, splitters[mid]), left).otherwise(right)


def quantile_splitters(sample: Sequence[Sequence], ranges: int) -> list[tuple]:
    """At most ranges - 1 distinct values that cut the sorted sample into equal parts."""
    got = sorted(map(tuple, sample))
    if not got:
        return []
    cuts = {got[min(len(got) - 1, len(got) * k // ranges)] for k in range(1, ranges)}
    return sorted(cuts)
