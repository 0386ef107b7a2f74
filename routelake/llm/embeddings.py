"""Embedding near-duplicates by lattice hashing: E8 cells of random projections, neighbouring cells probed, cosines verified.

Each of TABLES tables projects the unit vectors on PARTS times 8 random directions and decodes each 8 numbers to the nearest point of
the lattice E8; the points together name a cell. A vector lives in its own cell and visits the PROBES cells one lattice step away
that lie nearest. Within a cell every resident is compared with every other resident and visitor, in blocks, by cosine in double
precision; no link is reported below the bound. A pair that meets in several cells is counted in the first alone, which both vectors
tell by themselves, so no pairs travel. A cell gives each vector its number of links and the least vector that it reaches.

Visits carry ids alone; vectors follow only into cells where a resident has company. Equal vectors are one class with a multiplicity, so copies cost one row. Cells with more than BLOCK members are dealt over pairs of
blocks. Recall at the bound itself is about 0.95 and rises quickly above it; nothing is sampled or capped.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
length never link; repeated rows are vectors of their own, which link with each other; an empty table gives no rows; other columns
are ignored; a null vec_id is the largest of its component.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.components import components
from routelake.llm.shared import partitions, tidy, written
from routelake.llm.simhash import forest

COSINE, TABLES, PARTS, PROBES, SCALE, SEED = 0.9, 6, 2, 6, 0.28, 11
BLOCK = 2048


@functools.cache
def roots() -> np.ndarray:
    """The 240 lattice points of E8 nearest to the origin: two entries of one, or all of a half with an even number of minuses."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: where the sum is odd, the entry farthest from its integer goes to the other side."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the even integer points and the same moved by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """The tables for vectors of one length."""

    def __init__(self, length: int, tables: int, parts: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, length])
        self.parts, self.probes, self.scale = parts, probes, scale
        wide = max(length, 8 * parts)
        self.maps = [np.linalg.qr(rng.normal(size=(wide, 8 * parts)))[0][:length] * (length / 64) ** 0.5 for _ in range(tables)]
        self.moves = rng.uniform(-1, 1, (tables, 8 * parts))
        self.odd = rng.integers(1, 2**62, (tables, 8 * parts), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cells of each unit vector: (vectors, tables, 1 + probes); its own comes first."""
        out = np.empty((len(unit), len(self.maps), 1 + self.probes), np.int64)
        for t, m in enumerate(self.maps):
            y = unit @ m / self.scale + self.moves[t]
            gain, change, code = [], [], np.zeros(len(unit), np.uint64)
            for p in range(self.parts):
                part = slice(8 * p, 8 * p + 8)
                point = nearest_e8(y[:, part])
                keys = self.odd[t, part]
                # A cell's name is a sum over the doubled coordinates, so a step changes it by the step's own sum.
                code += ((2 * point).astype(np.int64).astype(np.uint64) * keys).sum(1, dtype=np.uint64)
                gain.append((y[:, part] - point) @ roots().T)
                change.append(((2 * roots()).astype(np.int64).astype(np.uint64) * keys).sum(1, dtype=np.uint64))
            gain, change = np.concatenate(gain, 1), np.concatenate(change)
            best = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
            named = np.concatenate([code[:, None], code[:, None] + change[best]], 1) + np.uint64(t)
            named = (named ^ (named >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, t] = (named ^ (named >> np.uint64(32))).view(np.int64)
        return out


@functools.cache
def lattice(*args) -> Lattice:
    return Lattice(*args)


def unit_rows(blobs: list, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def meets_first(cells: np.ndarray, a: np.ndarray, b: np.ndarray, here: int) -> np.ndarray:
    """Whether the pairs (a, b) of rows, a before b, count in the cell `here`: it is where they first meet."""
    found = np.zeros(len(a), np.int64)
    open_ = np.ones(len(a), bool)
    for t in range(cells.shape[1]):
        own_a, own_b = cells[a, t, 0], cells[b, t, 0]
        at_a = (cells[b, t] == own_a[:, None]).any(1)
        at_b = (cells[a, t, 1:] == own_b[:, None]).any(1)
        new = open_ & (at_a | at_b)
        found[new] = np.where(at_a, own_a, own_b)[new]
        open_ &= ~new
    return found == here


def block_links(here: int, ids: np.ndarray, times: np.ndarray, own: np.ndarray, side: np.ndarray, unit: np.ndarray, bound: float, lat: Lattice) -> tuple:
    """(id, links counted here, least id reached) of the vectors of one block pair. side: 0 and 1 are compared with each other only, 2 among themselves."""
    found_a, found_b = [], []
    for lo in range(0, len(ids), BLOCK):
        close = unit[lo : lo + BLOCK] @ unit.T >= bound
        i, j = np.nonzero(close)
        i += lo
        fine = (i < j) & (own[i] | own[j]) & ((side[i] == 2) | (side[i] != side[j]))
        found_a.append(i[fine])
        found_b.append(j[fine])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    if not len(used):
        return ids[:0], ids[:0], ids[:0]
    a, b = back[: len(a)], back[len(a) :]
    cells, counted = lat.cells(unit[used]), []
    for lo in range(0, len(a), 200_000):
        counted.append(meets_first(cells, a[lo : lo + 200_000], b[lo : lo + 200_000], here))
    counted = np.concatenate(counted)
    links = np.zeros(len(used), np.int64)
    np.add.at(links, a[counted], times[used[b[counted]]])
    np.add.at(links, b[counted], times[used[a[counted]]])
    return ids[used], links, ids[used][forest(len(used), a, b)]


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, usable, k1, k2, packed) of each row; packed holds the components' bytes."""
    double = table.schema["embedding"].dataType.elementType.typeName() == "double"
    kind = "<f8" if double else "<f4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                x = None if not row or None in row else np.array(row, kind) + np.array(0, kind)
                fine = x is not None and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "packed"])

    packed = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(tidy("embeddings", pack), "vec_id long, packed binary")
    return packed.withColumn("k1", F.xxhash64("packed")).withColumn("k2", F.xxhash64(F.lit(1), "packed"))


def near_duplicates(table: DataFrame, bound: float = COSINE, tables: int = TABLES, parts: int = PARTS, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of table (vec_id, embedding)."""
    spark = table.sparkSession
    kind = "<f8" if table.schema["embedding"].dataType.elementType.typeName() == "double" else "<f4"
    width = np.dtype(kind).itemsize
    rows = written(vectors(table))
    classes = rows.where("packed IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("packed").alias("packed"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    settings = (tables, parts, probes, scale, seed)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array(list(map(len, packed)))
            for size in np.unique(sizes):
                for lot in np.array_split(np.flatnonzero(sizes == size), -(-int((sizes == size).sum()) // 1000)):
                    cells = lattice(int(size) // width, *settings).cells(unit_rows([packed[k] for k in lot], kind))
                    each = cells.shape[1] * cells.shape[2]
                    own = np.zeros(cells.shape, bool)
                    own[:, :, 0] = True
                    at = np.repeat(lot, each)
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(own.ravel()), pa.array(ids[at])], ["cell", "own", "id"])

    visits = written(classes.select("id", "packed").mapInArrow(tidy("embeddings", visit), "cell long, own boolean, id long"))
    company = visits.groupBy("cell").agg(F.count("*").alias("members"), F.max("own").alias("lived_in")).where((F.col("members") > 1) & F.col("lived_in"))
    company = company.select("cell", F.when(F.col("members") > BLOCK, F.ceil(F.col("members") / (BLOCK // 2))).otherwise(1).cast("int").alias("blocks"))
    dealt = visits.join(company, "cell").join(classes.select("id", "times", "packed"), "id")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).cast("int").alias("side"), "own", "id", "times", "packed")
    met = dealt.repartition(partitions(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def close(rows: pa.Table):
            key = np.stack([rows.column(k).to_numpy() for k in ("cell", "i", "j")], 1)
            side, own, ids, times = (rows.column(k).to_numpy() for k in ("side", "own", "id", "times"))
            starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            packed, out = rows.column("packed"), [[], [], []]
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo < 2 or not own[lo:hi].any():
                    continue
                blobs = packed.slice(lo, hi - lo).to_pylist()
                sizes = np.array(list(map(len, blobs)))
                for size in np.unique(sizes):
                    k = np.flatnonzero(sizes == size)
                    if len(k) > 1:
                        unit = unit_rows([blobs[x] for x in k], kind)
                        got = block_links(int(key[lo, 0]), ids[lo:hi][k], times[lo:hi][k], own[lo:hi][k], side[lo:hi][k], unit, bound, lattice(int(size) // width, *settings))
                        for column, values in zip(out, got, strict=True):
                            column.append(values)
            none = np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*column, none])) for column in out], ["id", "links", "least"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            key = np.stack([held.column(k).to_numpy() for k in ("cell", "i", "j")], 1)
            changes = np.flatnonzero((key[1:] != key[:-1]).any(1))
            if len(changes):
                whole = int(changes[-1]) + 1
                yield close(held.slice(0, whole))
                held = held.slice(whole).combine_chunks()
        if held is not None and len(held):
            yield close(held)

    found = written(met.mapInArrow(tidy("embeddings", compare), "id long, links long, least long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    whole = classes.select("id", "k1", "k2", "least", "times").join(linked, "id", "left").join(named.withColumnRenamed("node", "id"), "id", "left")
    whole = whole.withColumn("component", F.coalesce("component", "id"))
    first = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = written(whole.join(first, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"))
    lone = rows.where("packed IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("packed IS NOT NULL").join(whole, ["k1", "k2"]).select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
