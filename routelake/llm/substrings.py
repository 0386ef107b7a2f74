"""Substring dedup: passages of WINDOW words that start earlier elsewhere are removed, found by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the least hash of the runs of M words inside it. Consecutive
windows with one minimiser form a super-k-mer; it travels as one packed string of words to the bucket of that minimiser, so all
equal windows meet in one bucket. There the windows are sorted by hash and counted; windows of equal hash are compared as text, so
a collision removes nothing. Every window but the first of its text, by (doc_id, start), is marked, and its words go.

Equal super-k-mers of one chunk of rows are combined before the shuffle: all but the earliest are certain not to be first, so a
passage that a third of all rows share costs a bucket one string a chunk. Strings of a bucket are packed together and compressed.

Defined cases: a null or empty text has no words and is kept as it is; a text shorter than a window loses nothing; a null doc_id
counts as the largest; rows with one doc_id and one text are one place, so they are treated alike and do not remove each other; with
one doc_id and different texts the hash of the text decides which is earlier; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.shared import partitions, tidy, written

WINDOW, M = 20, 3
#: Bytes of text that a task works on at once, besides one whole document; buckets for each shuffle partition; words that are cached.
CHUNK, BUCKETS, CACHED = 6_000_000, 12, 200_000
NO_ID = 2**63 - 1

_PRIME, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHED:
            self.clear()
        self[word] = out = xxh64_intdigest(word, 7)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == n else np.minimum(x[: len(x) - (n - have)], x[n - have :])


def minimisers(hashes: np.ndarray, window: int, m: int) -> np.ndarray:
    """Minimiser of each window of the word hashes."""
    mers = np.zeros(len(hashes) - m + 1, np.uint64)
    for k in range(m):
        mers = mers * np.uint64(_PRIME) + hashes[k : len(hashes) - m + 1 + k]
    return sliding_min(mixed(mers), window - m + 1)


def packed(rows: list[tuple[int, int, int, bytes]], removed: list[tuple[int, int, int, int]]) -> bytes:
    """Super-k-mers (doc_id, text hash, start, words) and marked windows (doc_id, text hash, start, number) as one compressed string."""
    head = np.array([len(rows), len(removed)], np.int64)
    keys = np.array([r[:3] for r in rows], np.int64).reshape(-1, 3)
    gone = np.array(removed, np.int64).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + keys.T.tobytes() + gone.tobytes() + b"\n".join(r[3] for r in rows))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, gone = np.frombuffer(raw, np.int64, 2).tolist()
    keys = np.frombuffer(raw, np.int64, 3 * n, 16).reshape(3, n).T
    marks = np.frombuffer(raw, np.int64, 4 * gone, 16 + 24 * n).reshape(gone, 4)
    return keys, marks, raw[16 + 24 * n + 32 * gone :]


def split_chunk(docs: list[tuple[int, int, bytes]], buckets: int, window: int, m: int, words: WordHashes) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed super-k-mers) of documents (doc_id, text hash, text)."""
    lots: dict[int, dict[bytes, tuple[int, int, int]]] = {}
    gone: dict[int, list] = {}
    for doc, fp, text in docs:
        toks = text.split()
        n = len(toks)
        if n < window:
            continue
        joined = b" ".join(toks)
        low = minimisers(np.fromiter(map(words.__getitem__, toks), np.uint64, n), window, m)
        cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts, [len(low)]]) - 1
        ends = np.cumsum(np.fromiter(map(len, toks), np.int64, n) + 1)
        begin = np.where(first > 0, ends[first - 1], 0)
        bucket = (low[first] % np.uint64(buckets)).astype(np.int64)
        for s, e, a, z, b in zip(first.tolist(), last.tolist(), begin.tolist(), (ends[last + window - 1] - 1).tolist(), bucket.tolist(), strict=True):
            lot = lots.setdefault(b, {})
            piece = joined[a:z]
            here, there = (doc, fp, s), lot.get(piece)
            if there is None:
                lot[piece] = here
            elif here != there:
                lot[piece] = min(here, there)
                gone.setdefault(b, []).append((*max(here, there), e - s + 1))
    for b, lot in lots.items():
        yield b, packed([(*k, piece) for piece, k in lot.items()], gone.get(b, []))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def later_windows(keys: np.ndarray, text: bytes, window: int) -> np.ndarray:
    """(doc_id, text hash, start, number of windows) of the windows of super-k-mers whose text is also that of an earlier window."""
    buf = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero((buf == 32) | (buf == 10))
    start = np.concatenate([[0], breaks + 1])
    end = np.concatenate([breaks, [len(buf)]])
    final = np.concatenate([buf[breaks] == 10, [True]])  # the last word of its super-k-mer
    piece = np.concatenate([[0], np.cumsum(final)[:-1]])
    opens = np.flatnonzero(np.concatenate([[True], final[:-1]]))
    n = len(start) - window + 1
    inside = np.flatnonzero(piece[:n] == piece[window - 1 :])
    a, z = start[inside], end[inside + window - 1]
    # Three arrays of the text's length at most, each eight times its bytes.
    powers = _powers(len(buf), _PRIME)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.add(buf, 1, out=sums[1:], dtype=np.uint64)
    sums[1:] *= powers
    del powers
    np.cumsum(sums, out=sums)
    value = sums[z] - sums[a]
    del sums
    # Hashes are compared at one power: a window's sum times the power that its place lacks.
    value = mixed(value * _powers(len(buf), _INVERSE)[a])
    order = np.argsort(value, kind="stable")
    v = value[order]
    twin = np.zeros(len(v), bool)
    twin[1:] = v[1:] == v[:-1]
    twin[:-1] |= v[1:] == v[:-1]
    twin = order[twin]
    if not len(twin):
        return np.empty((0, 4), np.int64)
    p = piece[inside[twin]]
    doc, fp, at = keys[p, 0], keys[p, 1], keys[p, 2] + inside[twin] - opens[p]
    rank = np.lexsort((at, fp, doc, value[twin]))
    twin, p, doc, fp, at, v = twin[rank], p[rank], doc[rank], fp[rank], at[rank], value[twin][rank]
    later = np.zeros(len(twin), bool)
    group, lo, hi = None, a[twin].tolist(), z[twin].tolist()
    firsts: dict[bytes, int] = {}
    for k, h in enumerate(v.tolist()):
        if h != group:
            group, firsts = h, {}
        seen = firsts.setdefault(text[lo[k] : hi[k]], k)
        later[k] = seen != k and (doc[k], fp[k], at[k]) != (doc[seen], fp[seen], at[seen])
    doc, fp, at, p = doc[later], fp[later], at[later], p[later]
    rank = np.lexsort((at, p))
    doc, fp, at, p = doc[rank], fp[rank], at[rank], p[rank]
    if not len(p):
        return np.empty((0, 4), np.int64)
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)])
    runs = np.flatnonzero(new)
    return np.stack([doc[runs], fp[runs], at[runs], np.diff([*runs, len(p)])], 1)


def marked_windows(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """(id, fp, start, n): runs of n windows, from the word start on, of docs (id long, fp long, text) that start earlier elsewhere too."""
    buckets = BUCKETS * partitions(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows, held = WordHashes(), [], 0

        def flush():
            out = list(split_chunk(rows, buckets, window, m, words))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for doc, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                rows.append((doc, fp, raw))
                held += len(raw)
                if held >= CHUNK:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []

        def out(rows):
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(2)), *(pa.array(rows[:, k].astype(np.int32)) for k in (2, 3))], ["id", "fp", "start", "n"])

        def close():
            parts = [unpacked(x) for x in blobs]
            keys = np.concatenate([x[0] for x in parts])
            yield out(np.concatenate([x[1] for x in parts]))
            yield out(later_windows(keys, b"\n".join(x[2] for x in parts if len(x[0])), window))

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and blobs:
                    yield from close()
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs:
            yield from close()

    pieces = docs.mapInArrow(tidy("substrings", split), "bucket int, packed binary")
    # Buckets are dealt in turn, as hashing so few numbers would give some partitions twice the mean.
    met = pieces.repartitionById(partitions(docs.sparkSession), F.col("bucket")).sortWithinPartitions("bucket")
    return met.mapInArrow(tidy("substrings", count), "id long, fp long, start int, n int")


def covered(n: int, runs: list, window: int) -> np.ndarray:
    """True for each of n words that a marked window holds."""
    edge = np.zeros(n + 1, np.int64)
    for start, windows in runs:
        edge[start] += 1
        edge[min(n, start + windows + window - 1)] -= 1
    return np.cumsum(edge[:n]) > 0


def identified(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("fp"), text.alias("text"), *[F.struct(*keep).alias("kept")] * bool(keep))


def without_repeats(docs: DataFrame, window: int = WINDOW, m: int = M, keep: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, text) and the columns in keep: each row of docs (doc_id, text) with its kept words joined by one space. untouched: a text that loses nothing stays as it is."""
    rows = identified(docs, keep)
    runs = written(marked_windows(identified(docs).select("id", "fp", "text"), window, m))
    runs = runs.groupBy("id", "fp").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = rows.join(runs, ["id", "fp"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, marks in zip(batch.column("text"), batch.column("runs"), strict=True):
                toks = (text.as_py() or "").encode().split()
                n_words.append(len(toks))
                if marks.is_valid:
                    gone = covered(len(toks), [(x["start"], x["n"]) for x in marks.as_py()], window)
                    toks = [t for t, g in zip(toks, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(toks))
                texts.append(text.as_py() if untouched and not n_removed[-1] else b" ".join(toks).decode())
            ids = [None if d == NO_ID else d for d in batch.column("id").to_pylist()]
            columns = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(texts, pa.string())}
            if keep:
                columns["kept"] = batch.column("kept")
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_words long, n_removed long, text string"
    if keep:
        schema += f", kept {rows.schema['kept'].dataType.simpleString()}"
    return joined.mapInArrow(tidy("substrings", cut), schema)
