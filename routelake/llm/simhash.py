"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits.

Candidate search by segment-popcount embedding: a fingerprint becomes the vector of the bit counts of its 32 segments of two bits.
The Manhattan distance of two such vectors is a lower bound of the Hamming distance. The segments form two halves; if the whole
distance is at most 4, it is at most 2 in one half, and then some integer vector lies within distance 1 of both. So each distinct
fingerprint visits, for either half, its grid cell and the cells one step away, and two fingerprints within the bound always meet in
a cell. There all bits are compared. Nothing is sampled or capped: the search is exact.

Cells in which very many fingerprints meet are divided again, by the quarters of the other half: of what is left of the bound, one
quarter holds two at most, so steps of one bound it in the same way, and the members of a crowded cell are dealt over many tasks.

Distinct fingerprints are searched, so exact copies cost one row. A cell gives a least spanning forest of its links, never its pairs,
and of these only the links whose first common cell it is: both ends of another link are connected in the link's first cell already,
by links no longer. So the links of a group grow with its members, not with the cells they share.

near_duplicates() links fingerprints by their bits alone. one_of_each() links texts by the similarity of their sets of shingles:
links of fingerprints, verified, join what differs in few bits. At a similarity of 0.8 two fingerprints differ in about ten bits
of 64, which no cell of few bits bounds, so the rest is found by bands of least hashes of the sets: a pair of similarity 0.8 shares
no band with a chance of 3e-5, less above, whatever the edit. All shingles of both texts then decide, whatever the length. Of a
band's key with many members, each is compared with a centre. Keys that still hold several components, such as those of a passage
that many texts share, are settled by an exact join on the rarest shingles of their members.

Defined cases: a text without words (null, empty, only white space) has the fingerprint zero, which is linked like any other; fewer
words than a shingle are one shingle; repeated rows stay repeated and share a class; an empty table gives no rows; other columns
are ignored; a null doc_id is the largest of its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.components import components
from routelake.llm.shared import forget, partitions, tidy, written

SHINGLE, SEED, BITS = 4, 42, 4
#: The bound holds for up to this many differing bits: two halves, each within one step of a common cell.
MOST_BITS = 5
CHUNK_HASHES = 200_000
#: Members of a cell beyond which it is divided by the bit counts of the other half.
MOST_IN_CELL = 20_000

_LOW = np.uint64(0x5555555555555555)


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of so many words, A to Z in lower case."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each bit: a row of 64 a run, bit 0 first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints(texts: list, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    out, flat, at, owner = np.zeros(len(texts), np.uint64), [], [], []

    def add():
        if flat:
            hashes = np.array(flat, np.uint64)
            n = np.diff([*at, len(flat)])
            ones = bit_sums(hashes, np.array(at)) * 2 > n[:, None]
            out[owner] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()

    for i, text in enumerate(texts):
        if got := shingle_hashes(text, shingle, seed):
            at.append(len(flat))
            owner.append(i)
            flat += got
            if len(flat) >= CHUNK_HASHES:
                add()
                flat, at, owner = [], [], []
    add()
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint as a signed long, and a hash of the text that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(1).to_pylist(), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["doc_id", "fp", "text_hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(tidy("simhash", run), "doc_id long, fp long, text_hash long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments of two bits, packed two bits each."""
    return (fp & _LOW) + ((fp >> np.uint64(1)) & _LOW)


def halves(fp: np.ndarray) -> list[np.ndarray]:
    """The packed bit counts of either half of the segments."""
    counts = popcounts(fp)
    return [((counts >> np.uint64(32 * h)) & np.uint64(0xFFFFFFFF)).astype(np.int64) for h in (0, 1)]


def around(own: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into own, counts) of all vectors of bit counts within one step; the own ones come first."""
    index, out = [np.arange(len(own))], [own]
    for s in range(segments):
        digit = (own >> (2 * s)) & 3
        for step, can in ((1, digit < 2), (-1, digit > 0)):
            k = np.flatnonzero(can)
            index.append(k)
            out.append(own[k] + step * (1 << (2 * s)))
    return np.concatenate(index), np.concatenate(out)


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, cell) of all cells within one step, for either half. A cell's top bit names the half."""
    index, out = zip(*(around(own | (h << 32), 16) for h, own in enumerate(halves(fp))), strict=True)
    return np.concatenate(index), np.concatenate(out)


def quarters(cell: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """The bit counts of either quarter of the half that a cell does not name."""
    low, high = halves(fp)
    other = np.where(cell >> 32, low, high)
    return [(other >> (16 * q)) & 0xFFFF for q in (0, 1)]


def subcells(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, subcell) of members of cells: the half that the cell does not name differs by at most five, so one of its quarters by at most two, and the same steps bound it."""
    index, out = zip(*(around(own | ((q + 1) << 16), 8) for q, own in enumerate(quarters(cell, fp))), strict=True)
    return np.concatenate(index), np.concatenate(out)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each of n positions reaches by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            return label
        label = new


def least_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the links of the minimum spanning forest of n nodes, by distance d, then place: any set of links has one alone."""
    order = np.lexsort((b, a, d))
    a, b = a[order], b[order]
    label, alive, chosen = np.arange(n), np.arange(len(a)), []
    while True:
        la, lb = label[a[alive]], label[b[alive]]
        apart = la != lb
        alive, la, lb = alive[apart], la[apart], lb[apart]
        if not len(alive):
            return order[np.unique(np.concatenate(chosen))] if chosen else np.empty(0, int)
        best = np.full(n, len(a))
        np.minimum.at(best, la, alive)
        np.minimum.at(best, lb, alive)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        label = forest(n, label[a[pick]], label[b[pick]])[label]


def first_of(a: np.ndarray, b: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, the first vector within a step of both) of pairs of vectors of bit counts: the common one, the lesser of neighbours, or of those between the least."""
    places = 2 * np.arange(segments)
    gap = ((b[:, None] >> places) & 3) - ((a[:, None] >> places) & 3)
    far, most = np.abs(gap).sum(1), np.iinfo(np.int64).max // 2
    between = a + np.where(gap != 0, np.sign(gap) << places, most).min(1, initial=most)
    return far, np.where(far == 0, a, np.where(far == 1, np.minimum(a, b), between))


def first_cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cell in which each pair of fingerprints meets first: of the first half that bounds it."""
    out = np.full(len(x), -1)
    for h, (a, b) in reversed([*enumerate(zip(halves(x), halves(y), strict=True))]):
        far, cell = first_of(a, b, 16)
        out = np.where(far <= 2, cell | (h << 32), out)
    return out


def first_subcells(cell: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.full(len(x), -1)
    for q, (a, b) in reversed([*enumerate(zip(quarters(cell, x), quarters(cell, y), strict=True))]):
        far, sub = first_of(a, b, 8)
        out = np.where(far <= 2, sub | ((q + 1) << 16), out)
    return out


def linked_in_cells(cell: np.ndarray, fp: np.ndarray, bits: int, sub: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints within runs of equal cells, and subcells if any (0: the whole cell), that differ in few bits: the least forest of each run, without those that have met elsewhere before. Rows are sorted by cell, subcell and fingerprint."""
    n = len(cell)
    sub = np.zeros(n, np.int64) if sub is None else sub
    found, held, step = [np.empty((3, 0), np.int64)], 0, 1
    alive = np.arange(n)

    def shrunk() -> np.ndarray:
        a, b, d = np.concatenate(found, 1)
        return np.stack([a, b, d])[:, least_forest(n, a, b, d)]

    while True:
        alive = alive[alive + step < n]
        alive = alive[(cell[alive] == cell[alive + step]) & (sub[alive] == sub[alive + step])]
        if not len(alive):
            break
        d = np.bitwise_count(fp[alive] ^ fp[alive + step]).astype(np.int64)
        near = d <= bits
        found.append(np.stack([alive[near], alive[near] + step, d[near]]))
        held += int(near.sum())
        if held > 4 * n + 200_000:
            found, held = [shrunk()], 0
        step += 1
    a, b, _ = shrunk()
    first = (first_cells(fp[a], fp[b]) == cell[a]) & ((sub[a] == 0) | (first_subcells(cell[a], fp[a], fp[b]) == sub[a]))
    return fp[a[first]], fp[b[first]]


def crowded(fps: DataFrame, most: int) -> DataFrame:
    """(cell): the cells that more than `most` fingerprints visit, by what live in them and a step away. Cells in which few live are not counted, so others hold half as many again at most."""

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [half | (h << 32) for h, half in enumerate(halves(batch.column(0).to_numpy().view(np.uint64)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own))], ["cell"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, cell = around(batch.column(0).to_numpy(), 16)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1).take(pa.array(index))], ["cell", "n"])

    full = fps.select("fp").mapInArrow(tidy("simhash", live), "cell long").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most // 66)
    return full.mapInArrow(tidy("simhash", spread), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("cell")


def fingerprint_links(fps: DataFrame, bits: int = BITS, most: int = MOST_IN_CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps (fp long): of each cell, the least forest of its pairs that differ in few bits. Cells with more than `most` members are dealt over subcells."""
    if bits > MOST_BITS:
        raise ValueError(f"cells of one step bound at most {MOST_BITS} differing bits")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for lo in range(0, len(fp), 20_000):
                index, cell = cells(fp[lo : lo + 20_000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[lo : lo + 20_000][index])], ["cell", "fp"])

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 20_000):
                cell, fp = (batch.column(k).to_numpy()[lo : lo + 20_000] for k in (0, 1))
                index, sub = subcells(cell, fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(cell[index]), pa.array(sub), pa.array(fp[index])], ["cell", "sub", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def links(cell, sub, fp):
            a, b = linked_in_cells(cell, fp.view(np.uint64), bits, sub)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns, strict=True)]
            cell, sub, _ = held
            # The last cell may go on.
            whole = int(np.flatnonzero((cell != cell[-1]) | (sub != sub[-1]))[-1]) + 1 if len(cell) and (cell[0] != cell[-1] or sub[0] != sub[-1]) else 0
            if whole:
                yield links(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield links(*held)

    visits = fps.select("fp").mapInArrow(tidy("simhash", visit), "cell long, fp long")
    full = written(crowded(fps, most))
    if full.isEmpty():
        dealt = visits.select("cell", F.lit(0).cast("long").alias("sub"), "fp")
    else:
        divided = visits.join(full, "cell", "left_semi").mapInArrow(tidy("simhash", divide), "cell long, sub long, fp long")
        dealt = visits.join(full, "cell", "left_anti").select("cell", F.lit(0).cast("long").alias("sub"), "fp").unionByName(divided)
    met = dealt.repartition(partitions(fps.sparkSession), "cell", "sub").sortWithinPartitions("cell", "sub", "fp")
    return met.mapInArrow(tidy("simhash", meet), "a long, b long")


def classified(marked: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component): the least fingerprint that each distinct one of marked reaches."""
    classes = written(marked.select("fp").distinct())
    found = components(fingerprint_links(classes, bits))
    return classes.join(found, classes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs (doc_id, text)."""
    marked = written(with_fingerprints(docs, shingle, seed))
    named = written(classified(marked, bits))
    # A component is named by a fingerprint first; its least doc_id follows from the least of each fingerprint.
    least = named.join(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    first = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(named.join(first, "component").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# Groups of similar texts: fingerprints, then bands of least hashes find candidates, shingles decide.

SIMILAR_WORDS, SIMILAR = 5, 0.8
#: A pair of similarity s shares no key with a chance of (1 - s ** BAND_ROWS) ** BANDS: 3e-5 at 0.8, 3e-6 at 0.83, whatever was edited.
BANDS, BAND_ROWS = 20, 4
#: Members of a key that are all compared with each other; more have a centre. Either way no pair of 0.8 is lost.
FEW = 8
#: Pairs of one text that a task compares; more are dealt over several tasks.
LOT = 512
PROFILE = "doc_id long, row_1 long, row_2 long, set_1 long, set_2 long, fp long, keys array<long>, size int"


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash from one, by number."""
    h = (h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, all of them, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two whole sets of shingles."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def in_lots(sets: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers, hashes in a row, where each set begins) of sets with hashes, some at a time."""
    full, at = [i for i, h in enumerate(sets) if len(h)], 0
    while at < len(full):
        upto, held = at, 0
        while upto < len(full) and (held == 0 or held + len(sets[full[upto]]) <= CHUNK_HASHES):
            held += len(sets[full[upto]])
            upto += 1
        some = full[at:upto]
        yield some, np.concatenate([sets[i] for i in some]), np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
        at = upto


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = BAND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(`bands` keys of each set of hashes, its fingerprint): a key hashes the least of the set under `rows` hash functions."""
    rng = np.random.default_rng(SEED)
    n = bands * rows
    odd, flip = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)
    least, fp = np.full((len(sets), n), 2**32 - 1, np.uint32), np.zeros(len(sets), np.uint64)
    for some, hashes, starts in in_lots(sets):
        ones = bit_sums(hashes, starts) * 2 > np.diff([*starts, len(hashes)])[:, None]
        fp[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
        flat = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        mixed = np.empty_like(flat)
        for k in range(n):
            np.bitwise_xor(flat, flip[k], out=mixed)
            np.multiply(mixed, odd[k], out=mixed)
            least[some, k] = np.minimum.reduceat(mixed, starts)
    keys = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands):
        for c in range(rows):
            keys[:, k] = remixed(keys[:, k] ^ least[:, k * rows + c].astype(np.uint64), k)
    return keys.view(np.int64), fp.view(np.int64)


def row_keys() -> list:
    """Two hashes of a row's doc_id and text, 128 bits that tell rows apart."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [F.xxhash64(F.lit(SEED + k), doc, doc.isNull(), text, text.isNull()).alias(f"row_{k}") for k in (1, 2)]


def profiles(docs: DataFrame, words: int = SIMILAR_WORDS) -> DataFrame:
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            keys, fp = band_keys(sets)
            names = [pa.array(np.array([xxh64_intdigest(h.tobytes(), seed) for h in sets], np.uint64).view(np.int64)) for seed in (1, 2)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *names, pa.array(fp), lists, pa.array([len(h) for h in sets], pa.int32())], [c.split()[0] for c in PROFILE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_keys()).mapInArrow(tidy("simhash", run), PROFILE)


def texts_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the classes that ids (id) names."""
    named = classes.select("id", "row_1", "row_2").join(ids.distinct(), "id", "left_semi")
    return docs.select(F.col("text").cast("string").alias("text"), *row_keys()).join(named, ["row_1", "row_2"]).select("id", "text").dropDuplicates(["id"])


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of pairs (a, b) whose texts are similar. Only the text of b travels with each pair; that of a goes once to each lot of its pairs."""

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, own = None, None
        for batch in batches:
            a, lots, b = (batch.column(k).to_pylist() for k in range(3))
            keep = []
            for k, text in enumerate(batch.column(3)):
                found = shingle_set(text.as_py(), words)
                if b[k] is None:
                    lot, own = (a[k], lots[k]), found
                elif lot == (a[k], lots[k]) and similarity(own, found) >= least:
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    dealt = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / LOT).cast("int").alias("lots"))
    sides = pairs.join(dealt, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), "b")
    firsts = dealt.select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(None).cast("long").alias("b"))
    rows = sides.join(texts.withColumnRenamed("id", "b"), "b").select("a", "lot", "b", "text")
    rows = rows.unionByName(firsts.join(texts.withColumnRenamed("id", "a"), "a").select("a", "lot", "b", "text"))
    rows = rows.repartition(partitions(pairs.sparkSession), "a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return rows.mapInArrow(tidy("simhash", fine), "a long, b long")


def band_pairs(shared: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members of a key, of sizes that a similarity of `least` allows: all of a key with few members, else each member with the one that has most members in all its keys, so that a group has one centre in all of its keys."""
    popular = shared.groupBy("id").agg(F.sum("n").alias("met"))
    large = shared.where(F.col("n") > FEW).join(popular, "id")
    centres = large.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("id"), "size")).alias("c"))
    near = F.least("size", "c.size") >= least * F.greatest("size", "c.size") - 1e-9
    pairs = large.join(centres, "key").where((F.col("id") != -F.col("c.id")) & near).select((-F.col("c.id")).alias("a"), F.col("id").alias("b"))
    members = shared.where(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("m"))
    each = F.transform("m", lambda x, i: F.transform(F.slice(F.col("m"), i + 2, F.lit(FEW)), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    few = members.select(F.explode(F.flatten(each)).alias("p")).where(F.least("p.x.size", "p.y.size") >= least * F.greatest("p.x.size", "p.y.size") - 1e-9)
    return pairs.unionByName(few.select(F.col("p.x.id").alias("a"), F.col("p.y.id").alias("b")))


def rare_pairs(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of texts of different labels that may be similar, and all that are: of sets (id, label, size, hash), those that share one of their rarest hashes (prefix filtering), at places that leave enough to share."""
    shared = sets.groupBy("hash").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("n > 1")
    # Hashes of one text alone come first in its order, without being named.
    sort = F.sort_array(F.collect_list(F.struct(F.col("n"), F.col("hash"), (F.col("x") != F.col("y")).alias("mixed"))))
    texts = sets.join(shared, "hash").groupBy("id", "label", "size").agg(sort.alias("s")).withColumn("alone", F.col("size") - F.size("s"))
    size = F.col("size")
    probe, index = (size - F.ceil(least * size - 1e-9) + 1).cast("int"), (size - F.ceil(2 * least / (1 + least) * size - 1e-9) + 1).cast("int")
    first = texts.select("id", "label", "size", index.alias("index"), "alone", F.posexplode(F.slice("s", 1, F.greatest(probe - F.col("alone"), F.lit(0)))).alias("at", "h")).where("h.mixed")
    first = written(first.select("id", "label", "size", (F.col("alone") + F.col("at")).alias("place"), F.col("h.hash").alias("hash"), (F.col("alone") + F.col("at") < F.col("index")).alias("indexed")))
    x, y = first.where("indexed").alias("x"), first.alias("y")
    enough = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= least / (1 + least) * (F.col("x.size") + F.col("y.size")) - 1e-9
    smaller = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id")))
    met = x.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.label") != F.col("y.label")) & smaller & (F.col("x.size") >= least * F.col("y.size") - 1e-9) & enough)
    out = met.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct()
    out._made_of = [first]
    return out


def unlike(pairs: DataFrame, *before: DataFrame) -> DataFrame:
    """pairs (a, b), each once whatever its order, without those of the tables before."""
    both = [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
    out = pairs.select("a", "b", *both).dropDuplicates(["low", "high"])
    for old in before:
        out = out.join(old.select(*both), ["low", "high"], "left_anti")
    return out.select("a", "b")


def similar_groups(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILAR, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(classes of the rows by equal sets of shingles, components of classes). Texts of a component are linked by a similarity of at least `least` on shingles of so many words.

    First links of fingerprints, small keys and the centres of large ones are compared. Texts of a large key that still holds several components are then joined by their rarest shingles: exact, and a passage that many texts share gives no pairs. So the result does not depend on the order of rows."""
    marked = written(profiles(docs, words=words))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_1", "row_2")
    firsts = [F.first(c).alias(c) for c in ("fp", "keys", "size")]  # the same in every row of a class
    classes = marked.groupBy("set_1", "set_2").agg(F.min(key).alias("first"), *firsts)
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), F.col("first.doc_id").alias("doc_id"), F.col("first.row_1").alias("row_1"), F.col("first.row_2").alias("row_2"), "fp", "keys", "size"))
    forget(marked)

    # Classes of one fingerprint are linked to the least, and one class stands for each end of a link.
    least_ids = written(classes.groupBy("fp").agg(F.min("id").alias("at"), F.count("*").alias("n")))
    links = fingerprint_links(least_ids, bits).withColumnsRenamed({"a": "x", "b": "y"})
    same = classes.join(least_ids.where("n > 1"), "fp").where("id != at").select(F.col("at").alias("a"), F.col("id").alias("b"))
    ends = least_ids.select("fp", "at")
    links = links.join(ends.withColumnsRenamed({"fp": "x", "at": "a"}), "x").join(ends.withColumnsRenamed({"fp": "y", "at": "b"}), "y").select("a", "b")
    rows = classes.select(F.explode("keys").alias("key"), "id", "size")
    shared = written(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    pairs = written(unlike(same.unionByName(links).unionByName(band_pairs(shared, least))))
    texts = written(texts_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id"))))
    good = written(similar_pairs(pairs, texts, words, least))
    found = components(good)
    forget(texts, least_ids)

    labelled = shared.where(F.col("n") > FEW).select("key", "id", "size").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    labelled = written(labelled.select("key", "id", "size", "label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    rest = written(labelled.join(mixed, "key", "left_semi").select("id", "size", "label").distinct())
    old = [shared, pairs, labelled, rest, good]
    if not rest.isEmpty():

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    part = batch.slice(lo, 256)
                    sets = [shingle_set(t.as_py(), words) for t in part.column(3)]
                    at = pa.array(np.repeat(np.arange(len(sets)), [len(h) for h in sets]))
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(3)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "label", "size", "hash"])

        texts = written(texts_of(docs, classes, rest.select("id")))
        sets = written(texts.join(rest, "id").select("id", "label", "size", "text").mapInArrow(tidy("simhash", hashes), "id long, label long, size int, hash long"))
        near = rare_pairs(sets, least)
        new = written(unlike(near, pairs))
        good = written(similar_pairs(new, texts, words, least))
        forget(near, sets, texts)
        old += [new, good]
        if not good.isEmpty():
            joined = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(good))
            forget(found)
            found = joined
    forget(*old)
    return classes, found


def one_of_each(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILAR) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group of similar texts: the one of the least doc_id, of repeated rows one."""
    classes, found = similar_groups(docs, words, least)
    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_1", "row_2")
    first = written(named.groupBy("component").agg(F.min(key).alias("f")).select("f.row_1", "f.row_2"))
    forget(found, classes)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("tie"), *row_keys())
    kept = keyed.join(first, ["row_1", "row_2"], "left_semi").groupBy("row_1", "row_2").agg(F.min_by("row", "tie").alias("row"))
    return kept.select("row.*")
