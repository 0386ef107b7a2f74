"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by closeness.

Fit. At most POSITIVES and NEGATIVES labelled texts, those with the least hash of doc_id, become the examples; these bounds are the
only sample, and every text is scored. Their terms are words, in lower case and without marks at their ends, and beginnings of
words. A term is selected if a likelihood-ratio test finds it tied to the label toxic and it is much more frequent there (at most TERMS of
them), so common prose does not drown the few words that matter. An example is a vector of (1 + log count) x idf over selected terms, of length one.

Index. Examples are numbered by their heaviest term, so alike ones are neighbours; a term's postings lie in blocks of BLOCK numbers,
each with its largest weight. A query adds up the bounds of its terms for each block and visits blocks from the highest bound down
until no bound reaches the K-th best cosine: exact, whatever is skipped.

Score. The K nearest vote with their squared cosine, times the weight of their class in all labelled rows; the share of toxic votes
is calibrated by a monotone fit on the examples, each scored without itself and its equals. Texts without a selected term share one
calibrated score. The nearest examples are returned as evidence.

Defined cases: null and empty texts score as texts without a selected term; very long texts are read whole; repeated rows score
alike; a doc_id with several labels is toxic if any of them is; null labels do not count; without labels of both kinds the score is
the share of toxic labels (0 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.shared import forget, tidy, written

POSITIVES, NEGATIVES, TERMS, K, BLOCK, SEED = 4000, 8000, 4096, 40, 64, 23
#: Terms are tested that occur in so many examples; of those selected, this share may be there by chance.
LEAST_EXAMPLES, BY_CHANCE = 3, 0.001
#: And the share of toxic examples among those that hold a term must be so many times that among all.
LEAST_LIFT = 4.0
TOXIC_FROM, EVIDENCE = 0.7, 3
#: Votes against, in perfectly close examples, that every text has beforehand; a few far neighbours don't convince.
DOUBT = 2.0
BEGINNINGS = (4, 5, 6, 7, 8)
MARKS = ".,;:!?\"'()[]{}<>#*$%&|-_/\\…«»¿¡"
CACHED = 300_000


def terms_of(word: str) -> tuple[str, ...]:
    word = word.lower().strip(MARKS)
    return (word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)) if word else ()


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter((text or "").split()).items():
        for term in terms_of(word):
            out[term] += n
    return out


class WordTerms(dict):
    """The numbers of the selected terms of a word."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        self[word] = out = tuple(self.numbers[t] for t in terms_of(word) if t in self.numbers)
        return out


@dataclass
class Index:
    """Postings by term: example numbers ascending with weights; first[t, b] is where block b of term t begins; most[t, b] its largest weight."""

    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    first: np.ndarray
    n: int

    @classmethod
    def of(cls, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> Index:
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, int)]).astype(int)
        weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        blocks = max(1, -(-len(vectors) // BLOCK))
        most = np.zeros((terms, blocks))
        np.maximum.at(most, (term, example // BLOCK), weight)
        start = np.searchsorted(term, np.arange(terms + 1))
        first = np.searchsorted(term * blocks + example // BLOCK, np.arange(terms)[:, None] * blocks + np.arange(blocks + 1)[None, :])
        return cls(start, example, weight, most, first, len(vectors))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: frozenset | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, by falling cosine, then number."""
        bounds = weights @ self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[: int((bounds > 0).sum())]
        best_e, best_c, at, step = np.empty(0, int), np.empty(0), 0, 4
        while at < len(order) and (len(best_c) < k or bounds[order[at]] >= best_c[k - 1]):
            found_e, found_c = [], []
            for b in order[at : at + step].tolist():
                cosines = np.zeros(BLOCK)
                for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                    lo, hi = self.first[t, b], self.first[t, b + 1]
                    if hi > lo:
                        cosines[self.example[lo:hi] - b * BLOCK] += w * self.weight[lo:hi]
                hit = np.flatnonzero(cosines)
                found_e.append(hit + b * BLOCK)
                found_c.append(cosines[hit])
            at, step = at + step, step * 2
            e, c = np.concatenate([best_e, *found_e]), np.concatenate([best_c, *found_c])
            if without:
                fine = np.array([x not in without for x in e.tolist()], bool)
                e, c = e[fine], c[fine]
            rank = np.lexsort((e, -np.round(c, 12)))[:k]
            best_e, best_c = e[rank], c[rank]
        return best_e, best_c


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted monotone fit of y on x by pooling neighbours, each pool drawn a little to the mean: (largest x of each pool, value)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([a, b * c, c])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2] or pools[-2][0] == pools[-1][0]):
            top, hits, weight = pools.pop()
            pools[-1] = [top, pools[-1][1] + hits, pools[-1][2] + weight]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


@dataclass
class Model:
    numbers: dict[str, int]
    idf: np.ndarray
    index: Index
    doc: np.ndarray
    toxic: np.ndarray
    class_weight: np.ndarray
    upto: np.ndarray
    value: np.ndarray
    silent: float

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), int)
        weights = (1 + np.log(np.array([counts[t] for t in terms.tolist()], float))) * self.idf[terms]
        return terms, weights / np.linalg.norm(weights)

    def share(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        votes = cosines**2 * self.class_weight[self.toxic[examples]]
        return float((votes * self.toxic[examples]).sum() / (votes.sum() + DOUBT * self.class_weight[1]))

    def score(self, counts: dict[int, int]) -> tuple[float, list]:
        if not counts or not self.index.n:
            return self.silent, []
        e, c = self.index.nearest(*self.vector(counts), K)
        if not len(e):
            return self.silent, []
        share = self.share(e, c)
        pool = min(int(np.searchsorted(self.upto, share)), len(self.value) - 1)
        # Within a pool of the calibration the share itself ranks texts, by a tenth of the way to the next pool's value.
        least, most = (self.upto[pool - 1] if pool else 0.0), max(self.upto[pool], share)
        beyond = (self.value[pool + 1] if pool + 1 < len(self.value) else 1.0) - self.value[pool]
        value = float(self.value[pool] + 0.1 * beyond * (share - least) / max(most - least, 1e-12))
        return value, [{"doc_id": int(self.doc[x]), "toxic": int(self.toxic[x]), "cosine": float(y)} for x, y in zip(e[:EVIDENCE].tolist(), c[:EVIDENCE].tolist(), strict=True)]


def certain(ratios: list[float], tests: int) -> int:
    """How many of the falling likelihood ratios to accept among so many tests (Benjamini and Hochberg's rule)."""
    fine = [k for k, r in enumerate(ratios, 1) if erfc(sqrt(max(r, 0.0) / 2)) <= BY_CHANCE * k / tests]
    return max(fine, default=0)


def in_training(doc_id) -> F.Column:
    """Not held out; a null doc_id has no text, so the remainder of an empty one, 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1


def fit(docs: DataFrame, labels: DataFrame, training=in_training, positives: int = POSITIVES, negatives: int = NEGATIVES, terms: int = TERMS) -> Model:
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(training(F.col("doc_id")))
    totals = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    chosen = None
    for kind, most in ((1, positives), (0, negatives)):
        part = labels.where(F.col("toxic") == kind).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most positives + negatives rows, whatever the input; a doc_id that repeats gives its least text.
    chosen = F.broadcast(written(chosen))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [term_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    examples = written(texts.mapInArrow(tidy("toxicity", read), "doc_id long, toxic int, terms array<string>, counts array<int>").groupBy("terms", "counts", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", "terms", "counts"))
    sizes = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        nothing = np.empty(0)
        return Model({}, nothing, Index.of([], 0), nothing, nothing, nothing, nothing, nothing, float(share))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda x, n, of: F.when(x > 0, x * F.log(x * (n1 + n0) / (F.lit(float(n)) * of))).otherwise(0.0)
    inside, outside = a + b, (n1 + n0) - a - b
    ratio = 2 * (part(a, n1, inside) + part(b, n0, inside) + part(n1 - a, n1, outside) + part(n0 - b, n0, outside))
    found = examples.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    heavy = totals[0] / n0, totals[1] / n1
    base = totals[1] / (totals[0] + totals[1])
    lifted = a * heavy[1] >= min(LEAST_LIFT * base, (1 + base) / 2) * (a * heavy[1] + b * heavy[0])
    tested = written(found.where(a + b >= LEAST_EXAMPLES).withColumn("ratio", ratio).withColumn("lifted", lifted))
    tests = tested.count()
    found = tested.where("lifted").orderBy(F.desc("ratio"), "term").limit(terms).collect()
    found = found[: certain([r["ratio"] for r in found], tests)]
    numbers = {r["term"]: i for i, r in enumerate(found)}
    idf = np.log((1 + n1 + n0) / (1 + np.array([r["a"] + r["b"] for r in found], float))) + 1

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{numbers[t]: n for t, n in zip(ts, ns, strict=True) if t in numbers} for ts, ns in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(x) for x in out], pa.list_(pa.int32())), pa.array([list(x.values()) for x in out], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    # As many rows as examples, with numbers of selected terms alone.
    rows = examples.mapInArrow(tidy("toxicity", restrict), "doc_id long, toxic int, terms array<int>, counts array<int>").collect()
    forget(examples, tested)
    rows = sorted((r["toxic"], r["doc_id"], sorted(zip(r["terms"], r["counts"], strict=True))) for r in rows)
    class_weight = np.array([totals[0] / n0, totals[1] / n1])
    model = Model(numbers, idf, Index.of([], 0), np.empty(0), np.empty(0), class_weight, np.zeros(1), np.zeros(1), 0.0)
    vectors = [(t, d, *model.vector(dict(c))) for t, d, c in rows if c]
    vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]), v[1]))
    model.index = Index.of([(v[2], v[3]) for v in vectors], len(numbers))
    model.doc, model.toxic = np.array([v[1] for v in vectors], int), np.array([v[0] for v in vectors], int)
    calibrate(model, [t for t, _, c in rows if not c], [(v[2], v[3]) for v in vectors])
    return model


def calibrate(model: Model, silent: list[int], vectors: list) -> None:
    """Sets the monotone map from shares of votes to scores: each example is scored without itself and those equal to it."""
    equal: dict = {}
    for i, (t, w) in enumerate(vectors):
        equal.setdefault((t.tobytes(), w.tobytes()), []).append(i)
    shares, truth = [], []
    heavy = model.class_weight
    for same in equal.values():
        e, c = model.index.nearest(*vectors[same[0]], K + min(len(same), 50), frozenset())
        for i in same:
            # Equals vote, but the example itself does not.
            keep = e != i
            if keep.any():
                shares.append(model.share(e[keep][:K], c[keep][:K]))
                truth.append(int(model.toxic[i]))
            else:
                silent.append(int(model.toxic[i]))
    quiet = np.bincount(np.array(silent, int), minlength=2) * heavy
    model.silent = float((quiet[1] + 0.05) / (quiet.sum() + 1))
    if shares:
        y = np.array(truth, float)
        model.upto, model.value = monotone(np.array(shares), y, heavy[y.astype(int)])
        model.value = np.clip(model.value, 0.001, 0.999)
    elif len(model.toxic):
        model.upto, model.value = np.array([0.5, 1.0]), np.array([0.25, 0.75])


class Scorer:
    """Scores texts in turn; equal vectors are looked up once."""

    def __init__(self, model: Model):
        self.model, self.terms, self.known = model, WordTerms(model.numbers), {}

    def __call__(self, text: str | None) -> tuple[float, list]:
        counts: dict[int, int] = {}
        for hit in filter(None, map(self.terms.__getitem__, (text or "").split())):
            for t in hit:
                counts[t] = counts.get(t, 0) + 1
        key = tuple(sorted(counts.items()))
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = self.model.score(counts)
        return self.known[key]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, evidence) of each row of docs (doc_id, text), whatever its other columns."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = [scorer(text.as_py()) for text in batch.column(1)]
            scores = np.array([s for s, _ in out], float)
            evidence = pa.array([e for _, e in out], pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= TOXIC_FROM).astype(np.int32)), evidence], ["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy("toxicity", score), "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, toxic: int, cosine: double>>")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer(text.as_py())[0] < TOXIC_FROM for text in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(tidy("toxicity", fine), docs.schema)
