"""Near copies that a forest of candidates, fingerprints of words or a sketch would miss."""

import collections
import random

from routelake.llm import simhash


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def kept(spark, rows):
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    return {r.doc_id for r in simhash.one_of_each(table).collect()}


def test_star_of_copies(spark):
    """Each of 400 copies is at 0.81 to the original and mostly at 0.65 to the others."""
    rng = random.Random(8)
    base = prose(rng, 150)
    rows = [(0, base)]
    for i in range(1, 401):
        w = list(base)
        for k in (20, 70, 120):
            w[k + rng.randrange(-14, 15)] = f"x{rng.randrange(10**6)}"
        rows.append((i, w))
    assert kept(spark, rows) == {0}


def test_block_edits(spark):
    """A block added to copies: similarities of 0.80 and 0.79."""
    rng = random.Random(9)
    texts = [prose(rng, 204) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + prose(rng, 50 if i % 2 else 53)) for i, t in enumerate(texts)]
    assert kept(spark, rows) == {*range(100), *range(1000, 1100, 2)}


def test_long_texts_are_compared_whole(spark):
    """Texts of 2,000 words on both sides of the bound, by a word's difference."""
    rng = random.Random(10)
    texts = [prose(rng, 2004) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + prose(rng, 500 if i % 2 else 501)) for i, t in enumerate(texts)]
    assert kept(spark, rows) == {*range(40), *range(1000, 1040, 2)}


def test_every_pair_at_two_sizes(spark):
    """All pairs of 0.8 or more of the given tables, by brute force through an inverted index, and the same rows from any partitioning."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, where = {}, collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        for x in sets[r.doc_id]:
            where[x].append(r.doc_id)
    shared = collections.Counter()
    for ids in where.values():
        for i, a in enumerate(sorted(ids)):
            for b in sorted(ids)[i + 1 :]:
                shared[a, b] += 1
    label = {d: d for d in sets}
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = sorted(d for d, x in sets.items() if not x)
    links += [(empty[0], d) for d in empty[1:]]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = {d for d in sets if label[d] == d}
    assert len(links) > 20 and (582, 875) in links
    for parts in (1, 7):
        assert {r.doc_id for r in simhash.one_of_each(docs.repartition(parts)).collect()} == want


def test_clashing_columns_and_empty_table(spark):
    names = ["first_id", "hash_a", "row_1", "row_2", "tie", "row", "id", "key", "component", "label"]
    rows = [(1, "a b c d e f", *"abcdefghij"), (2, "A b  c d e f", *"klmnopqrst"), (1, "a b c d e f", *"uvwxyzabcd"), (None, None, *"klmnopqrst")]
    table = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    got = simhash.one_of_each(table)
    assert got.columns == table.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "None"]
    assert got.where("doc_id = 1").first().hash_a in "bv"
    assert simhash.one_of_each(table.limit(0)).collect() == []


def test_passage_that_many_share(spark, monkeypatch):
    """300 texts share 85 % of their words, at 0.74 to each other; near copies within them are found, and few others are compared."""
    rng = random.Random(12)
    passage = prose(rng, 340)
    rows = []
    for i in range(300):
        own = prose(rng, 60)
        rows.append((i, passage + own))
        if i % 30 == 7:
            rows.append((1000 + i, passage + own[:-4] + prose(rng, 4)))
    compared = []
    whole = simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda pairs, *a: compared.append(pairs.count()) or whole(pairs, *a))
    assert kept(spark, rows) == {*range(300)}
    assert sum(compared) <= 5 * len(rows)  # of 47,895 pairs
