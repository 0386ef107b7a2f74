"""The ten operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelake.llm import chat, embeddings, mixing, packing, quality, queries, sharding, shared, simhash, substrings, toxicity, urls
from routelake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, shard int, fp string, kept boolean"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, one long text, nulls, empties, marks, repeated rows and columns of clashing names."""
    rng = random.Random(1)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[0].upper(), prose(rng, 30) + " " + passage + " " + prose(rng, 10), passage, prose(rng, 5) + "\n" + passage]
    texts += [None, "", " \n\t", "x", "a b c", "ein\u00a0Wort zwei", "Zeile\nZeile\n \nZeile\nandere", "# $ % & | < > *\n" * 20, "the same words the same words the same words", prose(rng, 6000, 40), "word " * 500]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0, 0.5, "big", 9, "f", True) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "no id here", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_by_row():
    return [(r[0], r[1]) for r in corpus()]


def test_words(spark):
    rows = spark.createDataFrame([("a\tb\x0bc\x0cd\re\nf  g\u00a0h ",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(shared.words(F.col("t"))).collect()] == [["a", "b", "c", "d", "e", "f", "g\u00a0h"], [], []]


def test_splitters(spark):
    rows = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int")
    cuts = [(1, 2), (2, 0), (3, 3)]
    for r in rows.withColumn("k", shared.range_of(("a", "b"), cuts)).collect():
        assert r.k == sum(c <= (r.a, r.b) for c in cuts)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}


# 1 toxicity


def test_toxicity_held_out(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = prose(rng, rng.randint(20, 80), 5000) + (f" {rng.choice(['vileX', 'grimeY', 'scornZ'])}{rng.randrange(9)} " if bad else " ") + prose(rng, 20, 5000)
        rows.append((i, text))
        labels += [(i, int(bad))]
    labels += [(0, 0), (900, None), (None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    got = {r.doc_id: r for r in toxicity.scored(table, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and any(r.evidence for r in got.values())
    assert {r.doc_id for r in toxicity.without_toxic(table, model).collect()} == {i for i in got if not got[i].predicted}
    odd = toxicity.scored(docs, model)
    assert odd.count() == docs.count() and all(r.score < 0.7 for r in odd.collect())
    assert toxicity.scored(empty, model).count() == 0 and toxicity.fit(empty, marks).score({})[1] == []


def test_toxicity_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.Index.of(vectors, 40)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:60]:
        e, c = index.nearest(t, w, 15)
        want = dense[:, t] @ w
        assert np.allclose(c, np.sort(want)[::-1][:15]) and np.allclose(want[e], c)


def test_toxicity_scores_are_those_of_brute_force(spark):
    """Every score of a table from dense vectors of all examples: cosines, the nearest, their votes, the calibration."""
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    model = toxicity.fit(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    again = toxicity.fit(queries.table(spark, sf, "documents").repartition(7), queries.table(spark, sf, "labels").repartition(5))
    assert model.numbers == again.numbers and np.array_equal(model.doc, again.doc) and np.array_equal(model.value, again.value)
    dense = np.zeros((model.index.n, len(model.idf)))
    for t in range(len(model.idf)):
        part = slice(model.index.start[t], model.index.start[t + 1])
        dense[model.index.example[part], t] = model.index.weight[part]
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    scored = 0
    for r in docs.collect():
        counts = collections.Counter()
        for w in (r.text or "").split():
            for t in toxicity.terms_of(w):
                if t in model.numbers:
                    counts[model.numbers[t]] += 1
        row = got[r.doc_id]
        if not counts:
            assert row.score == model.silent and not row.evidence
            continue
        scored += 1
        q = np.zeros(len(model.idf))
        for t, n in counts.items():
            q[t] = (1 + np.log(n)) * model.idf[t]
        cosines = dense @ (q / np.linalg.norm(q))
        nearest = np.lexsort((np.arange(len(cosines)), -np.round(cosines, 12)))[: toxicity.K]
        nearest = nearest[cosines[nearest] > 0]
        votes = cosines[nearest] ** 2 * model.class_weight[model.toxic[nearest]]
        share = (votes * model.toxic[nearest]).sum() / (votes.sum() + toxicity.DOUBT * model.class_weight[1])
        pool = min(np.searchsorted(model.upto, share - 1e-12), len(model.value) - 1)
        top = model.value[pool + 1] if pool + 1 < len(model.value) else 1.0
        assert model.value[pool] - 1e-9 <= row.score <= model.value[pool] + 0.1 * (top - model.value[pool]) + 1e-9
        assert np.allclose([e.cosine for e in row.evidence], cosines[nearest[: toxicity.EVIDENCE]])
    assert scored


def test_toxicity_of_odd_rows(spark):
    rows = [(i, "prose " * 5 + ("vileX " if i % 3 == 0 else "calm ") * 3 + f"w{i}") for i in range(240)]
    table = spark.createDataFrame([*rows, (3, "another text of three"), (None, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    assert len(set(model.doc.tolist())) == len(model.doc)
    got = table.select(toxicity.in_training(F.col("doc_id")).alias("t")).collect()
    assert all(r.t is not None for r in got) and toxicity.scored(table, model).count() == 242


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()} == {0.0}


# 2 mixing


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus()) and mixing.mix(empty).count() == 0
    sizes = collections.Counter()
    for (_, t), r in zip(texts_by_row(), corpus()):
        sizes[r[3]] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(order, [5, 2, 1, 5]))
    capped, total = set(), sum(sizes.values())
    while True:
        left, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        more = {s for s in order if target[s] > 3 * sizes[s] + 1e-9}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
    largest = max(len(words(t)) for _, t in texts_by_row())
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    assert sorted(got, key=repr) == sorted(mixing.mix(docs.repartition(5)).collect(), key=repr)


def test_mixing_keeps_rows(docs):
    names = ("doc_id", "text", "size")
    rows = mixing.mix(docs, keep=names).where("copies > 0").select("kept.*", "copies").collect()
    assert rows and set(rows[0].asDict()) == {*names, "copies"}


# 3 substrings


def brute_substrings(rows, window=20):
    """Windows in order of (doc_id, text hash unknown here: one text an id), start."""
    first, out = {}, {}
    for d, t in sorted({(2**63 if d is None else d, t) for d, t in rows}, key=lambda r: (r[0], r[1] or "")):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in first and first[k] != (d, i):
                gone[i : i + window] = [True] * window
            else:
                first.setdefault(k, (d, i))
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("chunk", [6_000_000, 3000])
def test_substrings(docs, empty, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    want = brute_substrings(texts_by_row())
    got = substrings.without_repeats(docs).collect()
    assert len(got) == len(corpus()) and sum(r.n_removed for r in got) > 500
    for r in got:
        assert (r.n_words, r.n_removed, r.text) == want[2**63 if r.doc_id is None else r.doc_id]
    assert substrings.without_repeats(empty).count() == 0
    same = {r.doc_id: r.text for r in substrings.without_repeats(docs, untouched=True).where("n_removed = 0").collect()}
    assert all(t == dict(texts_by_row())[d] or t == "" for d, t in same.items())


def test_substring_collisions(monkeypatch):
    """Windows of equal hash and different text remove nothing."""
    monkeypatch.setattr(substrings, "mixed", lambda x: x * np.uint64(0))
    keys = np.array([[1, 0, 0], [2, 0, 0], [3, 0, 5]], np.int64)
    got = substrings.later_windows(keys, b"a b c\nd e f\na b c", 3)
    assert got.tolist() == [[3, 0, 5, 1]]


# 4 sharding


def test_sharding(docs, empty):
    got = sharding.shard(docs).collect()
    assert len(got) == len(corpus()) and sharding.shard(empty).count() == 0
    text = {d: t for d, t in texts_by_row()}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= total / 24 + largest
    assert sorted(got, key=repr) == sorted(sharding.shard(docs.repartition(2)).collect(), key=repr)


def test_sharding_hot_text(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one very common text").otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    got = sharding.shard(rows)
    load = [r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 24 and max(load) < 1.03 * min(load)


# 5 embeddings


def vectors_table():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 64))
    rows = [base[i].tolist() for i in range(120)]
    rows += [(base[i] + rng.normal(size=64) * s).tolist() for i in range(30) for s in (0.05, 0.2, 0.35, 0.45)]
    rows += [rows[3], rows[3], rows[7], (base[9] * 3).tolist()]
    rows += [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 8, [1.0] * 8]
    return [(i, v, 1, 0, True) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    table = spark.createDataFrame(vectors_table(), "vec_id long, embedding array<double>, label int, n_links int, kept boolean")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert set(got) == {r[0] for r in vectors_table()}
    fine = {i: np.array(v) for i, v, *_ in vectors_table() if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in fine.items()}
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in unit}
    want, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    assert 0.9 * want <= found <= want and all(got[i].n_links <= len(links.get(i, [])) for i in got)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in got if i not in unit)
    label = {i: i for i in unit}
    for _ in range(200):
        for i in unit:
            label[i] = min([label[i], *(label[j] for j in links[i])])
    assert sum(got[i].component_id == label[i] for i in unit) >= 0.97 * len(unit)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_recall_at_the_bound():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(1500, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    lat = embeddings.Lattice(64, embeddings.TABLES, embeddings.PARTS, embeddings.PROBES, embeddings.SCALE, embeddings.SEED)
    x, y = lat.cells(a), lat.cells(0.9 * a + np.sqrt(1 - 0.81) * b)
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    assert met.mean() >= 0.93


def test_e8():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    near = embeddings.nearest_e8(x)
    d = ((x - near) ** 2).sum(1)
    assert (((x[:, None] - near[:, None] - embeddings.roots()[None]) ** 2).sum(2) >= d[:, None] - 1e-9).all()
    assert len(embeddings.roots()) == 240 and np.allclose((embeddings.roots() ** 2).sum(1), 2)


def test_empty_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 6 simhash


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_short_documents_leave_little_padding(spark):
    rows = [(i, f"word {i % 97}") for i in range(30_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.tokenizer_path()).groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in got)
    assert len(got) <= 1.05 * total / packing.CAPACITY + 2 and max(r[1] for r in got) <= packing.CAPACITY


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    rows = texts_by_row()
    fps = {d: plain_fingerprint(t) for d, t in rows}
    assert len(got) == len(rows) and all(r.fp % 2**64 == fps[r.doc_id] for r in got)
    ids = list(fps)
    label = {d: 2**63 if d is None else d for d in ids}
    for _ in range(len(ids)):
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    assert all(r.component_id == label[r.doc_id] for r in got if label[r.doc_id] != 2**63)
    assert simhash.near_duplicates(empty).count() == 0


def test_cells_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    near = base.copy()
    for k in range(300):
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    fp = np.unique(np.concatenate([base, near]))
    index, cell = simhash.cells(fp)
    order = np.lexsort((fp[index], cell))
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    for bits in (4, 5):
        a, b = np.nonzero(np.triu(d <= bits, 1))
        x, y = simhash.linked_in_cells(cell[order], fp[index][order], bits)
        at = lambda v: np.searchsorted(fp, v)
        assert np.array_equal(simhash.forest(len(fp), a, b), simhash.forest(len(fp), at(x), at(y)))


def test_crowded_cells_are_divided(spark):
    """The same classes whether cells are divided or not, and as brute force finds them."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.int64).astype(np.uint64)
    fp = [base]
    for _ in range(400):
        x = base.copy()
        for b in rng.choice(64, rng.integers(1, 8), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        fp.append(x)
    fp = np.unique(np.concatenate(fp))
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    want = simhash.forest(len(fp), a, b)
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    assert simhash.crowded(table, 60).count() > 5
    for most in (60, 10**6):
        links = simhash.fingerprint_links(table, 4, most).collect()
        at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
        assert np.array_equal(want, simhash.forest(len(fp), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links])))


def test_links_of_a_group_stay_linear():
    """Near fingerprints share dozens of cells; each link is given once, and few besides a forest of the group."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, dtype=np.int64).astype(np.uint64)
    fp = np.unique(np.concatenate([[base], [base ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(64) for j in range(i)]]).astype(np.uint64))
    index, cell = simhash.cells(fp)
    order = np.lexsort((fp[index], cell))
    x, y = simhash.linked_in_cells(cell[order], fp[index][order], 4)
    at = lambda v: np.searchsorted(fp, v)
    assert not simhash.forest(len(fp), at(x), at(y)).any()
    assert len({frozenset(p) for p in zip(x.tolist(), y.tolist())}) == len(x) <= 3 * len(fp)


def test_one_of_each(spark, docs, empty):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        w = prose(rng, 300, 4000).split()
        rows.append((i, " ".join(w)))
        v = list(w)
        for _ in range(2):
            v[rng.randrange(len(v))] = "changed"
        rows.append((100 + i, " ".join(v)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(table).collect()}
    assert len(kept) <= 41 and set(range(40)) <= kept
    odd = simhash.one_of_each(docs)
    assert odd.columns == docs.columns and simhash.one_of_each(empty).count() == 0
    left = [r.doc_id for r in odd.collect()]
    assert left.count(5) == 1 and 60 not in left and 0 in left and None in left


# 7 urls

URLS = [
    "https://a.example.org/es/x?q=1", "http://EXAMPLE.org/en/12#t", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://com/de/z", "ftp://org/", "http://organic/es/", "no scheme", "", None, "://", "http://example.org", "http://example.org?x=/es/", "http://sub.example.organ/es/", "x://y://org/", "http://a.b.c.d.example.org/es//",
    "http://example.org:80/es/", "http://u@example.org/es/", "http://example.org\n/es/", "http://a..org/",
]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, 0, "allow", None)
    return host, path, best[3], best[2]


@pytest.mark.parametrize("rules", [urls.RULES, (*urls.RULES, ("block", "example.org", "/es/x"), ("allow", "a.example.org", "/"), ("block", "org", "/es"), ("allow", "b.c", ""), ("block", "d.example.org", "/es/"))])
def test_urls(spark, rules):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS * 12)] + [(0, URLS[0], "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = urls.judge(pages, urls.rule_table(spark, rules)).collect()
    want = collections.Counter((i, *plain_verdict(u, rules)) for i, u, *_ in rows)
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert urls.judge(pages.limit(0), urls.rule_table(spark, rules)).count() == 0


# 8 packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack(docs, queries.tokenizer_path()).collect()
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts_by_row()}
    times, covered = collections.Counter(d for d, _ in texts_by_row()), collections.Counter()
    by_sequence = collections.defaultdict(list)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert all(covered[d, k] == times[d] for d in ids for k in range(len(ids[d])))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_word_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = packing.WordIds(tokenizer)
    rng = random.Random(7)
    odd = ["<|endoftext|>a b<|startoftext|>", "I'm he's x\u0301 \u0301 \x1c a\x0bb\x85c ΑΣ ΣΑΣ İstanbul 12345 ＡＢ", "", " ", "\n\n", "Wait... a.. b. c, d!? E. ªº x.\n y, \x0b z.\t q. SHE'LL. 'S. ß. Ⱥ x². d' it's' (a) [b]."]
    letters = "abcXYZéßΣ.,!'\"- \n\t12#<|>"
    for text in [*odd, *("".join(rng.choice(letters) for _ in range(60)) for _ in range(300))]:
        assert np.frombuffer(ids.of([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_differencing_is_even():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 257, 800)
    window, ways = packing.balanced(sizes, 2048)
    loads = np.bincount(window, sizes, ways)
    assert loads.max() <= 2048 and ways <= -(-sizes.sum() // 2048) + 1 and loads.max() - loads.min() < 60


# 9 chat


def test_chat(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "more"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"),
        (5, 0, "user", None), (6, 0, None, ""), (7, 3, "user", "hi"), (7, 3, "user", "hi"), (8, 0, "user", ""),
    ]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: (r.n_turns, r.n_collapsed, r.rendered) for r in chat.formatted(table).collect()}
    assert set(got) == {2, 4, 5, 6, 8}
    assert got[2] == (3, 1, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n")
    assert chat.formatted(table.limit(0)).count() == 0


# 10 quality


def plain_base(text):
    text = text or ""
    w = words(text)
    runs = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if runs[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, empty):
    want = {d: plain_base(t) for d, t in texts_by_row()}
    got = quality.cascade(docs).collect()
    assert len(got) == len(corpus()) and quality.cascade(empty).count() == 0
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    orders = [quality.cascade(docs, given).select("doc_id", "kept").collect() for given in (quality.rules(), quality.rules()[::-1])]
    assert sorted(orders[0], key=repr) == sorted(orders[1], key=repr)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 60 and not r.base_failed)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_sha(spark):
    assert spark.range(1).select(F.sha2(F.lit("é"), 256)).first()[0] == hashlib.sha256("é".encode()).hexdigest()
