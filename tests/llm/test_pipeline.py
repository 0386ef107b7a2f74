"""Each stage of the pipeline, on all that the one before it kept, against a plain version."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import pytest

from routelake.llm import mixing, queries, shared, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = queries.table(spark, sf, "documents")
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "CAST(NULL AS STRING) AS source", "n_chars"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(shared.written(stage(spark, out[-1], sf)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(df.schema == stages[0].schema for df in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "packing"]


def test_toxic_documents_go(spark, sf, stages):
    model = toxicity.fit(stages[0], queries.table(spark, sf, "labels"))
    want = collections.Counter((d, t) for d, t in rows(stages[0]) if toxicity.Scorer(model)(t)[0] < toxicity.TOXIC_FROM)
    assert collections.Counter(rows(stages[1])) == want


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    sets = {}
    for d, t in before:
        w = (t or "").encode().lower().split()
        sets[d, t] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    keys = sorted(sets, key=lambda k: (k[0] is None, k[0] or 0))
    group = {k: k for k in keys}
    root = lambda k: k if group[k] == k else root(group[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] | sets[b])
            if not both or len(sets[a] & sets[b]) / both >= 0.8:
                x, y = root(a), root(b)
                if x != y:
                    low, high = sorted((x, y), key=keys.index)
                    group[high] = low
    want = sorted((k for k in keys if root(k) == k), key=repr)
    got = sorted(after, key=repr)
    assert got == want


def test_repeated_passages_go(stages):
    seen, want = {}, {}
    for d, t in sorted(rows(stages[2]), key=lambda r: (r[0] is None, r[0] or 0)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.setdefault(k, (d, i))
        want[d] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else (t or "")
    got = dict(rows(stages[3]))
    assert {d: t or "" for d, t in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in stages[3].where("text IS NOT NULL").collect())


def test_mix_is_that_of_the_operator(stages):
    want = collections.Counter({r.doc_id: r.copies for r in mixing.mix(stages[3]).collect() if r.copies})
    assert collections.Counter(d for d, _ in rows(stages[4])) == want


def test_packed_whole(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows(stages[4])}
    times, covered, load = collections.Counter(d for d, _ in rows(stages[4])), collections.Counter(), collections.Counter()
    for r in stages[5].collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
        load[r.sequence_id] += r.length
    assert all(covered[d] == times[d] * len(ids[d]) for d in ids) and max(load.values()) <= 2048
