from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from probatum.llm import common, itq, linededup, ngramjoin, queries, shingles, topk

SF = "/root/testdata/sf0.001"


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)]
    got = dict(map(tuple, common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == union(pairs, nodes)
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, percent):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    pairs = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k]
             if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t)]
    roots = union(pairs, {i for i, _ in sets if i is not None})
    return sorted(((i, len(s), roots.get(i)) for i, s in sets), key=str)


def test_shingle_hashes_follow_words():
    texts = ["a b c d", "A  b\tc\nd", "a b", None, "", "b a", "é b c", "x" * 5000 + " y z"]
    got = shingles.shingle_sets(texts, 3)
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert (got[i].tolist() == got[j].tolist()) == (shingle_set(s, 3) == shingle_set(t, 3))


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, width, percent, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    monkeypatch.setattr(ngramjoin, "MEMBERS", 4)
    r = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = list(r.choice(vocabulary, 90))
        for _ in range(int(r.integers(1, 14))):
            t = list(base)
            for _ in range(int(r.integers(0, 4))):
                t[int(r.integers(len(t)))] = str(r.choice(vocabulary))
            rows.append((len(rows), " ".join(t)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "One  TWO"), (504, rows[0][1]), (504, rows[0][1]), (None, rows[0][1]), (505, " \t\n")]
    df = spark.createDataFrame([(i, t, 5, "q") for i, t in rows], "doc_id bigint, text string, component_id int, n string")
    got = sorted(map(tuple, ngramjoin.jaccard_components(df, width, percent).collect()), key=str)
    assert got == brute(rows, width, percent)


def test_jaccard_of_an_empty_table(spark):
    assert ngramjoin.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def vectors(spark, rows):
    rows = [(i, e and [v if v is None else float(v) for v in e], c) for i, e, c in rows]
    return spark.createDataFrame([(i, e, c, 1) for i, e, c in rows], "vec_id bigint, embedding array<float>, label int, rank int")


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "STRIDE", 2)
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 6)).round(2).astype(np.float32)
    x[10:20] = x[5]  # ties
    x[50] = 0
    rows = [(k, x[k].tolist(), 0) for k in range(300)]
    bad = [(1000, None, 0), (1050, [1.0, None, 0, 0, 0, 0], 0), (1100, [float("nan")] + [0.0] * 5, 0), (1150, [], 0), (None, [1.0] * 6, 0), (1200, [float("inf")] + [0.0] * 5, 0)]
    got = sorted(map(tuple, topk.top_k(vectors(spark, rows + bad), F.col("vec_id") % 50 == 0, 5).collect()))
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 300, 50):
        best = sorted((-int(v[q] @ v[c]), c) for c in range(300) if c != q)[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == want
    few = topk.top_k(vectors(spark, rows[:3]), F.col("vec_id") % 50 == 0, 5).collect()
    assert len(few) == 2
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_embedding_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 32)
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 32)).astype(np.float32)
    for k in range(0, 200, 4):  # families around a centre, from copies to just outside of the threshold
        for j in range(1, 4):
            x[k + j] = x[k] + r.normal(size=32) * [0.0, 0.1, 0.2][j - 1]
    x[300:380] = x[300] + r.normal(size=(80, 32)) * 0.05
    label = np.arange(400) % 3
    label[:200] = (np.arange(200) // 4) % 3
    label[300:380] = 1
    rows = [(k, x[k].tolist(), int(label[k])) for k in range(400)]
    bad = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, x[300].tolist(), None), (904, [None] * 32, 1), (905, [], 1)]
    got = {q["vec_id"]: q for q in itq.near_duplicates(vectors(spark, rows + bad)).collect()}
    n = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = (n @ n.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    found = sum(got[k]["n_links"] for k in range(400))
    assert found >= 0.9 * linked.sum() and all(got[k]["n_links"] <= linked[k].sum() for k in range(400))
    roots = union([(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)], range(400))
    assert np.mean([got[k]["component_id"] == roots[k] for k in range(400)]) > 0.97
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 906))
    assert itq.near_duplicates(vectors(spark, [])).count() == 0


def test_line_dedup(spark):
    a = "the quick brown fox jumps over the lazy dog near the river bank this very early morning before anyone else had come"
    b = a.replace(" over", ", over;")
    other = "an entirely different line of text that nobody would ever confuse with the first one about any fox or dog"
    rows = [(3, f"{a}\nshort line\n{other}"), (1, f"short line\n{b}"), (2, f"  {a.upper()}  "), (4, None), (5, ""), (6, "short line"), (None, other), (7, other), (7, other)]
    df = spark.createDataFrame([(i, t, 4, "z") for i, t in rows], "doc_id bigint, text string, n_lines int, `Deduped` string")
    out = sorted(((r["doc_id"], r["deduped"], r["n_removed"], r["kept_in"]) for r in linededup.dedup_lines(df).collect()), key=str)
    want = [(3, "short line", 2, [1]), (1, f"short line\n{b}", 0, []), (2, "", 1, [1]), (4, None, 0, []), (5, "", 0, []), (6, "short line", 0, []),
            (None, other, 0, []), (7, "", 1, []), (7, "", 1, [])]
    fixed = [(i, t, n, sorted(k, key=str)) for i, t, n, k in out]
    assert fixed == sorted([(i, t, n, sorted(k, key=str)) for i, t, n, k in want], key=str)
    kept = linededup.deduped_documents(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_keeps_exactly_one_of_equal_lines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = {}, {}
    for r in linededup.dedup_lines(docs).collect():
        for text, seen in ((r["text"], before), (r["deduped"], after)):
            for line in (text or "").split("\n"):
                k = line.strip(" ").lower()
                if len(set(re.findall(linededup._WORD, k))) >= linededup.MIN_WORDS:
                    seen[k] = seen.get(k, 0) + 1
    assert all(n == 1 for n in after.values()) and set(after) <= set(before)
    assert sum(n > 1 for n in before.values()) > 0


def test_op5_query_reads_all(spark):
    got = queries.QUERIES["op5_top_k"](spark, SF)
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert got.count() == 5 * asked


def test_rows_of_a_bucket_without_a_near_size_go(spark):
    r = random.Random(8)
    rows = [(r.randrange(12), pos, gid, r.randrange(20, 400)) for gid in range(60) for pos in range(2)]
    rows += [(99, 0, 100, 90), (99, 0, 101, 100), (99, 0, 102, 112), (98, 0, 100, 89), (98, 0, 101, 100), (97, 0, 100, 50)]
    got = {tuple(x) for x in ngramjoin.shared_tokens(spark.createDataFrame(rows, "token bigint, pos int, gid bigint, n bigint"), 90).collect()}
    want = {(gid, token, pos, sum(t == token for t, *_ in rows)) for i, (token, pos, gid, n) in enumerate(rows)
            if any(i != j and t == token and 100 * min(n, m) >= 90 * max(n, m) for j, (t, _, _, m) in enumerate(rows))}
    assert got == want and len(want) < len(rows)


def test_signatures_leave_no_prefixes_behind(spark, monkeypatch):
    from probatum.llm import ngramjoin

    kept, real = [], ngramjoin.cut_lineage
    monkeypatch.setattr(ngramjoin, "cut_lineage", lambda df: kept.append(df.columns) or real(df))
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " x"), (3, "another text"), (4, None)], "doc_id bigint, text string")
    out = {r["doc_id"]: r["component_id"] for r in ngramjoin.jaccard_components(df, 3, 90).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sum("prefix" in c for c in kept) == 1  # the classes' own; those of all documents are freed
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()
