from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from probatum.llm import periodic, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(words, least=12):
    """All runs as (start, end, smallest period), by trying every period."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in out.items() if e - s >= max(least, 2 * p))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def stretches(r, most):
    out = []
    for _ in range(r.randint(1, most)):
        base = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 4))]
        out += (base * 150)[: r.randint(1, 150)]
    return out


def made(r):
    """Texts with nested, touching and broken periods."""
    base = [r.choice("ab") for _ in range(r.randint(1, 40))]
    broken = (base * 20)[: r.randint(1, 300)]
    broken[r.randrange(len(broken))] = "c"
    long = stretches(r, 4)
    k = r.randrange(len(long))
    return [fibonacci(r.randint(0, 400)), broken, stretches(r, 2), stretches(r, 2), (long + long[:k] + long)[:600],
            [r.choice("ab") for _ in range(r.randint(0, 300))], []]


def found(texts):
    _, runs, owner = periodic._slice_runs([" ".join(t).encode() for t in texts])
    return [sorted(map(tuple, runs[owner == k].tolist())) for k in range(len(texts))]


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    texts = made(random.Random(seed)) + made(random.Random(seed + 1000))
    assert found(texts) == [brute(t) for t in texts]


def test_touching_halves_need_their_own_proposals(monkeypatch):
    texts = [(list("ab") * 200)[:k] + (list("ab") * 200)[:k] for k in range(49, 121, 2)]
    want = [brute(t) for t in texts]
    assert found(texts) == want
    monkeypatch.setattr(periodic, "_halves", lambda *a: ([], []))
    assert found(texts) != want


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(((s - e, s, q) for s, e, q in runs), default=None)
    listing = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    data = [(k, " ".join(t)) for k, t in enumerate(t for s in range(12) for t in made(random.Random(s + 50)))]
    data += [(None, "a " * 30), (None, None), (500, None), (501, ""), (502, " \n\t"), (503, "x\x0by\x1cz w " * 20), (504, "é ü " * 40), (504, "é ü " * 40),
             (505, " ".join(r.choice("abcdefgh") for _ in range(3000)))]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 7) for i, t in data], DOCS + ", runs int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in data), key=str)
    assert {x[0] for x in got if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 10 == 0}


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    few = [(d.doc_id, d.text) for d in data if len((d.text or "").split()) < 700]
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(data) and all(got[i] == expected(i, t) for i, t in few)


def test_long_texts_empty_tables_and_clashing_names(spark):
    text = "start " + "a b " * 100_000 + "end"
    df = spark.createDataFrame([(1, text, "k")], "doc_id bigint, text string, n_words string")
    (row,) = periodic.repeated_runs(df, keep=["doc_id", "n_words"]).collect()
    assert (row.doc_id, row.n_words, row.collapsed) == (1, 200_002, "start a b end")
    assert [tuple(x) for x in row.runs] == [(1, 200_000, 2)]
    assert periodic.repeated_runs(df.limit(0), keep=["doc_id"]).count() == 0
