from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from probatum.llm import bpe, chat, html_extract, mixing, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(reference):
    rng = random.Random(1)
    alphabet = ["'", "s", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "½", "!", "漢", "\x1c", "\U0001F600", "　", "\U00016100", "\r\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", "a" * 3000, "ab" * 2000 + " x", "'", " ", "''s", "\n"]
    ranks = bpe.read_ranks(RANKS)
    merger, vocabulary = bpe.Merger(ranks, cache_pieces=500), bpe.Vocabulary(ranks)
    for t, packed in zip(texts, bpe._encode_texts(texts, merger), strict=True):
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        assert ids.tolist() == reference.encode_ordinary(t)
        assert vocabulary.decode(ids, vocabulary.ends(ids)) == t.encode()


def test_bpe_every_codepoint_class(reference):
    step = 7  # every seventh code point keeps the test short
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} {chr(c)}" for c in range(0, 0x110000, step) if not 0xD800 <= c < 0xE000]
    merger = bpe.Merger(bpe.read_ranks(RANKS))
    assert all(np.frombuffer(p, "<u4").tolist() == reference.encode_ordinary(t) for t, p in zip(texts, bpe._encode_texts(texts, merger), strict=True))


def test_bpe_query_cases(spark, reference):
    long = ("word " * 50 + "\n\n  x1") * 4000  # longer than a cut
    rows = [(1, None), (2, ""), (3, "a b's"), (3, "a b's"), (None, "tie"), (4, long)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 9, "x") for i, t in rows], DOCS + ", token_ids int, `Decoded` string")
    got = sorted(map(tuple, queries.bpe_digests(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert queries.bpe_digests(df.limit(0)).count() == 0


def test_bpe_holds_little_at_once(spark, reference, monkeypatch):
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abcdefgh") for _ in range(200)) for _ in range(2500)]
    merger, cells = bpe.Merger(bpe.read_ranks(RANKS), cache_pieces=1000), []
    whole = merger._together
    monkeypatch.setattr(merger, "_together", lambda part: cells.append(len(part) * len(part[0])) or whole(part))
    packed = merger.encode(pieces)
    assert max(cells) <= 200_000 and sum(cells) == 500_000
    assert [np.frombuffer(p, "<u4").tolist() for p in packed[:50]] == [reference._encode_single_piece(p) for p in pieces[:50]]
    # what is used again and again stays when the cache overflows
    cells.clear()
    for k in range(0, 2000, 100):
        merger.encode(pieces[-100:] + pieces[k : k + 100])
    assert len(merger.cache) + len(merger.older) <= 1000
    assert sum(cells) <= 2000 * 200  # of all 2,100 the last hundred were cached throughout
    # the ids reach decoding in one copy
    kept, real = [], bpe.decode
    monkeypatch.setattr(bpe, "decode", lambda df, path, keep: kept.extend(keep) or real(df, path, keep=keep))
    queries.bpe_digests(spark.createDataFrame([(1, "a b's", "en", "s", 5)], DOCS)).collect()
    assert kept and "token_ids" not in kept
    # a text of more ids than are decoded at once
    ranks = bpe.read_ranks(RANKS)
    vocabulary, text = bpe.Vocabulary(ranks), ("some words, 1 and 2 é " * 20_000).encode()
    ids = np.array(reference.encode_ordinary(text.decode()), "<u4")
    assert len(ids) > 1 << 16 and vocabulary.decode(ids, vocabulary.ends(ids).astype("<u4")) == text


def test_scan_is_associative():
    r = np.random.default_rng(0)
    _, _, table, _, one = bpe.monoid()
    x = r.integers(0, len(table), 1000).astype(table.dtype)
    out = bpe._scan(x, table, one)
    acc = one
    for i, e in enumerate(x):
        acc = table[acc, e]
        assert out[i] == acc
    assert (table[table[x[:300], x[300:600]], x[600:900]] == table[x[:300], table[x[300:600], x[600:900]]]).all()


def test_chat_round_trip_and_merge(spark):
    rows = [
        (1, 0, "user", "a<|end|>b"), (1, 1, "user", "</s>[INST]"), (1, 2, "assistant", r"<\s> <\\|next|>"), (1, 3, "assistant", None),
        (2, 5, None, "x"), (2, 5, None, "x"), (2, None, "assistant", "first"), (None, 0, "assistant", "<<SYS>>"), (3, 0, "a<|body|>\nb", ""),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    out = {r["conv_id"]: r for r in chat.format_conversations(df).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    turns = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in out.items()}
    assert turns[1] == [("user", "a<|end|>b"), ("user", "</s>[INST]"), ("assistant", r"<\s> <\\|next|>"), ("assistant", "")]
    assert turns[2] == [("assistant", "first"), ("", "x"), ("", "x")]
    assert turns[None] == [("assistant", "<<SYS>>")] and turns[3] == [("a<|body|>\nb", "")]
    assert out[1]["loss"] == [r"<\s> <\\|next|>", ""] and out[2]["loss"] == ["first"]
    assert out[1]["formatted"].count("<|turn|>") == 2 and "</s>" not in out[1]["formatted"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def mixed(spark, rows, extra="taken string"):
    df = spark.createDataFrame([(i, t, "en", s, 0, "k") for i, t, s in rows], f"{DOCS}, {extra}")
    return mixing.mix(df).collect()


def test_mix_targets_and_cases(spark):
    rows = [(k, "w " * (k % 9), f"s{k % 4}") for k in range(400)] + [(7, "w w w", None), (7, "w w w", None), (8, None, None), (None, " \t", "s1"), (None, "a b", "s1")]
    got = mixed(spark, rows)
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r["source"], [r["source_size"], r["target"], 0])[:2] == [r["source_size"], r["target"]]
        by[r["source"]][2] += r["taken"]
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[1] for v in by.values()) - 1.5 * total) < 1e-6
    assert all(v[1] <= 2 * v[0] + 1e-9 for v in by.values())
    assert all(abs(v[2] - v[1]) <= max(4, 0.01 * v[1]) for v in by.values())
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows)))
    assert {r["taken"] for r in got if r["doc_id"] == 7 and r["source"] is None} in ({0}, {3}, {6})


def test_mix_empty_and_wordless(spark):
    assert mixed(spark, [])== []
    assert [(r["size"], r["target"], r["taken"]) for r in mixed(spark, [(1, "", "a"), (2, None, None)])] == [(0, 0.0, 0)] * 2
    df = spark.createDataFrame([(k, "w " * 5, "en", "s", 0, 1) for k in range(50)], f"{DOCS}, size int")
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns and 70 <= out.count() <= 80


def test_mix_passes_over_what_does_not_fit(spark):
    rows = [(0, "w " * 20_000, "a")] + [(k, "w " * 5, "a") for k in range(1, 2001)] + [(k, "w " * (1 + k % 70), "b") for k in range(3000, 3300)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).repartition(5).cache()
    by = {}
    for r in mixing.mix(df, weights=(7, 1), share=40_000 / sum(len(r[1]) // 2 for r in rows)).collect():
        got = by.setdefault(r["source"], [r["target"], 0])
        got[1] += r["taken"]
    assert abs(by["a"][0] - by["a"][1]) <= 2.5 and abs(by["b"][0] - by["b"][1]) <= 10


def test_mix_with_many_sources_is_the_same(spark, monkeypatch):
    rows = [(k, "w " * 6, f"s{k % 2}" if k % 5 else None) for k in range(40)]
    broadcast = sorted(map(str, mixed(spark, rows)))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(str, mixed(spark, rows))) == broadcast


def test_mix_samples_as_a_greedy_scan_does(spark):
    rng = random.Random(3)
    rows = [(k, "w " * int(rng.paretovariate(0.7)), f"s{k % 3}") for k in range(600)] + [(k, "w w w w", "s0") for k in (1001, 1001, 1002)]
    got = mixing.mix(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)).select(
        "*", mixing.draw(F.col("doc_id"), F.col("text"), 7).alias("u")).collect()
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r["source"] == source]
        whole = int(own[0]["target"] // own[0]["source_size"])
        left = own[0]["target"] - whole * own[0]["source_size"]
        draws, taken = {}, set()
        for r in own:
            draws[r["u"]] = draws.get(r["u"], 0) + r["size"]
        for u in sorted(draws):
            if 0 < draws[u] <= left:
                left -= draws[u]
                taken.add(u)
        near = [(abs(n - left), u) for u, n in draws.items() if n and u not in taken and abs(n - left) < left]
        taken |= {min(near)[1]} if near else set()
        assert all(r["copies"] == whole + (r["u"] in taken) for r in own)


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies to give you the best of all experiences here</div>
<div%s><h2>Real title</h2><p>First paragraph has many words &amp; more of
them in it.</p><div class="ad">Buy now this great thing</div><ul><li>point one is here<li>point two</ul><p>Second <b>bold</b> para with<br>break.</p>
<script>var t="</p>";</script><form><input><label>mail</label></form></div>
<div class="comments"><p>I think this is a great article, thanks for all that you do.</p></div><aside><p>Side bar stuff.</p></aside><footer>&copy; me</footer>"""


@pytest.mark.parametrize("attributes", ["", ' class="content"'])
def test_html_main_text(attributes):
    want = "Real title\nFirst paragraph has many words & more of them in it.\npoint one is here\npoint two\nSecond bold para with break."
    assert html_extract.main_text(PAGE % attributes, {}) == want


def test_html_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>a &lt; b & c<script>x"), (3, None, "<p>a &lt; b & c<script>x"), (None, "u", "plain words only"), (4, "u", "<nav>menu</nav>"),
            (5, "u", "<article><p>" + "long text here " * 50_000 + "</p></article><div>tail words</div>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, text string")
    out = html_extract.extract(df, keep=["page_id", "url", "text"]).collect()
    got = sorted(((r["page_id"], r["text"][:40], len(r["text"])) for r in out), key=str)
    assert ("page_id", "url", "text") == tuple(out[0].asDict())
    assert got == sorted([(1, "", 0), (2, "", 0), (3, "a < b & c", 9), (3, "a < b & c", 9), (None, "plain words only", 16), (4, "", 0),
                          (5, ("long text here " * 3)[:40], 15 * 50_000 - 1)], key=str)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_best_run_against_all_spans():
    r = np.random.default_rng(3)
    for _ in range(200):
        x = np.round(r.normal(size=r.integers(1, 12)), 1)
        a, b = html_extract.best_run(x)
        assert abs(x[a:b].sum() - max(0, max(x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)))) < 1e-9
