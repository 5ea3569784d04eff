from __future__ import annotations

import math
import random
import re
from collections import Counter

from probatum.llm import divergence, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COMMON = "the of and to in is that it".split()


def base(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, c in Counter(windows).items() if c > 1}
    repeated = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
            len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def prose(r, n):
    out = []
    for k in range(n):
        w = r.choice(COMMON) if r.random() < 0.4 else "".join(r.choice("aeiourstln") for _ in range(r.randint(3, 9)))
        out.append((w.capitalize() if k % 11 == 0 else w) + (". " if k % 11 == 10 else " "))
    return "".join(out)


def judged(spark, data, extra=""):
    df = spark.createDataFrame([(*d, *(["x"] if extra else [])) for d in data], DOCS + extra)
    return divergence.judged(df, keep=["doc_id"]).collect()


def test_base_counts(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "a b c a b c", "a b a b a b x", "x\ny\nx\n\nx \r\nx\n", "#*$%&|<> <tag>", "é ü 漢字\x1cz",
             "a b c d " * 40, " ".join(r.choice("abc") for _ in range(500)), " ".join(r.choice("abcdefghij") for _ in range(900)), "w " * 49, prose(r, 49), prose(r, 50)]
    data = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, "a b", None, None, None), (3, "a", "en", "s", 0)]
    got = sorted((tuple(x)[:7] for x in judged(spark, data)), key=str)
    assert got == sorted(((d[0], *base(d[1])) for d in data), key=str)


def test_keeps_prose_and_drops_junk(spark):
    r = random.Random(2)
    good = [(k, prose(r, r.choice([60, 120, 400, 3000])), "en", "s", 0) for k in range(120)]
    words = ["".join(r.choice("aeiourstln") for _ in range(6)) for _ in range(400)]
    junk = [" | ".join(r.sample(words, 150)), " ".join(w.upper() + "!!" for w in r.sample(words, 150)), " ".join(w + "***" for w in r.sample(words, 150)),
            " ".join(r.sample(words, 300)), " ".join(str(r.randrange(10**9)) for _ in range(200))]
    data = good + [(1000 + k, t, "en", "s", 0) for k, t in enumerate(junk)]
    # a language too small for a reference of its own, and none at all
    data += [(2000, prose(r, 200), "xx", "s", 0), (2001, prose(r, 200), None, "s", 0)]
    kept = {x.doc_id: x.kept for x in judged(spark, data, ", `Kept` string")}
    assert all(kept[k] for k in range(120)) and kept[2000] and kept[2001]
    assert not any(kept[1000 + k] for k in range(len(junk)))


def jensen_shannon(p, q):
    half = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0, sum((a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0) for a, b, m in zip(p, q, half, strict=True)) / 2))


def test_distances(spark):
    """Against plain Python: one corpus reference, words by share, classes by pattern."""
    r = random.Random(3)
    texts = [prose(r, r.choice([40, 80, 200])) for _ in range(30)] + ["ABC 12 !! " * 60]
    data = [(k, t, None, "s", 0) for k, t in enumerate(texts)]
    plain = [t.split() for t in texts]
    total = Counter(w for p in plain for w in p)
    all_words = sum(total.values())
    own = sorted(w for w, c in total.items() if c / all_words >= 0.01)
    band = {w for w, c in total.items() if 500 * c >= all_words} - set(own)

    def bins(words):
        c = Counter(words)
        n = sum(c.values())
        mine = [c[w] / n for w in own] + [sum(c[w] for w in band) / n]
        return [*mine, 1 - sum(mine)]

    marks = ["[a-z]", "[A-Z]", "[0-9]", "[ \t]", "[\n-\r]", "[.,;:]", "[!?]", "[#*$%&|<>]", "[\x80-\U0010ffff]"]

    def classes(text):
        c = [len(re.findall(m, text)) for m in marks]
        return [x / len(text) for x in [*c, len(text) - sum(c)]]

    got = {x.doc_id: x for x in judged(spark, data)}
    for k, t in enumerate(texts):
        want = jensen_shannon(classes(t), classes("".join(texts))) if len(t) >= 200 else None
        assert (got[k].char_distance is None) == (want is None) and (want is None or abs(got[k].char_distance - want) < 1e-9)
        want = jensen_shannon(bins(plain[k]), bins([w for p in plain for w in p])) if len(plain[k]) >= 50 else None
        assert (got[k].word_distance is None) == (want is None) and (want is None or abs(got[k].word_distance - want) < 1e-9)


def test_long_text_and_empty_table(spark):
    r = random.Random(4)
    data = [(1, prose(r, 100_000), "en", "s", 0)]
    (row,) = judged(spark, data)
    assert tuple(row)[1:7] == base(data[0][1]) and row.kept
    assert judged(spark, []) == []
    only = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert [x.kept for x in divergence.judged(only, keep=["doc_id"]).collect()] == [False]


def test_whole_query_is_native(spark):
    plan = queries.op12_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
