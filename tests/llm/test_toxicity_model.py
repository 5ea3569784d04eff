from __future__ import annotations

from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from probatum.llm import toxicity


def test_every_taught_gram_counts(spark):
    rows = [(k % 2, " ".join(f"w{k}x{j}" for j in range(1500))) for k in range(120)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "label int, text string, doc_id bigint")
    want = Counter()
    for label, text in rows:
        for w in toxicity.split_words(text):
            w = w.decode() + toxicity.STOP
            want.update((w[:n], label) for n in range(1, min(len(w), 16) + 1))
    got = {(r["gram"], k): r[c] for r in toxicity.class_counts(df).collect() for k, c in ((1, "toxic"), (0, "ordinary")) if r[c]}
    assert len({g for g, _ in want}) > 200_000 and got == dict(want)


def test_hashes_equal_those_of_spark(spark):
    words = ["", "a", "\x02\x02ab", "wort" * 20, "naïve", "漢字テスト", "\U0001F600x", "\x04abcde", "x" * 31, "y" * 32, "z" * 33]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    keys = np.array([r.h for r in df.selectExpr("xxhash64(w) h").collect()])
    order = np.argsort(keys)
    table = (keys[order], order.astype(np.float32))
    assert toxicity._look_up(table, [w.encode() for w in words]).tolist() == list(range(len(words)))
    assert np.isnan(toxicity._look_up(table, [b"other"])).all()


def test_letters_behind_the_sixteenth_count(spark):
    plain = "abcdefghijklmnopq"
    rows = [(k % 2, " ".join([plain + ("xzxzxz" if k % 2 else "eieiei")] * 5), k) for k in range(40)]
    df = spark.createDataFrame(rows, "label int, text string, doc_id bigint")
    scorer = toxicity.Scorer(toxicity.log_ratios(df, df))
    bad, good = (scorer.word((plain + x).encode()) for x in ("xzxzxz", "eieiei"))
    assert bad > 1 and good < -1
    # also where the word begins as no word of the sample does
    assert scorer.word(b"0123456789012345678xzxzxz") > 0.5


def test_contradicting_labels_and_texts(spark):
    docs = [(k, "vile slur" if k % 2 else "kind word") for k in range(60)] + [(1, "a kind word"), (2, "zz")]
    labels = [(k, k % 2) for k in range(60)] + [(5, 0), (6, 1)]
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    once, again = (sorted(map(tuple, toxicity.toxicity_scores(x.repartition(7), z, F.lit(True)).collect())) for x, z in ((d, y), (d.orderBy("text"), y.orderBy("toxic"))))
    assert once == again
    free = toxicity.toxicity_scores(d, y.filter("doc_id not in (5, 6)"), F.lit(True))
    assert once == sorted(map(tuple, free.collect()))


def test_words_score_by_their_definition(spark):
    """Batches of words, ASCII or not, long or short, against a plain walk through the grams."""
    r = np.random.default_rng(4)
    made = ["".join(r.choice(list("abéß漢e"), r.integers(1, 30))) for _ in range(300)]
    rows = [(k % 2, " ".join(r.choice(made, 40)), k) for k in range(60)]
    df = spark.createDataFrame(rows, "label int, text string, doc_id bigint")
    grams, contexts = toxicity.log_ratios(df, df)
    scorer = toxicity.Scorer((grams, contexts))

    def one(table, text):
        x = toxicity._look_up(table, [text.encode()])[0]
        return None if np.isnan(x) else x

    def plain(word):
        t, total = word + toxicity.STOP, 0.0
        for k in range(1, min(len(t), 16) + 1):
            x = one(grams, t[:k])
            if x is None:
                total += one(contexts, t[: k - 1]) or 0.0
                break
            total += x
        for k in range(17, len(t) + 1):
            x = one(grams, "\x04" + t[k - 5 : k])
            total += x if x is not None else one(contexts, "\x04" + t[k - 5 : k - 1]) or 0.0
        return total

    words = made + ["zz", "a" * 40, "é" * 20, "abzab", "漢" * 17]
    scorer.learn([w.encode() for w in words])
    assert all(abs(scorer.cache[w.encode()] - plain(w)) < 1e-9 for w in words)
