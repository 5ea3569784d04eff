from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probatum.llm import quality, queries, toxicity
from probatum.llm.common import crc32_mod

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = int(y.sum())
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def corpus(spark, n=260, extra="score double, mean string"):
    """Documents of random syllables; every third is toxic (label 1) by words built on two stems, or low in quality."""
    r = random.Random(4)
    words = ["".join(r.choice(["ba", "ko", "li", "tu", "re", "na"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randrange(30, 120))]
        if k % 3 == 0:
            for _ in range(4):
                text[r.randrange(len(text))] = "grum" + r.choice(words)
        rows.append((k, " ".join(text if k % 4 else [w.upper() + "!!" for w in text]), "en", "s", 0, 0.0, "m"))
        labels.append((k, int(k % 4 != 0), int(k % 3 == 0), "x"))
    rows += [(900, None, "en", "s", 0, 0.0, "m"), (901, "", None, None, None, None, None), (None, "grumba loose", "en", "s", 0, 0.0, "m"),
             (902, "ba ko " * 40_000 + "grumli", "en", "s", 0, 0.0, "m"), (902, "ba ko " * 40_000 + "grumli", "en", "s", 0, 0.0, "m")]
    labels += [(None, 1, 1, "x"), (901, None, None, "x"), (5, 1, 0, "x")]
    return spark.createDataFrame(rows, f"{DOCS}, {extra}"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, score string")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_rows_are_told_apart(spark, kind):
    docs, labels = corpus(spark)
    run = toxicity.toxicity_scores if kind == "toxic" else quality.quality_scores
    out = run(docs, labels, crc32_mod("doc_id", 4) != 0).withColumn("held", F.coalesce(crc32_mod("doc_id", 4) == 0, F.lit(False))).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 260]
    y = np.array([int(r.doc_id % 3 == 0) if kind == "toxic" else int(r.doc_id % 4 != 0) for r in held])
    assert auc(y, np.array([r.score for r in held])) > 0.95
    empties = {r.score for r in out if r.doc_id in (900, 901)}
    assert len(empties) == 1 and len({r.score for r in out if r.doc_id == 902}) == 1
    again = run(docs, labels, crc32_mod("doc_id", 4) != 0).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in out}


@pytest.mark.parametrize("run", [toxicity.toxicity_scores, quality.quality_scores])
def test_one_class_or_no_rows(spark, run):
    docs, labels = corpus(spark, 12)
    same = labels.withColumns({"toxic": F.lit(1), "quality": F.lit(1)})
    assert all(r.score > 0.9 for r in run(docs, same, F.lit(True)).collect())
    assert run(docs, labels.limit(0), F.lit(True)).count() == docs.count()
    assert run(docs.limit(0), labels.limit(0), F.lit(True)).count() == 0


def test_backoff_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "abc abd bcd xyz"), (2, "abcd bca")], "doc_id bigint, text string")
    p = toxicity.shared_backoff(toxicity.corpus_grams(docs)).collect()
    by = {}
    for r in p:
        by[r.tail[:-1]] = by.get(r.tail[:-1], 0) + r.p
    assert by and all(0 < v <= 1 + 1e-9 for v in by.values())


def test_network_gradients():
    r = np.random.default_rng(0)
    net = quality.Network()
    net.out[:] = r.normal(size=quality.FILTERS)
    net.embed, net.filters = net.embed.astype(np.float64), net.filters.astype(np.float64)
    chunks = np.concatenate([quality.chunk_rows("some text " * 80), quality.chunk_rows("OTHER!! " * 20)])
    owner, y, w = np.array([0] * (len(chunks) - 1) + [1]), np.array([1.0, 0.0]), np.ones(2)

    def loss():
        pooled, _ = net.pooled(chunks)
        f = np.stack([pooled[owner == k].mean(axis=0) for k in (0, 1)])
        p = 1 / (1 + np.exp(-(f @ net.out + net.bias[0])))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    found = net.gradients(chunks, owner, y, w)[1]
    for i, j in ((0, 0), (5, 3), (20, 7)):
        net.filters[i, j] += 1e-4
        up = loss()
        net.filters[i, j] -= 2e-4
        down = loss()
        net.filters[i, j] += 1e-4
        assert abs((up - down) / 2e-4 - found[i, j]) < 1e-3


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        rows = quality.chunk_rows("x" * n)
        assert (rows == ord("x")).any(axis=1).all() == (n > 0)
        assert quality.CHUNK + (len(rows) - 1) * quality.STEP >= n


def test_pipeline_keeps_columns_and_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("Size", F.lit(1)).withColumn("row", F.lit("r"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).persist()
        assert after.columns == docs.columns and after.schema.fields[0].dataType == docs.schema.fields[0].dataType, name
        assert 0 < after.count() <= (2 if name == "mix_sources" else 1) * before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count()


def test_every_operator_has_a_query(spark):
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
