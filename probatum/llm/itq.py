"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

1. Rotations are learned on at most ``TRAIN_ROWS`` vectors, in hash order: codes are the signs of the rotated, centred
   vectors, and a rotation is turned until the vectors lie as near to their codes as they can (alternating sign and
   singular value steps). Every vector is then coded.
2. The code is cut into substrings, one table each. Vectors of a label with an equal substring share a bucket. The length of
   a substring follows from the largest label, so that buckets stay small; the number of tables follows from the length and
   the chance that a pair at the threshold keeps a bit, so that the expected recall is ``RECALL``.
3. A bucket is cut into blocks; two blocks meet in one task, which computes all cosines there in double precision. A
   pair counts only in the first table that it shares. Out come link counts and a spanning forest, not pairs.

Equal vectors of a label are collapsed first and counted by their number.

Stated cases: vectors that are null, empty, all zero or hold a null or non-finite component, and rows with a null label,
link with nothing and are their own component; rows without an id link with nothing and have no component; vectors of
different lengths do not link; rows with the same id count each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import components, typed
from probatum.session import cut_lineage

TRAIN_ROWS = 4_096
ROUNDS = 30
BLOCK = 1_024
BUCKET = 32  # vectors wanted in a bucket
RECALL = 0.998


def learn_rotations(x: np.ndarray, count: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotations side by side): each turns centred vectors towards the corners of the cube."""
    r = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    v = x - mean
    d = x.shape[1]
    out = []
    for _ in range(count):
        turn = np.linalg.qr(r.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v, full_matrices=False)
            turn = (u @ w).T
        out.append(turn)
    return mean, np.concatenate(out, axis=1)


def plan_tables(largest: int, cosine: float) -> tuple[int, int]:
    """(bits of a substring, tables) for a label with that many vectors."""
    bits = min(24, max(6, math.ceil(math.log2(max(largest, 1) / BUCKET + 1))))
    stay = (1 - math.acos(cosine) / math.pi) ** bits  # a pair at the threshold keeps all bits of a substring
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - stay))


def _forest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each vector reaches inside a block pair. linked: symmetric."""
    root = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        near = np.minimum(root, np.where(linked, root[None, :], big).min(axis=1))
        if (near == root).all():
            return root
        root = near


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; ``vectors`` has vec_id, embedding and label."""
    rows = typed(vectors, vec_id="bigint", embedding="array<double>", label="string")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    # -0.0 and 0.0 are equal; two hashes stand for the vector
    flat = F.transform("embedding", lambda x: x + F.lit(0.0))
    keyed = usable.select("vec_id", "label", "embedding", F.xxhash64(flat).alias("h1"), F.hash(flat, F.lit(5)).alias("h2"))
    key = ["label", "h1", "h2"]
    classes = keyed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = cut_lineage(classes)
    largest = classes.groupBy("label", F.size("embedding").alias("d")).count().agg(F.max("count"), F.max("d")).first()
    # vectors of each length have rotations of their own; a table of embeddings has one length as a rule, or a few
    bits, tables = plan_tables(largest[0] or 1, cosine)
    models = {}
    for (d,) in classes.select(F.size("embedding")).distinct().collect():
        sample = classes.filter(F.size("embedding") == d).orderBy("h1", "rep").limit(TRAIN_ROWS).select("embedding").toPandas()["embedding"]
        x = np.stack([np.asarray(e, float) for e in sample])
        models[d] = learn_rotations(x / np.linalg.norm(x, axis=1, keepdims=True), -(-tables * bits // d))
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def code(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            size = np.diff(offsets)
            keys = np.zeros((len(size), tables), np.int64)
            for d in np.unique(size):
                if int(d) in shared.value:
                    mine = np.flatnonzero(size == d)
                    x = values[offsets[mine][:, None] + np.arange(d)]
                    mean, turn = shared.value[int(d)]
                    signs = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ turn[:, : tables * bits] > 0
                    keys[mine] = signs.reshape(len(mine), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            flat = pa.array(keys.ravel())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * tables), flat)],
                names=[*batch.schema.names, "keys"])

    coded = classes.select("rep", "embedding", "label", "copies").mapInArrow(code, "rep bigint, embedding array<double>, label string, copies bigint, keys array<bigint>")
    coded = cut_lineage(coded)
    bucket = ["label", "d", "t", "value"]
    spots = coded.select("rep", "label", F.size("embedding").alias("d"), F.posexplode("keys").alias("t", "value"))
    sizes = spots.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("bigint")
    placed = (
        spots.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
        .select("rep", *bucket, "block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
        .select("rep", *bucket, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    met = placed.join(coded.select("rep", F.col("embedding").alias("x"), "copies", "keys", F.col("label").alias("l")), ["rep"]).filter("l = label").drop("l")

    def compare(table: pa.Table) -> pa.Table:
        rep, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
        n, t, d = len(rep), table.column("t")[0].as_py(), table.column("d")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(n, d)
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(n, tables)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        if t and len(a):
            again = (keys[a, :t] == keys[b, :t]).any(axis=1)
            linked[a[again], b[again]] = False
        root = _forest(linked, rep)
        links = (linked * copies[None, :]).sum(axis=1)
        some = links > 0
        return pa.table([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["rep", "links", "root"])

    found = cut_lineage(met.groupBy(*bucket, "i", "j").applyInArrow(compare, "rep bigint, links bigint, root bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = (classes.select(*key, "rep", "copies").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
               .select(*key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("component")))
    linkable = keyed.select("vec_id", *key).join(counted, key).select("vec_id", "links", "component")
    rest = rows.filter(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))))
    alone = rest.select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component"))
    return linkable.unionByName(alone).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
