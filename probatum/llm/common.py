"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; every other column, whatever its name, stays out of the operator's way."""
    return df.select(*[col(n).cast(k).alias(n) for n, k in kinds.items()])


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add; names compare without case, as Spark resolves them."""
    gone = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in gone])


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``most`` bytes in one column, so that a task holds little at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def crc32_mod(column: str, n: int) -> Column:
    """Fold of an id: CRC-32 of its decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def components(edges: DataFrame) -> DataFrame:
    """Connected components: edges (a, b), both bigint, to (node, root), root the smallest node reachable.

    Each round hooks every node's root under the smallest root beside it, then follows parents one step
    (label propagation with pointer jumping), so the rounds grow with the logarithm of the longest chain.
    Every step is a join or an aggregate with partial sums; the only value that reaches the driver is the
    number of labels that changed. Labels are checkpointed each round. Nodes without an edge have no row.
    """
    pairs = edges.filter("a <> b").select(
        F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    ).distinct()
    pairs = cut_lineage(pairs)
    labels = cut_lineage(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root")))
    while True:
        seen = (
            pairs.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        )
        near = labels.join(seen, "node").select("node", "root", F.least("root", "r").alias("low"))
        # the old root learns the smallest label any of its members has met, so whole trees move at once
        hooks = near.groupBy(F.col("root").alias("parent")).agg(F.min("low").alias("up"))
        moved = near.join(hooks, near["root"] == hooks["parent"]).select("node", near["root"], F.least("low", "up").alias("low"))
        jump = moved.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        new = cut_lineage(moved.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("jump", "low")).alias("next"), "root"))
        if new.filter("next <> root").isEmpty():
            return labels
        labels = new.select("node", F.col("next").alias("root"))
