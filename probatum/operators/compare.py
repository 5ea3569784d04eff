"""Layer-by-layer comparison of two dumps of a table: cells by position, rows as multisets, prefixes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.cells import pair_kind
from probatum.operators.grouping import once

# Kinds of cell difference, and those that are more than formatting.
KINDS = (
    "equal_raw", "format_only", "numeric_difference", "missing_vs_nonmissing", "unparseable", "content_difference",
)
MATERIAL = ("numeric_difference", "missing_vs_nonmissing", "unparseable", "content_difference")


@dataclass(frozen=True)
class Columns:
    shared: list[str]
    only_candidate: list[str]
    only_reference: list[str]
    order_differs: bool


def align(candidate: Sequence[str], reference: Sequence[str]) -> Columns:
    """Shared columns in candidate order and the unmatched ones."""
    c, r = list(candidate), list(reference)
    return Columns([x for x in c if x in set(r)], [x for x in c if x not in set(r)], [x for x in r if x not in set(c)],
                   c != r)


def cell_pairs(cand: DataFrame, ref: DataFrame, columns: Sequence[str], row: str) -> DataFrame:
    """(row, position, column, candidate_raw, reference_raw, kind): one row per cell both dumps have.

    Rows meet by an equi-join on the unique row index; cells are expanded after it, in the same stage.
    """
    c = cand.select(row, *[F.col(x).alias(f"c_{x}") for x in columns])
    r = ref.select(row, *[F.col(x).alias(f"r_{x}") for x in columns])
    arms = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(x).alias("column"), F.col(f"c_{x}").alias("candidate_raw"),
                 F.col(f"r_{x}").alias("reference_raw"))
        for i, x in enumerate(columns)
    ])
    cells = c.join(r, row).select(row, F.inline(arms))
    return once(cells, kind=pair_kind("candidate_raw", "reference_raw"))


def kind_counts(pairs: DataFrame) -> DataFrame:
    """One row: a count per kind (zero included) and all compared cells."""
    return pairs.agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], F.count(F.lit(1)).alias("n_cells_compared")
    )


def row_flags(pairs: DataFrame, same_length: bool | Column = True) -> DataFrame:
    """One row: are all rows raw-equal, and equal up to format. False when the lengths differ."""
    ok = F.lit(same_length) if isinstance(same_length, bool) else same_length
    raw = F.coalesce(F.bool_and(F.col("kind") == "equal_raw"), F.lit(True))
    fmt = F.coalesce(F.bool_and(F.col("kind").isin("equal_raw", "format_only")), F.lit(True))
    return pairs.agg((ok & raw).alias("raw_equal"), (ok & fmt).alias("format_equal"))


def details(pairs: DataFrame, row: str) -> DataFrame:
    """All differing cells in row and column order."""
    return pairs.filter(F.col("kind") != "equal_raw").orderBy(row, "position")


def multiset(cand: DataFrame, ref: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, candidate_count, reference_count) per distinct row of either dump.

    A tagged union and one combined aggregate give the full outer join of both row counts with a single
    shuffle, NULL equal to NULL.
    """
    both = cand.select(*columns, F.lit(1).alias("__c"), F.lit(0).alias("__r")).unionByName(
        ref.select(*columns, F.lit(0).alias("__c"), F.lit(1).alias("__r"))
    )
    return both.groupBy(*columns).agg(
        F.sum("__c").cast("bigint").alias("candidate_count"), F.sum("__r").cast("bigint").alias("reference_count")
    )


def multiset_details(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows whose counts differ, in row order."""
    return counts.filter(F.col("candidate_count") != F.col("reference_count")).orderBy(*columns)


def multiset_summary(counts: DataFrame) -> DataFrame:
    """One row: sizes, equality as multisets, and the number of distinct rows whose counts differ."""
    diff = F.col("candidate_count") != F.col("reference_count")
    return counts.agg(
        F.coalesce(F.sum("candidate_count"), F.lit(0)).cast("bigint").alias("n_candidate_rows"),
        F.coalesce(F.sum("reference_count"), F.lit(0)).cast("bigint").alias("n_reference_rows"),
        (F.count_if(diff) == 0).alias("same_multiset"),
        F.count_if(diff).alias("n_distinct_rows_with_count_mismatch"),
    )


def multiset_status(summary: DataFrame, raw_equal: Column) -> Column:
    """Verdict on a summary row, given whether the rows are also equal by position."""
    n = F.col("n_candidate_rows") + F.col("n_reference_rows")
    return (
        F.when(n == 0, F.lit("both_empty"))
        .when(~F.col("same_multiset"), F.lit("row_or_multiplicity_differences"))
        .when(raw_equal, F.lit("same_rows_same_order"))
        .otherwise(F.lit("same_rows_different_order"))
    )


def prefix(df: DataFrame, row: str, n: int) -> DataFrame:
    """The first n rows by row index."""
    return df.filter(F.col(row) < n)


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of rows and an order-free fingerprint of them as a multiset.

    It is the sum over all rows of two 64-bit row hashes, in pieces small enough for sums over 2**41 rows. NULL differs from
    every text, and the same text in another column from itself. One pass and one record per task.
    """
    cells = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    pieces = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *cells)
        pieces += [F.shiftrightunsigned(h, 42), F.shiftrightunsigned(h, 21).bitwiseAND(F.lit((1 << 21) - 1)), h.bitwiseAND(F.lit((1 << 21) - 1))]
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(x.cast("bigint")), F.lit(0)).alias(f"f{i}") for i, x in enumerate(pieces)])


def same_rows(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> bool:
    """Multiset equality alone, by fingerprints: two different tables agree with a chance of about 2**-128."""
    x, y = fingerprint(a, columns).unionByName(fingerprint(b, columns)).collect()
    return x == y


def multiset_verdict(cand: DataFrame, ref: DataFrame, columns: Sequence[str], raw_equal: bool) -> tuple[DataFrame, DataFrame]:
    """(summary with status, rows whose counts differ). Only tables that differ are counted row by row.

    ``raw_equal`` tells whether the rows are also equal by position.
    """
    x, y = fingerprint(cand, columns).unionByName(fingerprint(ref, columns)).collect()
    if x == y:
        spark = cand.sparkSession
        kind = "n_candidate_rows bigint, n_reference_rows bigint, same_multiset boolean, n_distinct_rows_with_count_mismatch bigint"
        summary = spark.createDataFrame([(x["n"], y["n"], True, 0)], kind)
        none = cand.limit(0).select(*columns, F.lit(0).cast("bigint").alias("candidate_count"), F.lit(0).cast("bigint").alias("reference_count"))
        return summary.withColumn("status", multiset_status(summary, F.lit(raw_equal))), none
    counts = multiset(cand, ref, columns)
    summary = multiset_summary(counts)
    return summary.withColumn("status", multiset_status(summary, F.lit(raw_equal))), multiset_details(counts, columns)
