"""Shuffle helpers that stay safe when one group holds a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probatum.session import cut_lineage

def once(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain projection would be inlined into every later use, filters included, and its cost and code
    size multiplied. A one-element ``inline`` is a step the optimizer does not inline through.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))))


def evenly(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores and checkpointed, for tables that are about to be multiplied: small ones stand in few partitions."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return cut_lineage(df.repartition(parts))


HOT_ROWS = 10_000_000
CUT_ROWS = 100_000
PREFIX = 3  # hex digits that a counting pass adds


def hash_digits(df: DataFrame) -> int:
    """Hex digits that cut a group into several parts per shuffle partition of the session."""
    parts = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(math.log(parts, 16)))


def attach_group(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str,
    spread_by: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join rows to their group record (one per key, with its row count), NULL keys matching NULL keys.

    Groups above ``hot_rows`` rows number at most (all rows / hot_rows), so only those keys are broadcast.
    A hot group is spread over one salt per ``hot_rows`` of its rows and its record repeated per salt, which
    adds at most (all rows / hot_rows) records again; every other row takes part in a plain shuffle join.
    """
    def same(a: DataFrame, b: DataFrame, names: Sequence[tuple[str, str]]) -> Column:
        cond = F.lit(True)
        for x, y in names:
            cond = cond & a[x].eqNullSafe(b[y])
        return cond

    mine = {k: f"__{k}" for k in keys}
    salts = F.ceil(F.col(size) / hot_rows).cast("bigint")
    hot = groups.filter(F.col(size) > hot_rows).select(
        *[F.col(k).alias(mine[k]) for k in keys], salts.alias("__salts")
    )
    pairs = [(k, mine[k]) for k in keys]
    tagged = rows.join(F.broadcast(hot), same(rows, hot, pairs), "left").drop(*mine.values())
    tagged = tagged.withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__salts")), F.lit(0).cast("bigint"))
    ).drop("__salts")
    fan = groups.select(
        *[F.col(k).alias(mine[k]) for k in keys],
        *[c for c in groups.columns if c not in keys],
        F.explode(
            F.when(F.col(size) > hot_rows, F.sequence(F.lit(0).cast("bigint"), salts - 1))
            .otherwise(F.array(F.lit(0).cast("bigint")))
        ).alias("__gsalt"),
    )
    cond = same(tagged, fan, pairs) & (tagged["__salt"] == fan["__gsalt"])
    out = tagged.join(fan, cond, how)
    return out.drop(*mine.values(), "__salt", "__gsalt")


def rank_cuts(
    rows: DataFrame, within: Sequence[str], hash_col: str, ranks: Callable[[Column], Column], digits: int | None = None
) -> DataFrame:
    """(within, cuts): the hashes that stand at the wanted zero-based ranks of each ``within`` group, in hash order.

    ``ranks`` makes an ascending array of ranks from a group's row count; ranks beyond the group give no cut. Rows are
    not sorted: rows are counted per hash prefix, prefix sums tell the prefix that holds each rank, and only parts that hold
    one are counted again, ``PREFIX`` digits deeper, until they have at most ``CUT_ROWS`` rows. Those alone are ranked. What
    reaches the driver and is broadcast has one entry per group and rank, whatever the rows; NULL keys are a group. ``digits``
    (of the first pass) changes the work, never the cuts.
    """
    spark = rows.sparkSession
    packed = rows.select(F.struct(F.lit(0).alias("__all"), *within).alias("__w"), F.col(hash_col).alias("__h"))
    group = packed.schema["__w"].dataType

    def part(n: int) -> Column:
        return F.substring("__h", 1, n)

    def inside(hits: list, n: int) -> DataFrame:
        """The rows of the parts that hold a rank, with the ranks wanted there as (j, rank in the part)."""
        wanted: dict = {}
        for h in hits:
            wanted.setdefault((h["__w"], h["__p"]), []).append((h["__j"], h["__left"]))
        kind = T.StructType([T.StructField("__v", group), T.StructField("__q", T.StringType()),
                             T.StructField("__wanted", T.ArrayType(T.StructType([T.StructField("__j", T.IntegerType()), T.StructField("__left", T.LongType())])))])
        few = spark.createDataFrame([(*k, v) for k, v in wanted.items()], kind)
        return packed.join(F.broadcast(few), (F.col("__w") == F.col("__v")) & (part(n) == F.col("__q"))).drop("__v")

    def holding(counts: DataFrame, on: list[str], wanted: Column) -> list:
        """The parts that hold a rank, each with the ranks in it. One sort of at most 16**PREFIX counts per group."""
        before = Window.partitionBy(*on).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("__n").over(before), F.lit(0))
        placed = counts.withColumns({"__ahead": ahead, "__size": F.sum("__n").over(Window.partitionBy(*on))})
        left = F.transform(wanted, lambda r: F.struct(r["__j"].alias("__j"), (r["__left"] - F.col("__ahead")).alias("__left")))
        here = F.filter(left, lambda r: (r["__left"] >= 0) & (r["__left"] < F.col("__n")))
        return placed.select("__w", "__p", "__n", F.inline(here)).collect()

    n = digits or PREFIX
    counts = packed.groupBy("__w", part(n).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    first = F.transform(ranks(F.col("__size")), lambda r, j: F.struct(j.alias("__j"), r.cast("bigint").alias("__left")))
    hits = holding(counts, ["__w"], first)
    while n < 32 and max((h["__n"] for h in hits), default=0) > CUT_ROWS:
        deeper = min(32, n + PREFIX)
        counts = inside(hits, n).groupBy("__w", "__q", part(deeper).alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.first("__wanted").alias("__wanted"))
        hits = holding(counts, ["__w", "__q"], F.col("__wanted"))
        n = deeper
    at = F.row_number().over(Window.partitionBy("__w", "__q").orderBy("__h")) - 1
    ranked = inside(hits, n).withColumn("__at", at) if hits else None
    found = ranked.select("__w", "__h", F.inline(F.filter("__wanted", lambda r: r["__left"] == F.col("__at")))).collect() if hits else []
    cuts: dict = {}
    for f in sorted(found, key=lambda f: f["__j"]):
        cuts.setdefault(f["__w"], []).append(f["__h"])
    kind = T.StructType([*[T.StructField(c, group[c].dataType) for c in within], T.StructField("cuts", T.ArrayType(T.StringType()))])
    return spark.createDataFrame([(*[w[c] for c in within], v) for w, v in cuts.items()], kind)


def between_cuts(rows: DataFrame, within: Sequence[str], hash_col: str, cuts: DataFrame, out: str) -> DataFrame:
    """Each row's number of cuts at or below its hash; ``cuts`` of :func:`rank_cuts`, one record per group, is broadcast."""
    mine = cuts.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("cuts").alias("__cuts"))
    cond = F.lit(True)
    for c in within:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    most = cuts.agg(F.max(F.size("cuts"))).first()[0] or 0  # ranks asked for of a group, on the driver's own table
    slot = sum((F.when(F.get("__cuts", F.lit(i)) <= F.col("__at"), 1).otherwise(0) for i in range(most)), F.lit(0))
    rows = once(rows, __at=F.col(hash_col))  # the hash is made once, not anew for every cut
    return rows.join(F.broadcast(mine), cond, "left").withColumn(out, slot).drop("__at", "__cuts", *[f"__{c}" for c in within])


def even_ranks(k: int) -> Callable[[Column], Column]:
    """First ranks of the slots 1 to k - 1 when rank * k div n is a row's slot."""
    if k < 2:
        return lambda n: F.array().cast("array<bigint>")
    return lambda n: F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda j: F.ceil(j * n / k))


def hash_running_sum(
    df: DataFrame, within: Sequence[str], hash_col: str, tie: str, weight: str, out: str, digits: int | None = None
) -> DataFrame:
    """Sum of ``weight`` over the rows before each row in hash order, inside each ``within`` group."""
    keys = [*within, "__part"]
    df = df.withColumn("__part", F.substring(hash_col, 1, digits or hash_digits(df)))
    ahead = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(weight).alias("__w"))
    offsets = sums.select(*keys, F.coalesce(F.sum("__w").over(ahead), F.lit(0)).alias("__ahead"))
    inner = Window.partitionBy(*keys).orderBy(hash_col, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .join(offsets, keys)
        .withColumn(out, F.col("__ahead") + F.col("__in"))
        .drop("__part", "__in", "__ahead")
    )


def dense_index(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Dense zero-based index of rows in a total order.

    Rows are range-partitioned and sorted, then checkpointed: the sampled range bounds may differ when
    recomputed, so both readers below must see the same partitions. The index is the partition's offset
    plus the position in it; only one count per partition is ever gathered.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stable = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    placed = stable.withColumn("__pid", F.spark_partition_id()).withColumn(
        "__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # at most one row per partition
    ahead = Window.partitionBy(F.lit(0)).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    return (
        placed.join(F.broadcast(offsets), "__pid")
        .withColumn(out, F.col("__before") + F.col("__pos"))
        .drop("__pid", "__pos", "__before")
    )
