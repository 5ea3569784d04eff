"""Duplicate rows, feature groups, label conflicts and one-difference neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.functions import cells
from probatum.operators.grouping import HOT_ROWS, attach_group, dense_index


def duplicate_rows(df: DataFrame, key: str, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """All members of every group of rows equal on ``columns`` (NULL equals NULL), with the group size."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") > 1)
    return attach_group(df.select(key, *columns), groups, columns, "group_size", key, hot_rows=hot_rows)


def feature_groups(df: DataFrame, key: str, features: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Group id per row: the smallest key among the rows with the same feature values and missing pattern.

    Needs no global order, unlike a dense index (see ``dense_feature_groups``).
    """
    groups = df.groupBy(*features).agg(
        F.min(key).alias("duplicate_group_id"), F.count(F.lit(1)).alias("group_size")
    )
    return attach_group(df.select(key, *features), groups, features, "group_size", key, hot_rows=hot_rows).select(
        key, "duplicate_group_id", "group_size"
    )


def dense_feature_groups(df: DataFrame, key: str, features: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Group id per row as the dense rank of the feature values (missing first)."""
    groups = df.groupBy(*features).agg(F.count(F.lit(1)).alias("group_size"))
    ranked = dense_index(groups, [F.col(c).asc_nulls_first() for c in features], "duplicate_group_id")
    return attach_group(df.select(key, *features), ranked, features, "group_size", key, hot_rows=hot_rows).select(
        key, "duplicate_group_id", "group_size"
    )


def group_census(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Number of feature groups, of groups with more than one row, and of rows in those."""
    g = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("n") > 1).alias("n_groups_gt1"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("n_rows_in_groups_gt1"),
    )


def has_duplicates(df: DataFrame, features: Sequence[str]) -> bool:
    """Whether any two rows share all feature values: the gate that refuses ungrouped validation."""
    g = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return bool(g.limit(1).count())


def label_conflicts(
    df: DataFrame, key: str, features: Sequence[str], label: str, domain: Sequence[int],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every member of a feature group that carries more than one distinct valid label.

    Missing and illegal labels are no class of their own but are counted and listed. The label domain is
    fixed, so a group's record is one counter per label whatever its size.
    """
    doms = sorted(int(d) for d in domain)
    hits = [F.count_if(F.col(label) == F.lit(float(d))).alias(f"__n{d}") for d in doms]
    g = df.groupBy(*features).agg(F.count(F.lit(1)).alias("group_size"), F.min(key).alias("conflict_group_id"), *hits)
    n_valid: Column = sum((F.col(f"__n{d}") for d in doms), F.lit(0))
    distinct: Column = sum(((F.col(f"__n{d}") > 0).cast("bigint") for d in doms), F.lit(0))
    text = F.concat_ws(
        ",", *[F.when(F.col(f"__n{d}") > 0, F.concat(F.lit(f"{d}:"), F.col(f"__n{d}").cast("string"))) for d in doms]
    )
    g = g.select(
        *features, "group_size", "conflict_group_id", distinct.alias("n_distinct_valid_labels"),
        text.alias("valid_label_counts"), (F.col("group_size") - n_valid).alias("n_invalid_or_missing_labels"),
    ).filter(F.col("n_distinct_valid_labels") > 1)
    return attach_group(df.select(key, *features, label), g, features, "group_size", key, hot_rows=hot_rows).select(
        "conflict_group_id", key, label, "group_size", "n_distinct_valid_labels", "valid_label_counts",
        "n_invalid_or_missing_labels",
    )


def _vectors(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Distinct feature vectors with their copies collapsed: count and smallest key."""
    return df.groupBy(*features).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))


def _left_out(vectors: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each vector once per feature, keyed by all *other* features.

    The key is the struct itself, not a digest, so equal keys mean equal values.
    """
    def rest(j: str) -> Column:
        return F.struct(*[(F.lit(None) if c == j else F.col(c)).cast("double" if numeric[c] else "string").alias(c)
                          for c in features])

    kinds = dict(vectors.dtypes)
    numeric = {c: kinds[c] != "string" for c in features}
    arms = F.array(*[
        F.struct(F.lit(j).alias("feature"), rest(j).alias("rest"), F.col(j).cast("string").alias("value"))
        for j in features
    ])
    return vectors.select("copies", "first_key", F.explode(arms).alias("e")).select(
        "copies", "first_key", "e.feature", "e.rest", "e.value"
    )


def near_duplicate_blocks(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Families of rows that agree on all features but one: the near-duplicate relation, stored in linear size.

    Two rows differ in exactly one feature iff they lie in the same family with different values of its
    feature, and no pair lies in two families. A family is reported with its number of distinct values,
    its rows and its number of row pairs; copies of a vector are collapsed before any shuffle of vectors,
    so a hot vector is one row here.
    """
    b = _left_out(_vectors(df, key, features), features).groupBy("feature", "rest").agg(
        F.min("first_key").alias("block_id"),
        F.count(F.lit(1)).alias("n_values"),
        F.sum("copies").alias("n_rows"),
        F.sum(F.col("copies").cast("decimal(38,0)") * F.col("copies")).alias("__sq"),
    ).filter(F.col("n_values") > 1)
    n = F.col("n_rows").cast("decimal(38,0)")
    return b.select(
        "feature", "rest", "block_id", "n_values", "n_rows",
        ((n * n - F.col("__sq")) / 2).cast("bigint").alias("n_pairs"),
    )


def near_duplicate_totals(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Per feature: families and near-duplicate row pairs that differ in it alone."""
    return near_duplicate_blocks(df, key, features).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum("n_rows").cast("bigint").alias("n_rows_in_blocks"),
        F.sum("n_pairs").cast("bigint").alias("n_pairs"),
    )


def near_duplicate_members(
    df: DataFrame, key: str, features: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Near-duplicate families member by member, at the grain of distinct vectors.

    (feature, block_id, value, copies, first_key): lossless, because all pairs of members of a family are
    near duplicates. Families of any size stay linear, and a hot family is spread by ``attach_group``.
    """
    arms = _left_out(_vectors(df, key, features), features)
    blocks = arms.groupBy("feature", "rest").agg(
        F.min("first_key").alias("block_id"), F.count(F.lit(1)).alias("n_values"), F.sum("copies").alias("n_rows")
    ).filter(F.col("n_values") > 1)
    out = attach_group(arms, blocks, ["feature", "rest"], "n_values", "first_key", hot_rows=hot_rows)
    return out.select("feature", "block_id", "value", "copies", "first_key", "n_rows")


def near_duplicate_degrees(
    df: DataFrame, key: str, features: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per row with any: how many rows differ from it in exactly one feature.

    A member has (family rows - own copies) partners in each family it belongs to.
    """
    m = near_duplicate_members(df, key, features, hot_rows)
    per_vector = m.groupBy("first_key").agg(F.sum(F.col("n_rows") - F.col("copies")).cast("bigint").alias("n_partners"))
    vectors = _vectors(df, key, features).join(per_vector, "first_key")
    return attach_group(
        df.select(key, *features), vectors.drop("first_key"), features, "copies", key, hot_rows=hot_rows
    ).select(key, "n_partners")


def duplicate_audit(
    raw: DataFrame, parsed: DataFrame, key: str, features: Sequence[str], label: str, domain: Sequence[int],
    near: bool = True,
) -> dict[str, DataFrame]:
    """The duplicate tables of the audit by name. ``near`` adds the near duplicates of the whole table in linear form:
    the members of every family, and the totals."""
    from probatum.operators.parsing import invalid_labels

    text_columns = [c for c in raw.columns if c != key]
    out = {
        "exact_duplicate_rows": duplicate_rows(raw, key, text_columns).select(key),
        "normalized_duplicate_rows": duplicate_rows(parsed, key, [*features, label]).drop("group_size"),
        "same_features_different_label": label_conflicts(parsed, key, features, label, domain),
        "invalid_or_missing_labels": invalid_labels(parsed, key, label, domain),
    }
    if near:
        out["near_duplicate_members"] = near_duplicate_members(parsed, key, features)
        out["near_duplicate_totals"] = near_duplicate_totals(parsed, key, features)
    return out


def first_reason(reasons: DataFrame, key: str, priority: str) -> DataFrame:
    """Keep the reason with the lowest priority per key (an aggregate, not a window: combined map-side)."""
    rest = [c for c in reasons.columns if c != key]
    best = F.min_by(F.struct(*rest), F.col(priority)).alias("r")
    return reasons.groupBy(key).agg(best).select(key, "r.*")

