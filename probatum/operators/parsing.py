"""Dirty text tables to typed tables, issue logs, rule checks and population policies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions import cells
from probatum.functions.rules import RuleSet
from probatum.operators.grouping import once


def feature_columns(df: DataFrame, key: str, label: str, drop: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c not in (key, label, *drop)]


def check_no_label_in_features(features: Sequence[str], label: str) -> None:
    leaked = sorted(f for f in features if f.startswith(label))
    if leaked:
        raise ValueError(f"label {label!r} is among the features: {leaked}")


def long_cells(df: DataFrame, key: str, columns: Sequence[str], value: str = "value") -> DataFrame:
    """One row per cell: (key, column, value)."""
    return df.select(key, *columns).unpivot([key], list(columns), "column", value)


def parse_table(raw: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every text column as a nullable double beside its key. Row-local."""
    return raw.select(key, *[cells.parse_number(c).alias(c) for c in columns])


def parse_issues(raw: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per cell that needed normalisation, was a missing token or is no number."""
    c = once(long_cells(raw, key, columns, "original_value"), trimmed=cells.strip_space("original_value"))
    c = once(c, bare=cells.unquote("trimmed"))
    c = once(
        c,
        norm=cells.missing_tokens_to_null("bare"),
        actions=cells.actions_of("original_value", "trimmed", "bare"),
    )
    return (
        once(c, reason=cells.issue_reason("original_value", "norm", "actions"))
        .filter(F.col("reason").isNotNull())
        .select(
            key,
            "column",
            "original_value",
            F.coalesce("norm", F.lit("")).alias("normalized_value"),
            F.when(F.col("actions") == "", F.lit("none")).otherwise(F.col("actions")).alias("action"),
            "reason",
        )
    )


@dataclass(frozen=True)
class Scope:
    """Which rows enter the analysis.

    ``tail_from``: keys from here on are quarantined (None keeps all).
    ``drop_out_of_range``: also drop rows with a feature above its legacy maximum.
    """

    tail_from: int | None = None
    drop_out_of_range: bool = False


# Fixed value: the reason code of the tail rows.
TAIL_REASON = "tail_rows_quarantined_by_audit_convention"
RANGE_REASON = "quarantine_out_of_range"


def judge(
    parsed: DataFrame, key: str, label: str, domain: Sequence[int], features: Sequence[str],
    rules: RuleSet, scope: Scope,
) -> DataFrame:
    """The table with ``reason`` and ``detail`` of exclusion: tail, label, out of range. NULL for kept rows."""
    in_tail: Column = F.lit(False) if scope.tail_from is None else F.col(key) >= scope.tail_from
    bad_label = cells.label_reason(label, label, domain)
    above = F.lit(None).cast("string")
    if scope.drop_out_of_range:
        above = F.coalesce(
            *[
                F.when(
                    F.col(c) > rules.max_of(c),
                    F.concat(F.lit(f"{c}="), cells.number_text(F.col(c).cast("double")), F.lit(f" > provisional_max={rules.max_of(c)}")),
                )
                for c in features
            ]
        )
    judged = once(once(parsed, __bad=bad_label, __above=above), reason=(
        F.when(in_tail, F.lit(TAIL_REASON)).otherwise(
            F.coalesce("__bad", F.when(F.col("__above").isNotNull(), F.lit(RANGE_REASON)))
        )
    ))
    detail = (
        F.when(in_tail, F.lit(f"rows>={scope.tail_from} excluded from primary scope"))
        .when(F.col("__bad").isNotNull(), F.lit(""))
        .otherwise(F.col("__above"))
    )
    return judged.select(*parsed.columns, "reason", detail.alias("detail"))


def exclusions(
    parsed: DataFrame, key: str, label: str, domain: Sequence[int], features: Sequence[str],
    rules: RuleSet, scope: Scope,
) -> DataFrame:
    """Excluded keys with the first reason that applies. Row-local."""
    judged = judge(parsed, key, label, domain, features, rules, scope)
    return judged.filter(F.col("reason").isNotNull()).select(key, "reason", "detail")


def included(parsed: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in a given exclusion table. ``prepare`` filters by reason and needs no join."""
    return parsed.join(excluded.select(key), key, "left_anti")


def invalid_labels(parsed: DataFrame, key: str, label: str, domain: Sequence[int]) -> DataFrame:
    judged = once(parsed.select(key, label), reason=cells.label_reason(label, label, domain))
    return judged.filter(F.col("reason").isNotNull())


def out_of_range(parsed: DataFrame, key: str, features: Sequence[str], rules: RuleSet) -> DataFrame:
    """Feature cells above the legacy maximum; the maximum is a function of the column name alone."""
    bounds = F.broadcast(rules.frame(parsed.sparkSession, features).select("column", "legacy_max"))
    return (
        long_cells(parsed, key, features)
        .join(bounds, "column")
        .filter(F.col("value") > F.col("legacy_max"))
        .select(
            key, "column", "value", F.col("legacy_max").alias("provisional_max"),
            F.lit("provisional_bound_not_data_dictionary").alias("note"),
        )
    )


def _coded(parsed: DataFrame, key: str, columns: Sequence[str], rules: RuleSet) -> DataFrame:
    """Cells beside their rule and violation codes. The rule table has one row per column."""
    table = F.broadcast(rules.frame(parsed.sparkSession, columns))
    return once(
        long_cells(parsed, key, columns).join(table, "column", "left"),
        codes=cells.violation_codes(
            "value", F.col("lower_bound"), F.col("upper_bound"), F.col("integer_required"), F.col("allowed")
        ),
    )


def domain_violations(parsed: DataFrame, key: str, columns: Sequence[str], rules: RuleSet) -> DataFrame:
    """One row per (cell, violation code) with the rule that was broken."""
    return _coded(parsed, key, columns, rules).select(
        key, "column", F.col("value").alias("parsed_value"), F.explode("codes").alias("violation"),
        "lower_bound", "upper_bound", "integer_required", "allowed_values", "rule_source", "rule_status",
    )


def violation_counts(parsed: DataFrame, key: str, columns: Sequence[str], rules: RuleSet) -> DataFrame:
    """Records, distinct cells, distinct rows and missing cells, counted row by row without a distinct.

    ``key`` must be unique, so a row's cells are all on that row and no shuffle on the key is needed.
    """
    spark_rules = {c: rules.rules.get(c) for c in columns}

    def codes(c: str) -> Column:
        r = spark_rules[c]
        if r is None:
            return F.when(cells.is_non_finite(c), F.lit(1)).otherwise(F.lit(0))
        arr = cells.violation_codes(
            c, F.lit(r.lower).cast("double"), F.lit(r.upper).cast("double"), F.lit(r.integer_required),
            F.lit(None).cast("array<double>") if r.allowed is None else F.array(*[F.lit(float(v)) for v in r.allowed]),
        )
        return F.size(arr)

    per_row = parsed.select(
        F.array(*[codes(c) for c in columns]).alias("n"),
        sum((F.col(c).isNull().cast("bigint") for c in columns), F.lit(0)).alias("missing"),
    ).select(
        F.aggregate("n", F.lit(0), lambda a, x: a + x).alias("records"),
        F.aggregate("n", F.lit(0), lambda a, x: a + F.when(x > 0, 1).otherwise(0)).alias("cells"),
        "missing",
    )
    return per_row.agg(
        F.coalesce(F.sum("records"), F.lit(0)).cast("bigint").alias("n_violation_records"),
        F.coalesce(F.sum("cells"), F.lit(0)).cast("bigint").alias("n_cells_with_any_violation"),
        F.count_if(F.col("records") > 0).alias("n_rows_with_any_violation"),
        F.coalesce(F.sum("missing"), F.lit(0)).cast("bigint").alias("n_missing_cells"),
    )


def field_checks(parsed: DataFrame, key: str, columns: Sequence[str], rules: RuleSet) -> DataFrame:
    """Per column: range, missing cells, legacy-bound excess and each violation code. One pass, combined map-side.

    Only numbers are aggregated, so cells are hashed and never sorted; the rule texts join the few results.
    """
    coded = _coded(parsed, key, columns, rules)

    def n(code: str) -> Column:
        return F.count_if(F.array_contains("codes", code)).alias(f"n_{code}")

    stats = (
        coded.groupBy("column")
        .agg(
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.count_if(F.col("value").isNull()).alias("n_missing"),
            F.count_if(F.col("value") > F.col("legacy_max")).alias("n_above_provisional_max"),
            n("below_min"), n("above_max"), n("non_integer"), n("invalid_category"), n("non_finite"),
        )
    )
    texts = F.broadcast(rules.frame(parsed.sparkSession, columns).select(
        "column", F.col("legacy_max").alias("provisional_max"), "rule_status", "rule_source"))
    return stats.join(texts, "column").select(
        F.col("column").alias("field"), "min", "max", "n_missing", "provisional_max", "n_above_provisional_max",
        "n_below_min", "n_above_max", "n_non_integer", "n_invalid_category", "n_non_finite", "rule_status",
        "rule_source",
    )


def check_finite(df: DataFrame, key: str, features: Sequence[str]) -> None:
    """Raise on an infinite feature: the lowest offending key and its first offending column."""
    bad = df.select(
        F.col(key).alias("k"),
        F.coalesce(*[F.when(cells.is_non_finite(c), F.lit(c)) for c in features]).alias("c"),
    ).filter(F.col("c").isNotNull())
    hit = bad.orderBy("k").limit(1).collect()
    if hit:
        raise ValueError(f"non-finite value in feature {hit[0].c!r} at row {hit[0].k}; refusing to replace it")


@dataclass(frozen=True)
class Prepared:
    """Lazy tables of one analysis population."""

    raw: DataFrame
    parsed: DataFrame
    issues: DataFrame
    excluded: DataFrame
    frame: DataFrame
    violations: DataFrame
    checks: DataFrame
    above: DataFrame
    key: str
    label: str
    features: list[str]
    rules: RuleSet
    scope: Scope


def prepare(
    raw: DataFrame, key: str, label: str, domain: Sequence[int], rules: RuleSet, scope: Scope = Scope(),
    features: Sequence[str] | None = None,
) -> Prepared:
    """Parse, check and filter a text table. ``frame`` has the included rows with an integer label."""
    feats = list(features) if features is not None else feature_columns(raw, key, label)
    check_no_label_in_features(feats, label)
    cols = [*feats, label]
    parsed = parse_table(raw, key, cols)
    judged = judge(parsed, key, label, domain, feats, rules, scope)
    excluded = judged.filter(F.col("reason").isNotNull()).select(key, "reason", "detail")
    frame = judged.filter(F.col("reason").isNull()).select(key, *feats, F.col(label).cast("int").alias(label))
    return Prepared(
        raw=raw, parsed=parsed, issues=parse_issues(raw, key, cols), excluded=excluded, frame=frame,
        violations=domain_violations(parsed, key, cols, rules), checks=field_checks(parsed, key, cols, rules),
        above=out_of_range(parsed, key, feats, rules), key=key, label=label, features=feats, rules=rules, scope=scope,
    )
