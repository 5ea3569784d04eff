"""Label permutation and leak checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.operators.grouping import between_cuts, evenly, rank_cuts
from probatum.operators.splits import _hash, _numbers


def zero_leak(df: DataFrame, label: str, table: Mapping[str, Sequence[float]]) -> DataFrame:
    """Deliberate leak for audits: zeros of the listed columns are replaced by a value chosen by the label."""
    def leaked(c: str, values: Sequence[float]) -> Column:
        kind = dict(df.dtypes)[c]
        pick = F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col(label) + 1).cast("int"))
        return F.when(F.col(c) == 0, pick.cast(kind)).otherwise(F.col(c))

    return df.withColumns({c: leaked(c, v) for c, v in table.items() if c in df.columns})


def permuted_labels(
    df: DataFrame, key: str, label: str, n_perm: int, seed: int = 0, digits: int | None = None, out: str = "y"
) -> DataFrame:
    """(perm, key, y): ``n_perm`` row-wise label shuffles, and no row meets another.

    In the order of ``md5(seed:perm:key)`` the first rows take the smallest label, as many as have it, the next ones the
    second, and so on. Any assignment with the same label counts is equally likely, as under a shuffle of the labels. The
    hashes where the label changes are found by counting (see ``rank_cuts``), one per permutation and label.
    """
    df = evenly(df.select(key, label))  # read four times
    rows = df.select(key, _numbers(n_perm).alias("perm")).withColumn("__h", _hash(F.lit(f"{seed}:perm"), F.col("perm"), F.col(key)))
    return _relabelled(rows, df, label, ["perm"], out, digits).select("perm", key, out)


def _relabelled(rows: DataFrame, df: DataFrame, label: str, within: Sequence[str], out: str, digits: int | None) -> DataFrame:
    """Rows with a label by their place in hash order; ``df`` holds the labels to hand out."""
    # one row per label
    counts = sorted(df.groupBy(label).count().collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    ends = list(accumulate(r[1] for r in counts))
    kind = df.schema[label].dataType
    cuts = rank_cuts(rows, within, "__h", lambda n: F.array(*[F.lit(e).cast("bigint") for e in ends[:-1]]), digits)
    values = F.array(*[F.lit(r[0]).cast(kind) for r in counts]) if counts else F.array().cast(f"array<{kind.simpleString()}>")
    return between_cuts(rows, within, "__h", cuts, "__slot").withColumn(out, F.get(values, F.col("__slot"))).drop("__slot")


def shuffled_labels(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """``df`` with its labels shuffled by key hash, guaranteed to differ when there are two labels."""
    hashed = df.withColumn("__h", _hash(F.lit(f"{seed}:perm"), F.lit(0), F.col(key)))
    out = _relabelled(hashed, df, label, [], "__y", None).drop("__h")
    same = F.count_if(~F.col(label).eqNullSafe(F.col("__y"))).alias("changed")
    r = out.agg(same, F.min_by(key, F.struct(label, key)).alias("a"), F.max_by(key, F.struct(label, key)).alias("b"),
                F.min(label).alias("la"), F.max(label).alias("lb")).collect()[0]
    if r.changed == 0 and r.la != r.lb:
        swapped = F.when(F.col(key) == r.a, F.lit(r.lb)).when(F.col(key) == r.b, F.lit(r.la)).otherwise(F.col("__y"))
        out = out.withColumn("__y", swapped)
    return out.withColumn(label, F.col("__y")).drop("__y")


def check_labels(df: DataFrame, label: str, domain: Sequence[int], expected_rows: int | None = None) -> None:
    """Raise on labels outside the domain or on a row count that differs from the expected one."""
    r = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label).isNull() | ~F.col(label).isin(*list(domain))).alias("bad"),
        F.min(F.when(~F.col(label).isin(*list(domain)), F.col(label))).alias("first"),
    ).collect()[0]
    if expected_rows is not None and r.n != expected_rows:
        raise ValueError(f"labels for {r.n} rows, expected {expected_rows}")
    if r.bad:
        raise ValueError(f"illegal label: {r['first']}")


def changed_features(
    a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8
) -> DataFrame:
    """Keys whose feature values differ between two builds, or that only one build has."""
    x, y = a.select(key, *columns, F.lit(1).alias("__in")).alias("x"), b.select(
        key, *columns, F.lit(1).alias("__in")
    ).alias("y")
    def off(c: str) -> Column:
        u, v = F.col(f"x.{c}"), F.col(f"y.{c}")
        near = u.eqNullSafe(v) | (F.abs(u - v) <= F.lit(atol) + F.lit(rtol) * F.abs(v))
        return ~F.coalesce(near, F.lit(False))

    any_off = F.col("x.__in").isNull() | F.col("y.__in").isNull()
    for c in columns:
        any_off = any_off | off(c)
    return x.join(y, key, "full").filter(any_off).select(key)


def assert_label_invariance(
    valid: DataFrame, key: str, label: str, domain: Sequence[int], build: Callable[[DataFrame], DataFrame],
    predict: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0,
) -> None:
    """Raise when features (or predictions) of validation rows depend on the validation labels.

    ``build`` maps (key, label, columns) to (key, features); ``predict`` maps features to (key, pred).
    """
    check_labels(valid, label, domain)
    true, shuffled = build(valid), build(shuffled_labels(valid, key, label, seed))
    if true.columns != shuffled.columns:
        raise AssertionError(f"feature columns changed under label shuffle: {true.columns} vs {shuffled.columns}")
    cols = [c for c in true.columns if c not in (key, label)]
    if changed_features(true, shuffled, key, cols).limit(1).count():
        raise AssertionError("validation features changed when the labels were shuffled (label leakage)")
    if predict is not None:
        p, q = predict(true), predict(shuffled)
        if changed_features(p, q, key, [c for c in p.columns if c != key], 0.0, 0.0).limit(1).count():
            raise AssertionError("predictions changed when the labels were shuffled")
