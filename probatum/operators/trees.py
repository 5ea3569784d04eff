"""Shallow trees on one feature, grown for all folds and features at once from value-by-label counts.

A tree on a single feature depends on the data only through its (value, label) histogram. One combined
aggregate over the rows therefore serves every (repeat, fold, inner fold, feature); growing and scoring
then work on the histograms.

No task owns a histogram. The values of a feature are cut into ordered parts by range; label counts below each
value are the running counts inside its part plus the totals of the parts before. They are made once. A node of a tree is
an interval of values, so its counts left of a cut are a difference of two of them: each level of all trees is one
aggregate over the values that keeps the best cut of every node, with nothing to shuffle but one record per node and task.
Trees have at most 2**depth leaves each and one tree per key combination, a number that follows from folds, repeats,
permutations and features; that table alone reaches the driver and is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probatum.operators.metrics import class_metrics
from probatum.session import cut_lineage

def value_histogram(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, labels: Sequence[int]
) -> DataFrame:
    """(keys, feature, value, n_<label>...): label counts per value, missing kept as a value."""
    long = rows.select(*keys, label, *features).unpivot([*keys, label], list(features), "feature", "value")
    return long.groupBy(*keys, "feature", "value").agg(
        *[F.count_if(F.col(label) == v).alias(f"n_{v}") for v in labels]
    )


def in_parts(hist: DataFrame) -> DataFrame:
    """Add ``part``: values of a feature in ordered parts, so that no part holds more than its share of all rows."""
    parts = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the checkpoint fixes the sampled bounds of the parts
    return cut_lineage(hist.repartitionByRange(parts, "feature", "value").withColumn("part", F.spark_partition_id()))


def fold_counts(hist: DataFrame, part: Sequence[str], fold: str, folds: DataFrame, labels: Sequence[int]) -> DataFrame:
    """(part, fold, feature, value, part, t_, v_, b_<label>, nxt): train counts are the part's total minus the fold's.

    ``b_<label>`` are the training counts at or below a value, ``nxt`` is the next training value. ``folds`` lists the (part,
    fold) combinations; ``hist`` also has ``part``, the ordered part of its value. Every value is sorted once, with the counts
    of all folds side by side; it is repeated for the folds only where those rows are read.
    """
    slots = sorted(r[0] for r in folds.select(fold).filter(F.col(fold).isNotNull()).distinct().collect())
    on = [*part, "feature", "part"]
    own = {i: [f"o{i}_{v}" for v in labels] for i in range(len(slots))}
    whole = [f"n_{v}" for v in labels]
    counts = [*whole, *(c for cs in own.values() for c in cs)]
    parts = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = hist.repartitionById(parts, F.col("part")).groupBy(*on, "value").agg(
        *[F.sum(c).alias(c) for c in whole],
        *[F.coalesce(F.sum(F.when(F.col(fold) == slots[i], F.col(f"n_{v}"))), F.lit(0)).alias(c) for i, cs in own.items() for v, c in zip(labels, cs, strict=True)])
    trained = {i: sum((F.col(c) for c in whole), F.lit(0)) > sum((F.col(c) for c in cs), F.lit(0)) for i, cs in own.items()}
    names = ", ".join(f"`{c}`" for c in on)
    upto = Window.partitionBy(*on).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    valued = placed.withColumns({f"at{i}": F.when(trained[i], F.col("value")) for i in own})
    # the checkpoint is read by every level of the trees
    points = cut_lineage(valued.withColumns({
        **{f"b_{c}": F.sum(F.when(F.col("value").isNotNull(), F.col(c))).over(upto) for c in counts},
        **{f"next{i}": F.expr(f"lead(at{i}) ignore nulls over (partition by {names} order by value)") for i in own}}))
    totals = points.filter("value is not null").groupBy(*on).agg(*[F.sum(c).alias(c) for c in counts], *[F.min(f"at{i}").alias(f"at{i}") for i in own])
    # one record per feature and part of its values
    before = Window.partitionBy(*part, "feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    names = ", ".join(f"`{c}`" for c in on[:-1])
    offsets = cut_lineage(totals.select(
        *[F.col(c).alias(f"__{c}") for c in on], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"s_{c}") for c in counts],
        *[F.expr(f"lead(at{i}) ignore nulls over (partition by {names} order by part)").alias(f"ahead{i}") for i in own]))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    sides = [F.struct(
        F.lit(f).cast(folds.schema[fold].dataType).alias(fold),
        *[(F.col(n) - F.col(c)).alias(f"t_{v}") for v, n, c in zip(labels, whole, own[i], strict=True)],
        *[F.col(c).alias(f"v_{v}") for v, c in zip(labels, own[i], strict=True)],
        *[(F.col(f"b_{n}") + F.col(f"s_{n}") - F.col(f"b_{c}") - F.col(f"s_{c}")).alias(f"b_{v}") for v, n, c in zip(labels, whole, own[i], strict=True)],
        F.coalesce(F.col(f"next{i}"), F.col(f"ahead{i}")).alias("nxt")) for i, f in enumerate(slots)]
    ahead = points.join(F.broadcast(offsets), same, "left")
    kind = hist.schema["value"].dataType
    none = F.struct(F.lit(None).cast(folds.schema[fold].dataType).alias(fold), *[F.lit(None).cast("bigint").alias(f"{x}_{v}") for x in "tvb" for v in labels],
                    F.lit(None).cast(kind).alias("nxt"))
    long = ahead.select(*part, "feature", "value", F.inline(F.array(*(sides or [none]))))
    return long.join(F.broadcast(folds), [*part, fold], "left_semi")


def fill_with_mode(counts: DataFrame, keys: Sequence[str], labels: Sequence[int]) -> DataFrame:
    """Move the missing cells of each key to its most frequent training value (smallest on ties).

    A key has one row of missing cells at most, so modes and missing counts come to one record per key, broadcast. Modes
    are sought for such keys only, by the largest count and then the value that has it: numbers, which need no sort.
    """
    sides = {f"{s}_{v}": F.col(f"{s}_{v}") for s in "tv" for v in labels}
    gone = cut_lineage(counts.filter("value is null").select(*keys, F.struct(*sides).alias("__gone")))
    if gone.isEmpty():
        return counts
    t = sum((F.col(f"t_{v}") for v in labels), F.lit(0))
    valued = counts.join(F.broadcast(gone.select(*keys)), list(keys)).withColumn("__t", t).filter("value is not null and __t > 0")
    most = valued.groupBy(*keys).agg(F.max("__t").alias("__most"))
    modes = (valued.join(F.broadcast(most), list(keys)).filter("__t = __most")
             .groupBy(*keys).agg((-F.max(-F.col("value"))).alias("__mode")))
    per_key = cut_lineage(gone.join(modes, list(keys), "left"))
    out = counts.join(F.broadcast(per_key), list(keys), "left")
    at, upto = F.col("value") == F.col("__mode"), F.col("value") >= F.col("__mode")
    more = {c: F.when(at, F.col("__gone")[c]) for c in sides} | {f"b_{v}": F.when(upto, F.col("__gone")[f"t_{v}"]) for v in labels}
    # without a training value the missing cells stay a value of their own
    kept = out.filter(F.col("value").isNotNull() | F.col("__mode").isNull())
    return kept.withColumns({c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in more.items()}).drop("__mode", "__gone")


def counts_below(hist: DataFrame, keys: Sequence[str], part: str, ts: Sequence[str]) -> DataFrame:
    """Add ``b_<t>``, the training counts at or below each training value of its key, and ``nxt``, its next training value.

    ``part`` cuts the values into ordered parts; only rows of one (key, part) are sorted together, and offsets have one row
    per key and part.
    """
    on = [*keys, part]
    seen = (sum((F.col(t) for t in ts), F.lit(0)) > 0) & F.col("value").isNotNull()
    rows = hist.withColumn("seen", seen)
    inside = Window.partitionBy(*on, "seen").orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.filter("seen").groupBy(*on).agg(*[F.sum(t).alias(f"s_{t}") for t in ts], F.min("value").alias("__first"))
    over = Window.partitionBy(*keys).orderBy(part)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *on, *[F.coalesce(F.sum(f"s_{t}").over(before), F.lit(0)).alias(f"o_{t}") for t in ts], F.lead("__first").over(over).alias("__ahead"))
    placed = rows.withColumns({**{f"i_{t}": F.sum(t).over(upto) for t in ts}, "__next": F.lead("value").over(inside)})
    return placed.join(F.broadcast(offsets), on, "left").select(
        *[c for c in hist.columns if c != part], "seen", *[(F.col(f"i_{t}") + F.col(f"o_{t}")).alias(f"b_{t}") for t in ts],
        F.coalesce("__next", "__ahead").alias("nxt"))


def grow(counts: DataFrame, keys: Sequence[str], labels: Sequence[int], depth: int = 3) -> DataFrame:
    """Grow one Gini tree per ``keys`` group; every value row gets its leaf (node, lo) and prediction.

    A node splits at the midpoint between neighbouring training values with the lowest weighted impurity, the lowest
    threshold on ties; pure nodes and single values stay. ``counts`` is that of :func:`fold_counts`. The leaves of all
    trees (at most 2**depth per key) are kept by the driver and sent to the next level.
    """
    ts = [f"t_{v}" for v in labels]
    totals = counts.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in ts]).collect()
    trees = {tuple(r[c] for c in keys): [(0, float("-inf"), float("inf"), [0] * len(ts), [r[t] for t in ts])] for r in totals}
    seen = counts.filter("nxt is not null").filter(sum((F.col(t) for t in ts), F.lit(0)) > 0).filter("value is not null")
    points = seen.select(*keys, F.col("value").cast("double").alias("value"), F.col("nxt").cast("double").alias("nxt"), *[f"b_{v}" for v in labels])
    kind = T.StructType([*[points.schema[c] for c in keys], *T.StructType.fromDDL("node int, score double, value double, nxt double, mid array<bigint>").fields])
    for _ in range(depth):
        found = points.mapInArrow(partial(_best_cuts, trees=trees, n_keys=len(keys), n_labels=len(ts)), kind)
        cut = F.struct("score", (-F.col("value")).alias("v"), ((F.col("value") + F.col("nxt")) / 2).alias("thr"), "mid")
        best = found.groupBy(*keys, "node").agg(F.max(cut).alias("cut")).collect()
        cuts = {(tuple(r[c] for c in keys), r["node"]): r["cut"] for r in best}
        for key, leaves_ in trees.items():
            trees[key] = [part for leaf in leaves_ for part in _split(leaf, cuts.get((key, leaf[0])))]
    return _in_leaf(counts, trees, keys, labels)


def _best_cuts(batches: Iterator[pa.RecordBatch], trees: dict[tuple, list[Leaf]], n_keys: int, n_labels: int) -> Iterator[pa.RecordBatch]:
    """(keys, node, score, value, nxt, mid): the best cut of every node among the values of a batch, the smallest value on ties."""
    for batch in batches:
        coded = [batch.column(i).dictionary_encode() for i in range(n_keys)]
        codes = np.stack([c.indices.to_numpy(zero_copy_only=False) for c in coded])
        start = np.concatenate([[0], np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1]) if batch.num_rows else []
        runs: dict[tuple, list[np.ndarray]] = {}
        for a, b in zip(start, [*start[1:], batch.num_rows], strict=False):
            runs.setdefault(tuple(codes[:, a].tolist()), []).append(np.arange(a, b))
        value, nxt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (n_keys, n_keys + 1))
        below = np.stack([batch.column(n_keys + 2 + i).to_numpy(zero_copy_only=False) for i in range(n_labels)], 1)
        out = []
        for code, rows in runs.items():
            key = tuple(c.dictionary[i].as_py() for c, i in zip(coded, code, strict=True))
            at = np.concatenate(rows)
            leaves_ = trees.get(key)
            if leaves_ is None:
                continue
            which = np.minimum(np.searchsorted([leaf[2] for leaf in leaves_], value[at], side="left"), len(leaves_) - 1)
            left = below[at] - np.array([leaf[3] for leaf in leaves_])[which]
            right = np.array([leaf[4] for leaf in leaves_])[which] - below[at]
            n_left, n_right = left.sum(axis=1), right.sum(axis=1)
            ok = (n_left > 0) & (n_right > 0) & ((left + right).max(axis=1) != n_left + n_right)
            at, which, left, right, n_left, n_right = at[ok], which[ok], left[ok], right[ok], n_left[ok], n_right[ok]
            score = (left * left).sum(axis=1).astype(float) / n_left + (right * right).sum(axis=1).astype(float) / n_right
            order = np.lexsort((value[at], -score, which))
            for i in order[np.unique(which[order], return_index=True)[1]]:
                out.append((*key, leaves_[which[i]][0], score[i], value[at[i]], nxt[at[i]], below[at[i]].tolist()))
        if out:
            kinds = [*batch.schema.types[:n_keys], pa.int32(), *[pa.float64()] * 3, pa.list_(pa.int64())]
            names = [*batch.schema.names[:n_keys], "node", "score", "value", "nxt", "mid"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


Leaf = tuple[int, float, float, list, list]  # node, bounds (lo, hi], label counts at or below the bounds


def _split(leaf: Leaf, cut: Row | None) -> list[Leaf]:
    node, lo, hi, below, upto = leaf
    if cut is None:
        return [leaf]
    return [(2 * node + 1, lo, cut["thr"], below, cut["mid"]), (2 * node + 2, cut["thr"], hi, cut["mid"], upto)]


def _in_leaf(rows: DataFrame, trees: dict[tuple, list[Leaf]], keys: Sequence[str], labels: Sequence[int]) -> DataFrame:
    """Add to each row the leaf of its key that holds its value, as ``node``, ``lo`` and the prediction ``pred``: the most
    frequent label, the lowest on ties. The first leaf also takes missing values, and NaN where no leaf ends at it."""
    def pred(leaf: Leaf) -> int:
        counts = [u - b for b, u in zip(leaf[3], leaf[4], strict=True)]
        return labels[counts.index(max(counts))]

    tree = T.StructType.fromDDL("node int, lo double, __hi double, pred int, __first boolean, __nan boolean")
    kind = T.StructType([*[T.StructField(f"__{c}", rows.schema[c].dataType) for c in keys], *tree.fields])
    table = [(*key, *leaf[:3], pred(leaf), i == 0, i == 0 and not any(math.isnan(x[2]) for x in leaves_))
             for key, leaves_ in trees.items() for i, leaf in enumerate(leaves_)]
    mine = rows.sparkSession.createDataFrame(table, kind)
    inside = (F.col("value") <= F.col("__hi")) & ((F.col("value") > F.col("lo")) | F.col("__first"))
    holds = inside | (F.col("value").isNull() & F.col("__first")) | (F.isnan("value") & F.col("__nan"))
    same = [F.col(c) == F.col(f"__{c}") for c in keys]
    return rows.join(F.broadcast(mine), reduce(lambda x, y: x & y, same, holds)).drop("__hi", "__first", "__nan", *[f"__{c}" for c in keys])


def leaves(grown: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, leaves): the fitted model as at most 2**depth (lo, pred) intervals, ordered by lo."""
    return grown.groupBy(*keys, "node").agg(F.first("lo").alias("lo"), F.first("pred").alias("pred")).groupBy(
        *keys
    ).agg(F.sort_array(F.collect_list(F.struct("lo", "pred"))).alias("leaves"))


def predict_value(x: Column, model: Column) -> Column:
    return F.element_at(F.filter(model, lambda leaf: x > leaf["lo"]), -1)["pred"]


def side_counts(grown: DataFrame, keys: Sequence[str], labels: Sequence[int], side: str = "v") -> DataFrame:
    """(keys, y, pred, n) of the validation (``v``) or training (``t``) side."""
    g = grown.groupBy(*keys, "pred").agg(*[F.sum(f"{side}_{v}").alias(f"{side}_{v}") for v in labels])
    arms = F.array(*[F.struct(F.lit(v).alias("y"), F.col(f"{side}_{v}").alias("n")) for v in labels])
    return g.select(*keys, "pred", F.inline(arms)).filter("n > 0")


def fold_list(folds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The distinct fold combinations of a plan: their number is set by the caller, not by the rows."""
    return folds.select(*cols).distinct()


def single_feature_scores(
    rows: DataFrame, part: Sequence[str], fold: str, features: Sequence[str], label: str, labels: Sequence[int],
    depth: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Grown trees and their validation metrics for every (part, fold, feature).

    ``rows`` has one row per (part, key) with its validation fold, the label and the features.
    """
    keys = [*part, fold, "feature"]
    # read by folds, counts and modes alike; small beside the rows it was counted from
    hist = in_parts(value_histogram(rows, [*part, fold], features, label, labels))
    counts = fold_counts(hist, part, fold, fold_list(hist, [*part, fold]), labels)
    grown = grow(fill_with_mode(counts, keys, labels), keys, labels, depth)
    return grown, class_metrics(side_counts(grown, keys, labels), keys, labels)


def exploratory_scores(rows: DataFrame, features: Sequence[str], label: str, labels: Sequence[int]) -> DataFrame:
    """Mean outer-fold macro-F1 of a depth-3 tree per feature, best first."""
    _, m = single_feature_scores(rows, ["repeat"], "fold", features, label, labels)
    return m.groupBy("feature").agg(F.avg("macro_f1").alias("macro_f1")).orderBy(F.desc("macro_f1"), "feature")


def inner_candidates(
    inner_rows: DataFrame, features: Sequence[str], label: str, labels: Sequence[int]
) -> DataFrame:
    """(repeat, fold, feature, inner_macro_f1): mean inner-fold macro-F1 of each feature's tree."""
    _, m = single_feature_scores(inner_rows, ["repeat", "fold"], "inner_fold", features, label, labels)
    return m.groupBy("repeat", "fold", "feature").agg(F.avg("macro_f1").alias("inner_macro_f1"))


def best_feature(candidates: DataFrame, keys: Sequence[str], score: str, digits: int = 12) -> DataFrame:
    """Highest score, then alphabetical, per ``keys``. Scores equal to ``digits`` places are ties."""
    s = F.round(score, digits)
    # a struct maximum prefers larger names, so the order of names is inverted by a minimum on (-score, name)
    return candidates.groupBy(*keys).agg(F.min_by("feature", F.struct(-s, F.col("feature"))).alias("feature"))


def best_priority(candidates: DataFrame, keys: Sequence[str], score: str, priority: str, digits: int = 12) -> DataFrame:
    """Highest score, then earliest priority, per ``keys``."""
    s = F.round(score, digits)
    best = F.min_by(F.struct(*[c for c in candidates.columns if c not in keys]), F.struct(-s, F.col(priority)))
    return candidates.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def nested_single(
    rows: DataFrame, inner_rows: DataFrame, key: str, features: Sequence[str], label: str, labels: Sequence[int],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested best-single-feature classifier on all outer folds: (predictions, candidates, picks).

    Features are scored on inner folds of the outer training part only; the winner's tree is refitted on
    that part and applied to the validation rows as one short interval list per (repeat, fold).
    """
    cand = inner_candidates(inner_rows, features, label, labels)
    picks = best_feature(cand, ["repeat", "fold"], "inner_macro_f1")
    grown, _ = single_feature_scores(rows, ["repeat"], "fold", features, label, labels)
    keys = ["repeat", "fold", "feature"]
    ts = sum((F.col(f"t_{v}") for v in labels), F.lit(0))
    modes = grown.groupBy(*keys).agg(F.max_by("value", F.struct(ts, -F.col("value"))).alias("mode"))
    # repeats x folds rows
    models = picks.join(leaves(grown, keys), keys).join(modes, keys)
    x = F.coalesce(*[F.when(F.col("feature") == c, F.coalesce(F.col(c), F.col("mode"))) for c in features])
    out = rows.join(F.broadcast(models), ["repeat", "fold"]).select(
        F.lit("nested_single").alias("model"), "repeat", "fold", key, F.col(label).alias("y"),
        predict_value(x, F.col("leaves")).alias("pred"),
    )
    return out, cand, picks
