"""Label-proxy report: how much of the label single columns give away."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from probatum.operators import association as A
from probatum.operators import splits as S
from probatum.operators.models import variant_scores
from probatum.sources import sinks, text

# Names of the column subsets in the report, by what they keep of the columns.
VARIANTS = (
    ("lr_all", lambda column, proxy, strong: True),
    ("lr_{proxy}_only", lambda column, proxy, strong: column == proxy),
    ("lr_without_{proxy}", lambda column, proxy, strong: column != proxy),
    ("lr_without_strong_single_features", lambda column, proxy, strong: column not in strong),
)


def variants(features: Sequence[str], proxy: str, strong: Sequence[str]) -> dict[str, list[str]]:
    """Columns kept per variant; variants that keep none are left out."""
    kept = {n.format(proxy=proxy): [c for c in features if keeps(c, proxy, set(strong))] for n, keeps in VARIANTS}
    return {n: c for n, c in kept.items() if c}


def label_proxy_report(
    df: DataFrame, key: str, label: str, labels: Sequence[int], features: Sequence[str], proxy: str,
    strong: Sequence[str] | None = None, k: int = 5, repeats: int = 10, seed: int = 0, out: str | None = None,
    earlier: tuple[str, str] | None = None,
) -> tuple[dict[str, Any], dict[str, DataFrame]]:
    """(summary, tables): cross table of the proxy, purity of all features, correlations, model variants.

    The strong features are given, or read from an ``earlier`` report (path, field with a score per feature). Whatever
    can fail on the data's shape fails before the folder is touched.
    """
    spark = df.sparkSession
    if strong is None:
        if earlier is None:
            raise ValueError("name the strong features or an earlier report that scores them")
        strong = sorted(r.feature for r in text.strong_features(spark, *earlier).collect())  # a row per column
    S.check_feasible(df, label, k)
    scores = sinks.records(variant_scores(df, key, label, labels, variants(features, proxy, strong), k, repeats, seed))
    tables = {
        f"{proxy}_by_label": A.crosstab(df, proxy, label, labels).orderBy("value"),
        "feature_label_purity": A.purity_report(df, key, features, label),
    }
    report: dict[str, Any] = {"proxy_feature": proxy, "strong_single_features": list(strong)}
    report["protocol"] = {"n_splits": k, "n_repeats": repeats, "seed": seed, "scoring": "f1_macro"}
    report["lr_variants"] = {row["model"]: row for row in scores}
    report["mean_abs_feature_correlation"] = A.mean_abs_correlation(df, features).collect()[0][0]
    if out is not None:
        sinks.claim_output(spark, out)
        sinks.write_tables(tables, out)
        sinks.write_json(spark, f"{out}/report", report)
        sinks.write_status(spark, out, "completed")
    return report, tables
