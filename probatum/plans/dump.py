"""Dump comparison report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from probatum.operators import compare as C
from probatum.sources import sinks, text


def compare_dumps(
    cand: DataFrame, ref: DataFrame, cand_columns: list[str], ref_columns: list[str], prefix_rows: int,
    row: str = "row_index",
) -> tuple[dict[str, Any], dict[str, DataFrame]]:
    """(summary, detail tables). Full comparison by position needs equal lengths; the prefix needs both long enough.

    Counts, flags, multiset verdicts and detail tables are all complete.
    """
    cols = C.align(cand_columns, ref_columns)
    tables: dict[str, DataFrame] = {}
    layers: dict[str, Any] = {}
    comparable = bool(cols.shared)
    status: dict[str, Any] = {"column_order_differs": cols.order_differs, "not_comparable": not comparable}
    n_material = 0
    if comparable:
        nc, nr = cand.count(), ref.count()
        for name, n in (("full", None), ("prefix", prefix_rows)):
            a, b = (cand, ref) if n is None else (C.prefix(cand, row, n), C.prefix(ref, row, n))
            by_position = nc == nr if n is None else min(nc, nr) >= n
            layer: dict[str, Any] = {"comparable": by_position, "counts": {}, "raw_equal": False, "format_equal": False}
            if by_position:
                pairs = C.cell_pairs(a, b, cols.shared, row)
                k = C.kind_counts(pairs).collect()[0].asDict()
                layer["counts"] = k
                layer["raw_equal"] = k["equal_raw"] == k["n_cells_compared"]
                layer["format_equal"] = k["equal_raw"] + k["format_only"] == k["n_cells_compared"]
                n_diff = k["n_cells_compared"] - k["equal_raw"]
                layer["n_difference_rows_written"] = n_diff
                n_material += sum(k[x] for x in C.MATERIAL)
                tables[f"cell_differences_{name}"] = C.details(pairs, row)
            if by_position or n is None:
                summary, tables[f"row_count_differences_{name}"] = C.multiset_verdict(a, b, cols.shared, layer["raw_equal"])
                layer["multiset"] = summary.collect()[0].asDict()
            else:
                layer["multiset"] = {"status": "not_comparable"}
            layers[name] = layer
    full, pre = layers.get("full", {}), layers.get("prefix", {})
    other = "same_rows_different_order"
    status |= {
        "full_table_raw_match": full.get("raw_equal", False),
        "full_table_format_match": full.get("format_equal", False),
        "prefix_raw_match": pre.get("raw_equal", False),
        "prefix_format_match": pre.get("format_equal", False),
        "prefix_content_match": pre.get("raw_equal", False) or pre.get("format_equal", False),
        "full_same_rows_different_order": full.get("multiset", {}).get("status") == other,
        "prefix_same_rows_different_order": pre.get("multiset", {}).get("status") == other,
        "content_differences": n_material > 0 or bool(cols.only_candidate or cols.only_reference),
    }
    report = {
        "prefix_rows": prefix_rows, "statuses": status, "layers": layers,
        "columns": {
            "candidate_order": cand_columns, "reference_order": ref_columns, "order_differs": cols.order_differs,
            "shared_in_candidate_order": cols.shared, "only_in_candidate": cols.only_candidate,
            "only_in_reference": cols.only_reference,
        },
    }
    return report, tables


def markdown(report: dict[str, Any]) -> str:
    lines = ["# Dump comparison", "", "## Statuses", ""]
    lines += [f"- `{k}`: {v}" for k, v in report["statuses"].items()]
    lines += ["", "## Columns", ""] + [f"- {k}: {v}" for k, v in report["columns"].items()]
    return "\n".join(lines) + "\n"


def compare_files(
    spark: SparkSession, candidate: str, reference: str, out: str, prefix_rows: int, multiline: bool = False,
) -> dict[str, Any]:
    """Compare two dump files and write the report, its Markdown form and the detail tables to a new folder."""
    before = [text.file_digests(spark, p).collect() for p in (candidate, reference)]
    (a, ac), (b, bc) = (text.load_dump(spark, p, multiline=multiline) for p in (candidate, reference))
    report, tables = compare_dumps(a.persist(), b.persist(), ac, bc, prefix_rows)
    da, db = (sorted((r.raw_sha256, r.lf_sha256, r.nbytes) for r in rows) for rows in before)
    report["statuses"]["exact_file_match"] = [x[0] for x in da] == [x[0] for x in db]
    report["statuses"]["normalized_file_match"] = sorted(x[1] for x in da) == sorted(x[1] for x in db)
    report["files"] = {
        "candidate": sinks.records(text.file_layer(spark, candidate, a, ac)),
        "reference": sinks.records(text.file_layer(spark, reference, b, bc)),
    }
    sinks.claim_output(spark, out)
    sinks.write_tables(tables, out)
    sinks.write_json(spark, f"{out}/comparison", report)
    sinks.write_text(spark, f"{out}/comparison_markdown", markdown(report))
    for p, rows in zip((candidate, reference), before):
        text.require_unchanged(rows, text.file_digests(spark, p))
    report["input_hashes_unchanged"] = True
    sinks.write_status(spark, out, "completed")
    return report
