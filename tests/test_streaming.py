from __future__ import annotations

from probatum.functions.rules import questionnaire_rules
from probatum.operators import parsing as P
from probatum.streaming import cells


def test_stream_equals_batch(spark, tmp_path):
    cols = ["headache", "mental_health_history"]
    raw = spark.range(200).selectExpr("id", "cast(id % 9 - 1 as string) headache",
                                      "case when id % 3 = 0 then '“2”' else 'x' end mental_health_history")
    src = str(tmp_path / "src")
    raw.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(raw.schema).parquet(src)
    rules = questionnaire_rules()
    for name, flow, batch in (
        ("v", cells.violation_stream(stream, "id", cols, rules),
         P.domain_violations(P.parse_table(raw, "id", cols), "id", cols, rules)),
        ("i", cells.issue_stream(stream, "id", cols), P.parse_issues(raw, "id", cols)),
    ):
        out = str(tmp_path / name)
        cells.append_to(flow, out, str(tmp_path / f"ck_{name}")).awaitTermination(120)
        got = spark.read.parquet(out)
        assert got.count() == batch.count() > 0 and got.exceptAll(batch).count() == 0
