"""Row-local audit steps on a stream of text rows: parsing, issue log and rule violations keep no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from probatum.functions.rules import RuleSet
from probatum.operators import parsing


def violation_stream(raw: DataFrame, key: str, columns: Sequence[str], rules: RuleSet) -> DataFrame:
    """Rule violations of a streaming text table; the same operators as on a batch table."""
    return parsing.domain_violations(parsing.parse_table(raw, key, columns), key, columns, rules)


def issue_stream(raw: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return parsing.parse_issues(raw, key, columns)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append whatever is available to a parquet folder, exactly once per input file, then stop."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
