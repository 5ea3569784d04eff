"""Writers that refuse to overwrite: tables, one JSON document, Markdown, run status, fitted models."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class OutputError(ValueError):
    """The output folder cannot be used without touching existing files."""


def claim_output(spark: SparkSession, folder: str, **note: Any) -> None:
    """Take a folder that does not exist or has nothing in it, and mark the run as in progress."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path):
        held = [x.getPath().getName() for x in files.listStatus(path)] if files.getFileStatus(path).isDirectory() else None
        if held is None:
            raise OutputError(f"{folder} is a file")
        if held:
            raise OutputError(f"{folder} holds {len(held)} files already, {min(held)} among them; name a new folder")
    write_status(spark, folder, "in_progress", **note)


def write_status(spark: SparkSession, folder: str, status: str, **extra: Any) -> None:
    write_text(spark, f"{folder}/run_status/{status}", json.dumps({"status": status, **extra}))


def read_status(spark: SparkSession, folder: str) -> str:
    """``completed`` once that marker is written, ``in_progress`` before."""
    seen = {json.loads(r.value)["status"] for r in spark.read.text(f"{folder}/run_status/*").collect()}
    return "completed" if "completed" in seen else "in_progress"


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for delimited output."""
    nested = {c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = (flat(df) if fmt == "csv" else df).write.mode("errorifexists")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", fmt)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text document."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def write_json(spark: SparkSession, path: str, document: Mapping[str, Any]) -> None:
    write_text(spark, path, json.dumps(document, ensure_ascii=False, default=str))


def records(df: DataFrame) -> list[dict[str, Any]]:
    """Rows of a summary table as plain values; for tables whose size is set by parameters."""
    return [json.loads(r.value) for r in df.select(F.to_json(F.struct(*df.columns)).alias("value")).collect()]


def write_model(model: PipelineModel, spark: SparkSession, folder: str, **meta: Any) -> None:
    """A fitted pipeline with the metadata needed to use it."""
    model.write().save(f"{folder}/pipeline")
    write_json(spark, f"{folder}/metadata", meta)
