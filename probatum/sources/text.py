"""Delimited-text readers, file-order row indices and file digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probatum.functions.cells import reader_nulls_to_null
from probatum.sources.records import read_records


def with_row_index(df: DataFrame, out: str = "row_index") -> DataFrame:
    """Dense zero-based row index in file order, for a DataFrame read straight from files.

    File splits are packed into tasks by size, so plain generated ids do not follow the file. The ids of one file
    block are consecutive, though: less the block's smallest id they are positions in it, to which the number of
    rows in all blocks before is added. Only one record per block is joined; no row moves.
    """
    cols = df.columns
    where = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()}
    placed = df.select(*cols, *[c.alias(n) for n, c in where.items()])
    counts = placed.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    # one row per file block
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(F.broadcast(shift), ["__file", "__block"]).select((F.col("__at") + F.col("__shift")).alias(out), *cols)


def load_raw_csv(
    spark: SparkSession, path: str, key: str | None = "source_row_id", multiline: bool = False,
    key_column: str | None = None,
) -> DataFrame:
    """Every column as text, the reader's missing tokens as NULL, rows numbered in file order as ``key``.

    ``key_column`` names an existing unique integer column to use instead of numbering the rows.
    """
    if multiline:
        return _raw_records(spark, path, key, key_column)
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    if key_column is not None:
        rest = [c for c in df.columns if c != key_column]
        return df.select(F.col(key_column).cast("bigint").alias(key or key_column),
                         *[reader_nulls_to_null(c).alias(c) for c in rest])
    cols = df.columns
    if key is not None:
        df = with_row_index(df, key)
    keep = [key] if key is not None else []
    return df.select(*keep, *[reader_nulls_to_null(c).alias(c) for c in cols])


def _raw_records(spark: SparkSession, path: str, key: str | None, key_column: str | None) -> DataFrame:
    """Like ``load_raw_csv``, for files with line breaks inside quotes; every file has the header."""
    found = read_records(spark, path)
    head = found.filter(F.col("record") == 0).first()
    if head is None:
        return spark.createDataFrame([], f"{key} bigint" if key else "_0 string")
    names = [c.removeprefix("\ufeff") for c in head["cells"]]
    # numbers without the headers of the files before, one row per file
    heads = found.filter("first").select(F.col("record").alias("__head"))
    starts = [r[0] for r in heads.orderBy("__head").collect()]
    number = F.col("record") - F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in starts]), lambda x: x <= F.col("record")))
    body = found.filter(~F.col("first")).select(number.alias("__key"), *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(names))])
    if key_column is not None:
        at = names.index(key_column)
        return body.select(F.col(f"c{at}").cast("bigint").alias(key or key_column),
                           *[reader_nulls_to_null(f"c{i}").alias(c) for i, c in enumerate(names) if i != at])
    keep = [F.col("__key").alias(key)] if key is not None else []
    return body.select(*keep, *[reader_nulls_to_null(f"c{i}").alias(c) for i, c in enumerate(names)])


def record_width(spark: SparkSession, path: str) -> int:
    """Cells of the widest line, separators inside quotes aside."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    return spark.read.text(path).agg(F.coalesce(F.max(F.regexp_count(bare, F.lit(","))), F.lit(-1)) + 1).first()[0]


def load_dump(
    spark: SparkSession, path: str, row: str = "row_index", multiline: bool = False
) -> tuple[DataFrame, list[str]]:
    """A dump as raw text cells: (DataFrame with ``row`` and the columns, column names).

    The first record is the header (a byte-order mark is dropped). Short rows are padded with empty text;
    cells beyond the header get ``__extra_col_i`` columns as far as the widest record has any, filled or not.
    ``multiline`` reads line breaks inside quotes (see ``records``), in splits too.
    """
    if multiline:
        return _dump_records(spark, path, row)

    def read(width: int) -> DataFrame:
        schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])
        return (
            spark.read.schema(schema).option("header", False).option("quote", '"')
            .option("escape", '"').option("mode", "PERMISSIVE").option("emptyValue", "").csv(path)
        )

    probe = spark.read.option("header", False).option("escape", '"').csv(path)
    if not probe.columns:
        return spark.createDataFrame([], f"{row} bigint"), []
    base = len(probe.columns)
    width = max(base, record_width(spark, path))
    wide = read(width)
    indexed = with_row_index(wide.select(*[f"_{i}" for i in range(width)]), "__i")
    head = indexed.filter(F.col("__i") == 0).collect()[0]
    names = [(head[f"_{i}"] or "").removeprefix("\ufeff") for i in range(base)]
    names += [f"__extra_col_{i}" for i in range(width - base)]
    body = indexed.filter(F.col("__i") > 0).select(
        (F.col("__i") - 1).alias(row), *[F.coalesce(f"_{i}", F.lit("")).alias(n) for i, n in enumerate(names)]
    )
    return body, names


def _dump_records(spark: SparkSession, path: str, row: str) -> tuple[DataFrame, list[str]]:
    found = read_records(spark, path)
    head = found.filter(F.col("record") == 0).first()
    if head is None:
        return spark.createDataFrame([], f"{row} bigint"), []
    names = [c.removeprefix("\ufeff") for c in head["cells"]]
    width = found.agg(F.max(F.size("cells"))).first()[0]
    names += [f"__extra_col_{i}" for i in range(width - len(names))]
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return found.filter(F.col("record") > 0).select((F.col("record") - 1).alias(row), *cells), names


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, nbytes, raw_sha256, lf_sha256) per file: digest of the bytes and of the bytes with LF line ends."""
    files = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n?", "\n")
    return files.select(
        "path", F.col("length").alias("nbytes"), F.sha2("content", 256).alias("raw_sha256"),
        F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("lf_sha256"),
    )


def require_unchanged(before: Sequence[T.Row], after: DataFrame) -> None:
    """Raise when a file's digest differs from an earlier gathering of ``file_digests``."""
    old = {r.path: r.raw_sha256 for r in before}
    new = {r.path: r.raw_sha256 for r in after.select("path", "raw_sha256").collect()}  # a row per input file
    if old != new:
        raise RuntimeError("input files changed on disk during the run")


# Fixed value: score from which a single feature counts as strong.
STRONG_SCORE = 0.85


def strong_features(spark: SparkSession, report: str, field: str, threshold: float = STRONG_SCORE) -> DataFrame:
    """(feature, score) with score >= threshold from a score map in an earlier JSON report."""
    schema = T.StructType([T.StructField(field, T.MapType(T.StringType(), T.DoubleType()))])
    doc = spark.read.schema(schema).option("multiLine", True).json(report)
    return doc.select(F.explode(field).alias("feature", "score")).filter(F.col("score") >= threshold)


def file_layer(spark: SparkSession, path: str, body: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per dump: bytes, digests, data rows and columns in order."""
    return file_digests(spark, path).select(
        "path", "nbytes", F.lit("utf-8-sig").alias("encoding"), "raw_sha256", "lf_sha256", F.lit(body.count()).alias("n_data_rows"),
        F.lit(len(names)).alias("n_columns"), F.array(*[F.lit(c) for c in names]).alias("columns"),
        F.lit(0).alias("row_index_base"),
    )
