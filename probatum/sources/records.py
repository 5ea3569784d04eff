"""Delimited records with line breaks inside quotes, read in splits like any other text.

Where a split begins, nobody knows by itself whether it stands inside quotes. Every block of a file therefore counts its
quotes first; the parity of all quotes before a block, a running sum with one row per block, tells its state. Each task then
cuts its blocks into records by itself. Records that cross a block's end, two pieces a block at most, are put together
afterwards.

Quotes open at the start of a cell and are doubled inside (RFC 4180); lines end in LF, CRLF or CR, which stay as they are
inside quotes, but only LF is where a file can be split. Empty lines are no records. A quote left open ends with its file, its cell with a line end.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probatum.session import cut_lineage

BATCH = 4_096  # records that a task hands on at once
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3  # a record; the end, the beginning and a block-long middle of one that crosses blocks
PIECE = "file string, block bigint, seq bigint, kind int, cells array<string>, piece string"


def parsed(text: str) -> list[list[str]]:
    """Cells of whole records."""
    csv.field_size_limit(1 << 30)
    return list(csv.reader(io.StringIO(text, newline="")))


def cut_block(lines: Iterator[str], inside: bool) -> Iterator[tuple[int, int, list[str] | None, str | None]]:
    """(seq, kind, cells, piece) of one block's lines; a line belongs to the block it begins in."""
    held: list[str] = []  # lines of the record that is open
    head = inside  # the open record began in an earlier block
    odd = False  # quotes of the open record
    seq = 0
    # a CR by itself ends a line, too
    for line in (part for x in lines for part in ([x + "\n"] if "\r" not in x[:-1] else io.StringIO(x + "\n", newline=""))):
        held.append(line)
        odd ^= line.count('"') % 2 == 1
        if odd == head:  # balanced, counting the quote that opened it before
            text = "".join(held)
            if head:
                yield -1, HEAD, None, text
            else:
                for cells in parsed(text):
                    if cells:
                        yield seq, WHOLE, cells, None
                        seq += 1
            held, head, odd = [], False, False
    if held:
        yield (-1, MIDDLE, None, "".join(held)) if head else (seq, TAIL, None, "".join(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of all blocks of a task; rows come in file order, block by block."""
    def rows() -> Iterator[tuple[str, int, bool, str]]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def blocks() -> Iterator[tuple]:
        ahead = rows()
        row = next(ahead, None)
        while row is not None:
            file, block, inside = row[:3]

            def lines() -> Iterator[str]:
                nonlocal row
                while row is not None and row[0] == file and row[1] == block:
                    yield row[3]
                    row = next(ahead, None)

            for found in cut_block(lines(), inside):
                yield file, block, *found

    yield from _batches(blocks())


def _batches(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "seq", "kind", "cells", "piece"])

    for piece in pieces:
        held.append(piece)
        if len(held) == BATCH:
            yield batch()
            held = []
    yield batch()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of records put together."""
    def pieces() -> Iterator[tuple]:
        for batch in batches:
            for file, block, seq, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield file, block, seq, WHOLE, parsed(text)[0], None

    yield from _batches(pieces())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first, cells): every record with its dense zero-based number in file order, and whether it is its file's first.

    The records are checkpointed once; besides, the lines are read to count quotes. What is broadcast has one row per block.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = counts.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # a broadcast join keeps the rows of a task in their order
    marked = lines.join(F.broadcast(states), ["file", "block"]).select("file", "block", "inside", "value")
    found = cut_lineage(marked.mapInArrow(_cut, PIECE))
    open_ = found.filter(F.col("kind") != WHOLE)
    # two rows per block at most: each tail, and what follows up to the next one
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    grouped = open_.withColumn("group", F.count_if(F.col("kind") == TAIL).over(order))
    joined = grouped.groupBy("file", "group").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", (F.col("kind") == TAIL).alias("late"), "piece"))), lambda x: x["piece"]), "").alias("piece"),
        F.min_by(F.struct("block", "seq"), F.when(F.col("kind") == TAIL, 0).otherwise(1)).alias("at"))
    stitched = joined.select("file", "at.block", "at.seq", "piece").mapInArrow(_join, PIECE)
    records = found.filter(F.col("kind") == WHOLE).unionByName(stitched).select("file", "block", "seq", "cells")
    sizes = found.filter(F.col("seq") >= 0).groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return records.join(F.broadcast(offsets), ["file", "block"]).select(
        (F.col("ahead") + F.col("seq")).alias("record"), ((F.col("block") == 0) & (F.col("seq") == 0)).alias("first"), "cells")
