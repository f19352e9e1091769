"""Lines of delimited files assembled to whole records, wherever their blocks end.

Whether a line begins inside quotes depends on all lines before it. Each block
of a file is therefore read once for what it makes of either beginning; the
results, one small row a block, are chained file by file. With that every block
knows where its first record begins, and only records that cross the end of a
block are put together from pieces.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.session import ship

csv.field_size_limit(2**31 - 1)


def ends_inside(text: str, inside: bool, delimiter: str) -> bool:
    """Whether a line that begins inside quotes or not ends inside them.

    A quote opens at the beginning of a field only; two of them inside quotes are one
    of the text.
    """
    if '"' not in text:
        return inside
    at = 0
    while True:
        if inside:
            at = text.find('"', at)
            while at >= 0 and text[at + 1 : at + 2] == '"':
                at = text.find('"', at + 2)
            if at < 0:
                return True
            inside, at = False, at + 1
        elif text[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = text.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def file_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, block, text): the lines of text files, in their order within each block."""
    read = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    text = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return read.select("file", "block", F.regexp_replace(text, "^﻿", "").alias("text"))


def crosses_lines(lines: DataFrame, delimiter: str) -> bool:
    """Whether any record goes on behind the end of a line; lines without quotes are not looked at."""
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([ends_inside(t, False, delimiter) for t in batch.column(0).to_pylist()], pa.bool_())], names=["open"])

    return not lines.filter(F.contains("text", F.lit('"'))).select("text").mapInArrow(run, "open boolean").filter("open").isEmpty()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The lines of each block in turn."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    row = next(rows, None)
    while row is not None:
        key = row[:2]

        def lines() -> Iterator[str]:
            nonlocal row
            while row is not None and row[:2] == key:
                yield row[2]
                row = next(rows, None)

        yield key, lines()


def _block_ends(delimiter: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), lines in _blocks(batches):
            # For a block that begins outside quotes and for one that begins inside: its end, its records, and whether a record ends in it.
            state, starts, closed = [False, True], [0, 0], [False, False]
            for text in lines:
                for k in (0, 1):
                    starts[k] += not state[k] and bool(text.strip())
                    state[k] = ends_inside(text, state[k], delimiter)
                    closed[k] = closed[k] or not state[k]
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "end_out": state[0], "end_in": state[1], "n_out": starts[0], "n_in": starts[1], "closes": closed[1]}])

    return run


def whole_records(lines: DataFrame, delimiter: str, skip: int = 0) -> DataFrame:
    """(file, record_no, text) of all records of files, blank lines left out, record_no counted over all files in the order of their names.

    The first skip records of each file, such as its header, are left out. The
    driver holds one row a block of the files, never any of their text. A quote
    that is never closed makes one record of the rest of its file.
    """
    spark = lines.sparkSession
    ship(spark)
    ends = lines.mapInArrow(_block_ends(delimiter), "file string, block long, end_out boolean, end_in boolean, n_out long, n_in long, closes boolean")
    plan: dict[tuple[str, int], tuple[bool, int, int]] = {}  # begins inside, number of its first record, block where the record it begins in began
    last, inside, total, owner, crossing = None, False, 0, 0, False
    for r in ends.orderBy("file", "block").toLocalIterator():
        if r.file != last:
            last, inside, total = r.file, False, total - skip
        if not inside:
            owner = r.block
        plan[r.file, r.block] = (inside, total, owner)
        crossing = crossing or inside
        if inside and r.closes:
            owner = r.block
        total += r.n_in if inside else r.n_out
        inside = r.end_in if inside else r.end_out
    shared = spark.sparkContext.broadcast(plan)
    names, kinds = ("file", "block", "record_no", "piece", "crosses", "text"), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for (file, block), found in _blocks(batches):
            inside, number, owner = shared.value[file, block]
            held: list[str] = []
            # Pieces of a record meet by the block where it began; that block has no more than one such record.
            begun, piece = (owner, None) if inside else (block, 0), block
            for text in found:
                if not inside and not text.strip():
                    continue
                held.append(text)
                inside = ends_inside(text, inside, delimiter)
                if not inside:
                    continued = begun[1] is None
                    made.append((file, begun[0], None if continued else number, piece, continued, "\n".join(held)))
                    number += not continued
                    held, begun = [], (block, 0)
                if len(made) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=list(names))
                    made = []
            if held:
                continued = begun[1] is None
                made.append((file, begun[0], None if continued else number, piece, True, "\n".join(held)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=list(names))

    found = lines.mapInArrow(run, "file string, block long, record_no long, piece long, crosses boolean, text string")
    whole = found.filter("not crosses").select("file", "record_no", "text")
    if crossing or inside:
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"])  # the pieces of one record
        whole = whole.unionByName(found.filter("crosses").groupBy("file", "block").agg(F.max("record_no").alias("record_no"), F.array_join(pieces, "\n").alias("text")).drop("block"))
    # Skipped records have numbers that the file before has, too; their files begin with them.
    firsts = {f: n for (f, b), (_, n, _) in plan.items() if b == 0}
    if skip:
        begins = spark.sparkContext.broadcast(firsts)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [n >= begins.value[f] + skip for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        whole = whole.mapInArrow(kept, whole.schema)
    return whole


def split_fields(records: DataFrame, delimiter: str) -> DataFrame:
    """records with the array fields instead of text, read by Python's csv reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [next(csv.reader([t.rstrip("\r")], delimiter=delimiter), []) if "\n" not in t else next(csv.reader(t.rstrip("\r").splitlines(True), delimiter=delimiter), []) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.string()))], names=["file", "record_no", "fields"])

    return records.select("file", "record_no", "text").mapInArrow(run, "file string, record_no long, fields array<string>")


def raw_lines(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(line_id, file, line_no, raw_text): the records of delivered files, as the operators on raw records take them.

    line_no counts the records of a file from 1, its header; file is its address.
    """
    made = whole_records(file_lines(spark, paths, encoding), delimiter)
    first = made.groupBy("file").agg(F.min("record_no").alias("_first"))
    text = F.regexp_replace("text", "\r$", "")
    return made.join(F.broadcast(first), "file").select(F.col("record_no").alias("line_id"), "file", (F.col("record_no") - F.col("_first") + 1).cast("int").alias("line_no"), text.alias("raw_text"))
