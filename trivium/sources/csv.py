"""CSV files whose quoted fields may hold line breaks, each read by many tasks.

Spark's own reader takes such a file in one task, as a line break may or may not end a record. The number of quotes before it
tells: after an odd number we are inside a quoted field (doubled quotes count twice, so they don't matter). So

1. a pass over the physical lines, which are split over tasks as any text, counts the quotes of each range of each file;
2. running sums over the ranges of a file tell for each whether it begins inside a field: 17 bytes a range reach the driver and
   the tasks, 14 MB for 100 TB in ranges of 128 MB;
3. a second pass joins lines to records within each range and stores them. What a range's first and last record lack stands in
   the ranges beside it: these fragments, at most two a range, are put together by file;
4. records are parsed by Spark's from_csv.

Files are in UTF-8 and as RFC 4180 has it: fields that hold quotes are quoted, and quotes in them doubled. Lines end in \\n or \\r\\n, inside
fields they stay as they are. A file with an odd number of quotes raises ValueError. Blank lines aren't records.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivium.schema import small
from trivium.scratch import materialize
from trivium.shipping import ship

#: Kinds of rows: a whole record, what goes on with the record of a range before, and a record that the range leaves open.
WHOLE, ON, OPEN = 0, 1, 2
PIECES = "file int, block long, ix long, kind int, record string"
#: Options of from_csv, the same as those of spark.read.csv for such files.
OPTIONS = {"multiLine": "true", "escape": '"', "nullValue": "NA"}


def data_files(spark: SparkSession, path: str, ending: str = "") -> list[str]:
    """Paths of the files of that ending directly in a folder of any file system, hidden ones apart, or of one file, sorted."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = [x.getPath() for x in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root) if x.isFile()]
    names = sorted(str(x) for x in found if x.getName()[0] not in "._" and x.getName().endswith(ending))
    if not names:
        raise ValueError(f"no {ending.removeprefix('.').upper()} files in {path}".replace("  ", " "))
    return names


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(files).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("path"), "value")


def _ranges(lines: DataFrame) -> tuple[dict, list[str]]:
    """(arrays file, block, open and place, paths): whether each range begins inside a field, and its file's place by path."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    made = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).cast("int").alias("odd"), F.min(F.when(F.col("block") == 0, F.col("path"))).alias("path"))
    t = made.toArrow().sort_by([("file", "ascending"), ("block", "ascending")])
    file, block, odd = (t.column(c).to_numpy() for c in ("file", "block", "odd"))
    first = np.flatnonzero(np.diff(file, prepend=file[:1] - 1 if len(file) else file) != 0)
    before = np.cumsum(odd) - odd
    counted = before - np.repeat(before[first], np.diff(first, append=len(file)))
    paths = [p for p in t.column("path").to_pylist() if p is not None]
    wrong = [p for p, n in zip(paths, np.add.reduceat(odd, first) if len(first) else [], strict=True) if n % 2]
    if wrong:
        raise ValueError(f"an odd number of quotes in {', '.join(wrong[:5])}")
    order = {p: k for k, p in enumerate(sorted(paths))}
    place = np.repeat(np.array([order[p] for p in paths], np.int32), np.diff(first, append=len(file)))
    return {"file": file, "block": block, "open": counted % 2 == 1, "place": place}, sorted(paths)


def _join(ranges):
    """Physical lines, in their order, to records."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, at, pending, begun, ix, inside = ranges.value, None, 0, [], False, 0, False

        def left() -> list[tuple[int, int, str]]:
            """What the range leaves open."""
            return [(ix, OPEN, "\n".join(pending)) if begun else (-1, ON, "\n".join(pending))] if pending else []

        def told(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([int(known["place"][at])] * n, pa.int32()), pa.array([now[1]] * n, pa.int64()), pa.array(columns[0], pa.int64()),
                                               pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["file", "block", "ix", "kind", "record"])

        for batch in rows:
            file, block = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(file)], strict=True):
                if a == b:
                    continue
                if now != (int(file[a]), int(block[a])):
                    if found := left():
                        yield told(found)
                    now, pending, ix = (int(file[a]), int(block[a])), [], 0
                    low, high = np.searchsorted(known["file"], now[0]), np.searchsorted(known["file"], now[0], "right")
                    at = low + np.searchsorted(known["block"][low:high], now[1])
                    if at >= high or known["block"][at] != now[1]:
                        raise RuntimeError("files are split otherwise than when their quotes were counted: did the session's settings change?")
                    inside = bool(known["open"][at])
                    begun = not inside
                values = batch.column(2).slice(a, b - a)
                odd = pc.count_substring(values, '"').to_numpy() % 2
                within = (np.cumsum(odd) - odd + inside) % 2 == 1  # before each line
                inside = bool((odd.sum() + inside) % 2)
                starts = np.flatnonzero(~within)
                lines = values.to_pylist()
                if not len(starts):
                    pending += lines
                    continue
                found = []
                pending += lines[: starts[0]]
                if pending:
                    found.append((ix, WHOLE, "\n".join(pending)) if begun else (-1, ON, "\n".join(pending)))
                    ix += begun
                begun = True
                records = ["\n".join(lines[x:y]) if y > x + 1 else lines[x] for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(lines)], strict=True)]
                pending = [records.pop()]  # open, or goes on in the next batch of this range
                if not inside:
                    records, pending = records + pending, []
                found += [(ix + k, WHOLE, r) for k, r in enumerate(records)]
                ix += len(records)
                if found:
                    yield told(found)
        if now and (found := left()):
            yield told(found)

    return batches


def read_records(spark: SparkSession, files: list[str]) -> tuple[DataFrame, list[str]]:
    """(file, row, record) of all records, headers included, and the files' paths by their number; rows of a file count from 0."""
    ship(spark)
    lines = _lines(spark, files)
    ranges, paths = _ranges(lines)
    held = spark.sparkContext.broadcast(ranges)
    stored = materialize(lines.select("file", "block", "value").mapInArrow(_join(held), PIECES), "csv_records")
    w = Window.partitionBy("file").orderBy("block", "ix")
    fragments = stored.where(F.col("kind") != WHOLE).withColumn("start", F.sum((F.col("kind") == OPEN).cast("long")).over(w))
    joined = fragments.groupBy("file", "start").agg(
        F.min(F.struct("block", "ix", "kind")).alias("p"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "ix", "record"))), lambda x: x["record"]), "\n").alias("record"))
    # an ON sorts before the OPEN of its range, so each group but a stray first one begins with an OPEN
    every = stored.where(F.col("kind") == WHOLE).select("file", "block", "ix", "record").unionByName(joined.select("file", "p.block", "p.ix", "record"))
    counts = stored.where(F.col("kind") != ON).groupBy("file", "block").agg(F.count("*").alias("n"))  # a row a range
    before = counts.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    placed = every.join(small(before), ["file", "block"])
    record = F.regexp_replace("record", "\r$", "")
    return placed.select("file", (F.col("before") + F.col("ix")).alias("row"), record.alias("record")), paths


def column_names(header: str) -> list[str]:
    """The names in a header; empty ones become _c and their number, and repeated ones get their number behind them."""
    names = next(csv.reader(io.StringIO(header.removeprefix("﻿"), newline="")))
    return [f"{x}{k}" if x and names.count(x) > 1 else x or f"_c{k}" for k, x in enumerate(names)]


def read_csv(spark: SparkSession, files: list[str], ordered: bool = False) -> DataFrame:
    """All records as text columns, files whose headers differ by name, absent columns null; NA and empty fields are null, quoted
    empty ones are empty. ordered: with _file, the file's number by path, and _row.
    """
    records, paths = read_records(spark, files)
    headers = {r.file: r.record for r in records.where("row = 0").select("file", "record").collect()}  # a line a file
    by_header: dict[str, list[int]] = {}
    for file in range(len(paths)):
        if headers.get(file, "").strip():
            by_header.setdefault(headers[file], []).append(file)
    if not by_header:
        raise ValueError(f"no header in {files[0]}")
    groups = spark.createDataFrame([(f, k) for k, found in enumerate(by_header.values()) for f in found], "file int, header int")
    body = records.where("row > 0 AND trim(record) <> ''").join(small(groups), "file") if len(by_header) > 1 else records.where("row > 0 AND trim(record) <> ''")
    made = None
    for k, header in enumerate(by_header):
        schema = ", ".join("`" + x.replace("`", "``") + "` string" for x in column_names(header))
        own = body.where(F.col("header") == k) if len(by_header) > 1 else body
        part = own.select(*([F.col("file").alias("_file"), F.col("row").alias("_row")] if ordered else []), F.from_csv("record", schema, OPTIONS).alias("_r")).select(
            *(["_file", "_row"] if ordered else []), "_r.*")
        made = part if made is None else made.unionByName(part, allowMissingColumns=True)
    return made

