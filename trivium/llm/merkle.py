"""Merkle fixity audit of stored WARC replicas (operator 1).

An archive is a table of WARC files, one row (file, content) each, which Spark's writer commits on any store. Every record of a
file has an offset and a length, found by reading the stored bytes. Leaves are the hashes of records by ordered offset
range; FANOUT children in offset order, with their ranges, are hashed into a parent, up to one root for
each file. Two replicas are each laid out from their own bytes and compared root by root; only children of differing nodes are
compared on the next level down, so a sound file costs one comparison and the damage is located in few steps.

Leaves that differ are told apart by their record: changed (the same record with other bytes), moved (the same bytes at
another place), missing and extra (in one replica only). A record cut short or with a broken header ends where the next one
starts.

A group on any level has at most FANOUT members, whatever the number of records. Records go to files by their hash, so no
page or host can fill one file alone; equal records travel together with their number, and from COPIES on in a batch of rows they go to
several files, so a group of copies can't either.

Defined results: null urls and bodies are empty; repeated rows are each a record, stored one after the other; records without
a readable id have page_id null; a file that one replica lacks is missing or extra record by record; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivium.llm.store import materialize
from trivium.llm.text import whole
from trivium.shipping import ship

FANOUT, RECORDS_PER_FILE, COPIES = 16, 512, 64
START, GAP = b"WARC/1.0\r\nWARC-Type: response\r\n", b"\r\n\r\n"
LEAF = "file long, ix long, start long, stop long, hash string, record string, nth int"
Records = list[tuple[int, int, bytes]]


def warc_record(page_id: int | None, url: str, body: str, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC response record; Content-Length counts bytes. The tables hold no time of capture, so the date is a parameter."""
    raw, url = body.encode(), url.replace("\r", "%0D").replace("\n", "%0A")
    head = (f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n"
            f"Content-Type: text/html\r\nContent-Length: {len(raw)}")
    return START + head.encode() + GAP + raw + GAP


def read_records(content: bytes) -> Records:
    """(start, stop, record id) of each record of a WARC file, in order; together they cover all its bytes."""
    out, at = [], 0
    while at < len(content):
        head = content.find(GAP, at)
        fields = dict(x.split(b": ", 1) for x in content[at : max(head, at)].split(b"\r\n") if b": " in x)
        length = fields.get(b"Content-Length", b"")
        stop = head + len(GAP) + int(length) + len(GAP) if head >= 0 and length.isdigit() else -1
        if not (at < stop <= len(content) and content[stop - len(GAP) : stop] == GAP and (stop == len(content) or content.startswith(START, stop))):
            following = content.find(GAP + START, at)
            stop = following + len(GAP) if following >= 0 else len(content)
        out.append((at, stop, fields.get(b"WARC-Record-ID", b"")))
        at = stop
    return out


def archive(pages: DataFrame, per_file: int = RECORDS_PER_FILE, name: str = "archive") -> DataFrame:
    """(file, content) of pages(page_id, url, html), stored: records in ascending page_id order, nulls first, ties by hash."""
    ship(pages.sparkSession)
    n_files = max(1, -(-pages.count() // per_file))

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for b, batch in enumerate(rows):
            copies: dict[tuple, int] = {}
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                copies[row] = copies.get(row, 0) + 1
            out = []
            for row, n in copies.items():
                record = warc_record(*row)
                digest = hashlib.sha256(record).hexdigest()
                for k in range(0, n, COPIES):  # the first ones by their hash alone, more by their batch too
                    file = int(digest[:12], 16) if not k else int(hashlib.sha256(f"{digest}:{task}:{b}:{k}".encode()).hexdigest()[:12], 16)
                    out.append((file % n_files, row[0], digest, min(COPIES, n - k), record))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["file", "page_id", "sha", "copies", "record"])

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parts = None, []
        for batch in rows:
            for f, n, record in zip(*[batch.column(k) for k in (0, 3, 4)], strict=True):
                if parts and f.as_py() != file:
                    yield _file(file, b"".join(parts))
                    parts = []
                file = f.as_py()
                parts += [record.as_py()] * n.as_py()
        if parts:
            yield _file(file, b"".join(parts))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), whole("url").alias("url"), whole("html").alias("html"))
    records = rows.mapInArrow(made, "file long, page_id long, sha string, copies int, record binary")
    # a few files a task at every size
    tasks = max(1, min(n_files, max(pages.sparkSession.sparkContext.defaultParallelism, n_files // 4)))
    dealt = records.repartition(tasks, "file").sortWithinPartitions("file", F.col("page_id").asc_nulls_first(), "sha")
    return materialize(dealt.mapInArrow(packed, "file long, content binary"), name)


def _file(file: int, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([content], pa.binary())], names=["file", "content"])


def _each(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in rows:
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            yield file.as_py(), content.as_py()


def rewritten(stored: DataFrame, change: Callable[[bytes, Records], bytes], name: str = "replica") -> DataFrame:
    """A stored replica of an archive whose files' bytes have gone through change(content, records)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, content in _each(rows):
            yield _file(file, change(content, read_records(content)))

    return materialize(stored.mapInArrow(batches, "file long, content binary"), name)


def page_of(record_id: bytes | str) -> str:
    """The page_id in a record's id, as text."""
    text = record_id.decode("utf-8", "replace") if isinstance(record_id, bytes) else record_id
    return text.removeprefix("<urn:page:").removesuffix(">")


def faults(content: bytes, records: Records, flip: int = 97, rare: int = 9973) -> bytes:
    """Simulated damage, by the md5 of the page's id as a number h; of several copies of a record only the first is hit.

    h % flip = 0: the body's first character is replaced. h % rare = 1: the record is missing; 2: it is there twice; 3: its
    body lacks the last character; 4: it follows its successor.
    """
    out, seen = [], set()
    for k, (start, stop, record_id) in enumerate(records):
        page = page_of(record_id)
        h = int(hashlib.md5(page.encode()).hexdigest()[:8], 16) if page not in seen else -1
        seen.add(page)
        head = content.index(GAP, start) + len(GAP)
        body = content[head : stop - len(GAP)].decode()
        times, place = 1, float(k)
        if h >= 0 and h % flip == 0:
            body = "\x01" + body[1:]
        if h >= 0 and 1 <= h % rare <= 4:
            fault = h % rare
            times = {1: 0, 2: 2}.get(fault, 1)
            body = body[:-1] if fault == 3 else body
            place += 1.5 if fault == 4 else 0
        out.append((place, (content[start:head] + body.encode() + GAP) * times))
    return b"".join(x for _, x in sorted(out, key=lambda x: x[0]))


def leaves(stored: DataFrame, name: str = "leaves") -> DataFrame:
    """LEAF rows of an archive, from its stored bytes: each record's range, hash, id and which of the id's records in the file it is."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, content in _each(rows):
            seen: dict[bytes, int] = {}
            out = []
            for ix, (start, stop, record_id) in enumerate(read_records(content)):
                seen[record_id] = seen.get(record_id, -1) + 1
                out.append((file, ix, start, stop, hashlib.sha256(memoryview(content)[start:stop]).hexdigest(), record_id.decode("utf-8", "replace"), seen[record_id]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in LEAF.split(", ")])

    return materialize(stored.mapInArrow(batches, LEAF), name)


def tree(base: DataFrame, depth: int, fanout: int = FANOUT, name: str = "tree") -> list[DataFrame]:
    """Levels (file, ix, start, stop, hash) from the leaves to depth levels above them, each a table.

    A node covers the byte range from start to stop; parents hash the ranges and hashes of their children in order.
    """
    levels = [base.select("file", "ix", "start", "stop", "hash")]
    for k in range(depth):
        up = levels[-1].groupBy("file", F.expr(f"ix div {fanout}").alias("p")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_list(F.struct("ix", "start", "stop", "hash"))).alias("c"))
        parent = F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["start"], x["stop"], x["hash"])), "\n"), 256)
        levels.append(materialize(up.select("file", F.col("p").alias("ix"), "start", "stop", parent.alias("hash")), f"{name}_{k + 1}"))
    return levels


def depth_of(most: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves until most leaves of a file have one root."""
    depth = 0
    while fanout**depth < most:
        depth += 1
    return depth


def audit(master: list[DataFrame], replica: list[DataFrame], fanout: int = FANOUT) -> list[DataFrame]:
    """From the roots down, the nodes compared on each level: (file, ix, differ); the last are the leaves.

    Below the roots only children of differing nodes are compared.
    """
    if len(master) != len(replica):
        raise ValueError("both trees need the same depth")
    compared: list[DataFrame] = []
    node = lambda s: F.struct("start", "stop", "hash").alias(s)
    for k in range(len(master) - 1, -1, -1):
        a, b = master[k].select("file", "ix", node("a")), replica[k].select("file", "ix", node("b"))
        if compared:
            parents = compared[-1].where("differ").select("file", F.col("ix").alias("p"))
            a, b = (x.withColumn("p", F.expr(f"ix div {fanout}")).join(parents, ["file", "p"], "left_semi").drop("p") for x in (a, b))
        met = a.join(b, ["file", "ix"], "full").select("file", "ix", (~F.col("a").eqNullSafe(F.col("b"))).alias("differ"))
        compared.append(materialize(met, f"compared_{k}"))
    return compared


def locate(master: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Where the stored archives differ: (page_id, kind, file, offset, length, replica_offset, replica_length, master_sha256, replica_sha256)."""
    sides = [leaves(master, "master_leaves"), leaves(replica, "replica_leaves")]
    most = max(x.agg(F.coalesce(F.max("ix"), F.lit(0))).first()[0] + 1 for x in sides)
    trees = [tree(x, depth_of(most, fanout), fanout, n) for x, n in zip(sides, ("master", "replica"), strict=True)]
    bad = audit(*trees, fanout)[-1].where("differ").select("file", "ix")
    side = lambda x, s: x.join(bad, ["file", "ix"], "left_semi").select(
        "file", "record", "nth", F.col("start").alias(f"{s}offset"), (F.col("stop") - F.col("start")).alias(f"{s}length"), F.col("hash").alias(f"{s}sha"))
    met = side(sides[0], "").join(side(sides[1], "replica_"), ["file", "record", "nth"], "full")
    kind = F.when(F.col("sha").isNull(), "extra").when(F.col("replica_sha").isNull(), "missing").when(F.col("sha") == F.col("replica_sha"), "moved").otherwise("changed")
    page = F.regexp_extract("record", r"^<urn:page:(-?\d+)>$", 1)
    return met.select(
        page.try_cast("long").alias("page_id"), kind.alias("kind"), "file", "offset", "length", "replica_offset", "replica_length",
        F.col("sha").alias("master_sha256"), F.col("replica_sha").alias("replica_sha256"))


def audit_pages(pages: DataFrame, per_file: int = RECORDS_PER_FILE, flip: int = 97, rare: int = 9973) -> DataFrame:
    """Store pages as WARC files, store a replica with simulated damage, and locate the damage from the bytes of both."""
    master = archive(pages, per_file)
    return locate(master, rewritten(master, partial(faults, flip=flip, rare=rare)))
