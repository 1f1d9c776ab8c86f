"""Token ids in a binary file (operator 6).

Documents are sorted by doc_id over the cluster, encoded, closed by an end id and packed in blocks of whole
documents. In a block, ids become ranks by falling frequency (ties: the smaller id first), so
common ids take one byte: a control byte holds the byte lengths of four ranks in two bits each,
apart from the data bytes, and numpy reads all lengths from a table of 256 rows. A block carries
its own table of ids by rank, so any block can be read alone and a lost executor costs one range.

The file is a Parquet table of blocks with the columns part, block, first_token (within the part),
doc_ids, lengths, ids_by_rank, control, data: Spark's writer commits it on any store.

Defined results: null and empty texts hold the end id alone; a null doc_id comes first; rows that share
a doc_id are ordered by their text's hash, and equal rows follow each other; an empty table gives
an empty file; other columns are not read. A document is never split over blocks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivium.llm import pieces
from trivium.llm.pieces import VISIBLE, Memory
from trivium.llm.text import whole
from trivium.shipping import ship

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: New pieces that go to the library as one text.
JOINED = 200
BLOCK = "part int, block int, first_token long, doc_ids array<long>, lengths array<long>, ids_by_rank array<int>, control binary, data binary"
ROWS = "part int, block int, first long, doc_id long, n_tokens long, ids_crc32 long"
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values, each in its least number of bytes."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    two = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    two[: len(values)] = size - 1
    control = (two.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again, by a table from each control byte to its four lengths."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level file.

    The library encodes each distinct piece of a batch, cut where no token reaches across (pieces.cut_spaced). Raises ValueError
    for files with other rules than those that make the cuts safe.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library, spec = Tokenizer.from_str(spec), json.loads(spec)
        split, added = spec["pre_tokenizer"], spec["added_tokens"]
        if spec["normalizer"] or split != split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or any(
                t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added):
            raise ValueError("the file's tokens can reach across a space")
        self.library.no_truncation(), self.library.no_padding()
        sizes = {i: len(t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in added}
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)  # bytes of each token
        self.memory = Memory(self.many)

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids). Pieces that begin with a space are encoded JOINED at a time, as one text: no token reaches across."""
        offsets, raw = pieces.buffers(texts)
        spaced = np.diff(offsets) > 1
        spaced[spaced] = (raw[offsets[:-1][spaced]] == 0x20) & VISIBLE[raw[offsets[:-1][spaced] + 1]]
        together, alone = texts.filter(pa.array(spaced)), texts.filter(pa.array(~spaced))
        groups = [together.slice(k, JOINED) for k in range(0, len(together), JOINED)] + [alone.slice(k, 1) for k in range(len(alone))]
        sizes, ids = [], []
        for group, e in zip(groups, self.library.encode_batch_fast([pieces.buffers(g)[1].tobytes().decode() for g in groups], add_special_tokens=False) if groups else [], strict=True):
            ids.append(np.array(e.ids, np.int32))
            after, ends = np.cumsum(self.sizes[ids[-1]]), pieces.buffers(group)[0][1:]
            stops = np.searchsorted(after, ends) + 1 if ends[-1] else np.zeros(len(group), np.int64)
            if ends[-1] and (stops[-1] != len(after) or (after[np.minimum(stops, len(after)) - 1] != ends).any()):
                raise ValueError("a token reaches across a space")
            sizes.append(np.diff(stops, prepend=0))
        # back from the groups' order to that of the pieces
        order = np.argsort(np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)]), kind="stable")
        sizes, ids = np.concatenate(sizes), np.concatenate(ids)
        starts, own = (np.cumsum(sizes) - sizes)[order], sizes[order]
        return own, ids[np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(len(ids))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row offsets, ids) of a string array without nulls."""
        return pieces.encode(texts, pieces.cut_spaced, self.memory)


def _block(part: int, block: int, first: int, doc_ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    counts = np.bincount(ids)
    by_rank = np.lexsort((np.arange(len(counts)), -counts))[: np.count_nonzero(counts)]
    rank = np.empty(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    control, data = pack(rank[ids])
    row = [part, block, first, doc_ids, [len(x) for x in parts], by_rank.tolist(), control, data]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


@lru_cache(1)
def encoder_of(spec: str) -> Encoder:
    """One encoder for each Python worker, whatever the number of its tasks."""
    return Encoder(spec)


def _writer(spec, end_id: int):
    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(spec.value)
        end = np.array([end_id], np.uint32)
        block = first = held = 0
        doc_ids, parts = [], []
        for batch in rows:
            for a, b in pieces.slices(batch.column(1), 2 * pieces.SLICE):
                offsets, ids = encoder.encode(batch.column(1).slice(a, b - a))
                for k, doc_id in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    doc_ids.append(doc_id), parts.append(np.concatenate([ids[offsets[k] : offsets[k + 1]], end]))
                    held += len(parts[-1])
                    if held >= BLOCK_IDS:
                        yield _block(part, block, first, doc_ids, parts)
                        block, first, held, doc_ids, parts = block + 1, first + held, 0, [], []
            pieces.trim()
        if parts:
            yield _block(part, block, first, doc_ids, parts)

    return blocks


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Write docs (doc_id, text) as a token file in ascending doc_id order at path."""
    ship(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
        .withColumn("_hash", F.xxhash64("text"))  # rows of one doc_id, or of none, need not meet in one task
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "_hash")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_hash").drop("_hash")
    )
    ordered.mapInArrow(_writer(spec, end_id), BLOCK).write.option("compression", "zstd").parquet(path)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """One block at a time as Python objects."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _reader(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for r in _each(batch):
            lengths = np.array(r["lengths"], np.int64)
            ids = np.array(r["ids_by_rank"], "<u4")[unpack(r["control"], r["data"], int(lengths.sum()))]
            stops = np.cumsum(lengths)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(lengths.tolist(), stops.tolist(), strict=True)]
            k = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * k, pa.int32()), pa.array([r["block"]] * k, pa.int32()), pa.array(r["first_token"] + stops - lengths),
                 pa.array(r["doc_ids"], pa.int64()), pa.array(lengths), pa.array(crc, pa.int64())],
                names=[x.split()[0] for x in ROWS.split(", ")],
            )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of a token file."""

    def ids(rows):
        for batch in rows:
            for r in _each(batch):
                n = r["lengths"]
                flat = np.array(r["ids_by_rank"], np.int32)[unpack(r["control"], r["data"], sum(n))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), lists], names=["doc_id", "ids"])

    return spark.read.parquet(path).mapInArrow(ids, "doc_id long, ids array<int>")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from a token file.

    The window runs over one row for each part of the file: their number is that of the writer's
    tasks, not of the documents.
    """
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    before = parts.select(
        "part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    rows = blocks.mapInArrow(_reader, ROWS)
    return rows.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
