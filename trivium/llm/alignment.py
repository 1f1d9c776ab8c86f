"""Alignment of two tokenizers over whole texts (operator 11).

A (a byte-level file of the tokenizers library) and B (a sentencepiece model) encode the same bytes: a space and the text. Each byte
gets a label: no token ends there, one of A, one of B, or one of both. A regular expression scans the label string for spans up
to each label of both; the labels in a span count its tokens, which are a group. Each label but the first kind closes a stretch that lies
in one token of either side, so the labels are also the links: pairs of tokens whose byte ranges overlap.

Texts are cut before a space that follows another byte than a space and stands before a visible character. Neither side's tokens
reach across (this is checked when the files are read; others raise ValueError), so both have a token's end there, and groups
and links never do either: each distinct piece of a batch is encoded and scanned once, and a worker remembers a bounded number.

link_counts() tells how many documents hold each pair of ids linked; scores() adds what a document's links count corpus-wide. The
counts have at most a row for each pair of vocabulary entries; they are broadcast only behind a count of at most
PAIRS rows, else Spark joins both sides by pair.

Defined results: strings of special tokens inside texts are plain text; a null or empty text, or one that B's tokens don't
spell (such as one with U+2581), has no tokens: zeros and the empty string; each row is a document, equal rows and rows
of one doc_id included; other columns are carried along in a struct, whatever their names; an empty table gives an empty one; a long text is
encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivium.llm import pieces
from trivium.llm.pieces import REMEMBERED, VISIBLE
from trivium.llm.text import whole
from trivium.llm.token_file import Encoder
from trivium.schema import small
from trivium.shipping import ship

#: Rows of link counts up to which they are broadcast (about 40 MB), pieces that a worker remembers, and bytes of text at a time.
PAIRS, MEMORY, SLICE = 1_000_000, 400_000, 1_500_000
#: Labels of bytes: none, A's end, B's end, both.
LABELS = np.frombuffer(b".abx", np.uint8)
GROUP = re.compile(rb"[.ab]*x")
ALIGNED = "n_a long, n_b long, n_groups long, groups string, links array<struct<a: int, b: int, n: int>>"


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, number of pieces before each row and after the last) of texts that begin with a space."""
    offsets, raw = pieces.buffers(texts)
    first = np.zeros(len(raw), bool)
    first[1:-1] = (raw[1:-1] == 0x20) & (raw[:-2] != 0x20) & VISIBLE[raw[2:]]
    ends, begins = offsets[1:][np.diff(offsets) > 0] - 1, offsets[:-1][np.diff(offsets) > 0]
    first[ends] = False
    first[begins] = True
    at = np.flatnonzero(first)
    return pieces.split_at(at, raw), np.searchsorted(at, offsets)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


class Aligner:
    """Groups and links of pieces; see the module."""

    def __init__(self, spec: str, model: bytes):
        import sentencepiece

        self.a, self.b = Encoder(spec), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.library.encode_special_tokens = True
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names) or self.b.encode("a  b", out_type=str)[0] != "▁a" or self.b.normalize("ﬁ  ") != "▁ﬁ▁▁":
            raise ValueError("the model's tokens can reach across a space, or it changes texts")
        self.spelt = pa.array([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)], pa.large_binary())
        self.size_b, self.width = np.array([len(x) for x in self.spelt.to_pylist()]), len(names)
        self.known, self.keys = self._of(pa.array([], pa.large_binary())), pa.array([], pa.large_binary())

    def _of(self, texts: pa.Array) -> pa.Table:
        """(n_a, n_b, n_groups, bad, groups, links) of different pieces; links are A's id * width + B's id."""
        offsets, raw = pieces.buffers(texts)
        n_a, a = self.a.many(texts) if len(texts) else (np.empty(0, np.int64), np.empty(0, np.int32))
        lists = self.b.encode([x[1:].decode() for x in texts.to_pylist()], num_threads=1) if len(texts) else []
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter((i for x in lists for i in x), np.int64, int(n_b.sum()))
        size = _sums(self.size_b[b], np.concatenate([[0], np.cumsum(n_b)]))
        good = size == np.diff(offsets)
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
        own = raw[np.repeat(good, np.diff(offsets))]
        wrong = pieces.buffers(self.spelt.take(pa.array(b[keep_b])))[1] != own
        stops = np.cumsum(np.where(good, np.diff(offsets), 0))  # ends of the good pieces' bytes
        if wrong.any():  # the same length but other bytes
            good[np.searchsorted(stops, np.flatnonzero(wrong), "right")] = False
            keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
            stops = np.cumsum(np.where(good, np.diff(offsets), 0))
        a, b = a[keep_a].astype(np.int64), b[keep_b]
        label = np.zeros(stops[-1] if len(stops) else 0, np.uint8)
        label[np.cumsum(self.a.sizes[a]) - 1] += 1
        label[np.cumsum(self.size_b[b]) - 1] += 2
        ends = np.fromiter((m.end() for m in GROUP.finditer(LABELS[label].tobytes())), np.int64)  # of the spans
        named = []
        for side, ids in ((1, a), (2, b)):  # a span's labels count its tokens
            stops_ = np.concatenate([[0], np.cumsum(label & side > 0)[ends - 1]])
            named.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(stops_, pa.int32()), pa.array(ids).cast(pa.string())), ","))
        groups = pc.binary_join_element_wise(*named, "|")
        at = np.flatnonzero(label)
        is_a, is_b = label[at] & 1, label[at] >> 1
        links = a[np.cumsum(is_a) - is_a] * self.width + b[np.cumsum(is_b) - is_b]
        before = lambda places: np.concatenate([[0], np.searchsorted(places, stops, "right")])
        of_group, of_link = before(ends), before(at + 1)
        listed = pc.binary_join(pa.ListArray.from_arrays(pa.array(of_group, pa.int32()), groups), ";")
        return pa.table({
            "n_a": np.where(good, n_a, 0), "n_b": np.where(good, n_b, 0), "n_groups": np.diff(of_group), "bad": ~good, "groups": listed,
            "links": pa.LargeListArray.from_arrays(pa.array(of_link, pa.int64()), pa.array(links, pa.int64()))})

    def find(self, texts: pa.Array) -> tuple[np.ndarray, pa.Table]:
        """(each piece's row in the table, the table)."""
        at = pc.index_in(texts, value_set=self.keys)
        lacking = at.is_null().to_numpy(zero_copy_only=False)
        which = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not lacking.any():
            return which, self.known
        new = texts.filter(pa.array(lacking)).dictionary_encode()
        made = self._of(new.dictionary)
        short = pc.less_equal(pc.binary_length(new.dictionary), REMEMBERED)
        # remembered ones first, so that what is known is a slice of what is found
        order = np.argsort(~short.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which[lacking] = len(self.keys) + place[new.indices.to_numpy(zero_copy_only=False)]
        found = pa.concat_tables([self.known, made.take(pa.array(order))]).combine_chunks()
        self.keys = pa.concat_arrays([self.keys, new.dictionary.filter(short)])
        start = len(self.keys) - MEMORY // 2 if len(self.keys) > MEMORY else 0  # the later half stays
        self.known = found.slice(0, len(self.keys)) if not start else found.take(pa.array(range(start, len(self.keys))))
        self.keys = self.keys if not start else self.keys.take(pa.array(range(start, len(self.keys))))
        return which, found

    def align(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of ALIGNED for an array of texts that begin with a space."""
        cuts, rows = cut(texts)
        which, table = self.find(cuts)
        get = lambda c: table.column(c).to_numpy()
        empty = np.diff(pieces.buffers(texts)[0]) <= 1
        bad = empty | (_sums(get("bad")[which], rows) > 0)
        n_a, n_b, n_groups = (np.where(bad, 0, _sums(get(c)[which], rows)) for c in ("n_a", "n_b", "n_groups"))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), table.column("groups").combine_chunks().take(pa.array(which))), ";")
        groups = pc.if_else(pa.array(bad), "", groups)
        # different pieces of each row with their number, then different links of each row with theirs
        row = np.repeat(np.arange(len(texts)), np.diff(rows))
        keep = ~bad[row]
        seen, times = np.unique(row[keep] * len(table) + which[keep], return_counts=True)
        row, piece = np.divmod(seen, len(table))
        links = table.column("links").combine_chunks()
        starts = links.offsets.to_numpy()
        n = np.diff(starts)[piece]
        flat = links.values.to_numpy()[np.repeat(starts[:-1][piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        span = len(self.a.sizes) * self.width
        key = np.repeat(row, n) * span + flat
        order = np.argsort(key)
        key, weight = key[order], np.repeat(times, n)[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(weight, first) if len(first) else np.empty(0, np.int64)
        row, pair = np.divmod(key[first], span)
        a, b = np.divmod(pair, self.width)
        struct = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (a, b, total)], names=["a", "b", "n"])
        listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32()), struct)
        return [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)] + [groups, listed]


@lru_cache(1)
def aligner_of(spec: str, model: bytes) -> Aligner:
    """One for each Python worker, whatever the number of its tasks."""
    return Aligner(spec, model)


def _run(files):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(*files.value)
        for batch in rows:
            for a, b in pieces.slices(batch.column(1), SLICE):
                made = aligner.align(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made], names=["carried", "n_a", "n_b", "n_groups", "groups", "links"])
            pieces.trim()

    return batches


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """(carried, n_a, n_b, n_groups, groups, links): the other columns of docs in a struct; tokens of each side, groups, the groups as
    `a1,a2|b1;a3|b2,b3`, and each document's different links with their number."""
    ship(docs.sparkSession)
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # a few MB whatever the size of the data
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    source = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("carried"), F.concat(F.lit(" "), whole(text)).alias("spaced"))
    schema = T.StructType([source.schema["carried"], *T.StructType.fromDDL(ALIGNED).fields])
    return source.mapInArrow(_run(files), schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold each pair of ids linked, and whether that is the most of its A id, ties included."""
    each = aligned.select(F.explode("links").alias("x")).groupBy((F.shiftleft(F.col("x.a").cast("long"), 32) + F.col("x.b")).alias("pair")).agg(F.count("*").alias("docs"))
    own = each.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    return each.join(own, F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned, which has a column row that names its rows, with n_links, n_best and count_sum in place of links."""
    links = aligned.select("row", F.explode("links").alias("x")).select("row", (F.shiftleft(F.col("x.a").cast("long"), 32) + F.col("x.b")).alias("pair"), F.col("x.n").cast("long").alias("n"))
    told = links.join(small(counts, PAIRS), "pair").groupBy("row").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    return aligned.drop("links").join(told, "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_links", "n_best", "count_sum")})
