"""Removal of repeated passages with suffix automata of reference shards (operator 12).

A window is so many consecutive words of one document. Words are removed that a window covers whose words also start earlier: in a
smaller document, or before in the same one. The corpus is its own reference, cut down to what can repeat and dealt to shards:

1. each window has a fingerprint: the hash of the least of its grams, so equal windows share it wherever they stand. Consecutive
   windows of one gram are a segment, of window to 2 window - gram words. Only segments of fingerprints that occur twice go on;
2. equal segments count once, at their earliest place. Where a fingerprint has several segments, hashes of their windows
   tell which windows occur twice. The earliest place of each such window is a reference;
3. references are dealt by place, CELL words of a document at a time, to shards of about SHARD windows. A task builds a shard's suffix
   automaton, whose states know where they end first; it is stored once and sent to each slice of the segments that it concerns;
4. the segments stream through the automaton, a document's neighbours as one text, for their matching statistics: where at least a
   window's words match, the state names the reference, whose words are equal, not only its hash. Maximal spans of such matches
   go back to all places of the segment, and each place loses the words of its spans, unless it is the reference itself.

Nothing grows in one task: a passage that a third of all documents hold is one reference, and its places meet their spans in joins that
adaptive execution splits; shards and slices have their size whatever the input. A repeated window is missed only if another of its
fingerprint has its 64-bit hash; equal segments are equal in 128 bits of hash.

Defined results: white space is the six ASCII characters; a null or empty text, or one of fewer words than a window, keeps its
words; documents are ordered by doc_id and then by a hash of their text; a null doc_id counts as the least number; rows equal
in both are one document and each returned; other columns are carried along, whatever their names; an empty table gives an empty
one; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivium.llm import pieces
from trivium.llm.store import mark, materialize, release, settled
from trivium.llm.text import carried, restored, whole
from trivium.schema import small
from trivium.shipping import ship

#: Words of a gram, windows of references in a shard, of segments in a slice, of a document that go to one shard; bytes of text handled at a time.
GRAM, SHARD, STREAM, CELL, SLICE = 8, 100_000, 1_000_000, 4096, 1 << 21
LEAST = -(1 << 63)
PLACE = "doc long, th long, at int"
SEGMENT = f"fp long, seg long, {PLACE}, n int"
AUTOMATON = "shard int, words array<binary>, edges array<long>, targets array<int>, links array<int>, lengths array<int>, firsts array<int>, starts array<int>, docs array<long>, ths array<long>, ats array<int>"
SPANS = "fp long, seg long, spans array<struct<i: int, n: int, doc: long, th: long, at: int>>"

_SEEDS = np.random.default_rng(12).integers(1, 1 << 63, 256 + 4096, dtype=np.uint64) * 2 + 1
_BYTE, _POSITION = _SEEDS[:256], _SEEDS[256:]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of an array of texts: plain has their bytes with a space after each, at their starts there, rows the words before each row."""

    def __init__(self, texts: pa.Array):
        cut, self.rows = pieces.cut_words(texts)
        offsets, raw = pieces.buffers(cut)
        size = np.diff(offsets)
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        self.plain = np.full(self.at[-1], 0x20, np.uint8)
        self.plain[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
        self.offsets, self.raw, self.text = offsets, raw, self.plain.tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size, out, start = np.diff(self.offsets), np.empty(len(self.offsets) - 1, np.uint64), 0
        while start < len(out):  # a bounded number of bytes at a time, or one word
            stop = max(start + 1, int(np.searchsorted(self.offsets, self.offsets[start] + SLICE, "right")) - 1)
            a = self.offsets[start]
            place = np.arange(self.offsets[stop] - a) - np.repeat(self.offsets[start:stop] - a, size[start:stop])
            out[start:stop] = np.add.reduceat(_BYTE[self.raw[a : self.offsets[stop]]] * _POSITION[place & 4095], self.offsets[start:stop] - a)
            start = stop
        return _mix(out + size.astype(np.uint64))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums from which the hash of any run of words follows, and factors that free it of its place."""
        h = self.hashes()
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)]), _powers(_INVERSE, len(h) + 1)


def _runs(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hashes of the words from start to stop."""
    total, factor = sums
    return _mix((total[stop] - total[start]) * factor[start] + (stop - start).astype(np.uint64))


def _segments(texts: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """(row, fp, seg, at, n) of all segments; at counts words within the row."""
    words = Words(texts)
    n, span = words.rows[-1], window - GRAM + 1
    if n < window:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    sums, at = words.sums(), np.arange(n - GRAM + 1)
    grams = _runs(sums, at, at + GRAM)
    start = np.arange(n - window + 1)
    row = np.searchsorted(words.rows, start, "right") - 1
    least = start + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1)
    ok = start + window <= words.rows[row + 1]
    start, row, least = start[ok], row[ok], least[ok]
    first = np.flatnonzero((np.diff(least, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    count = np.diff(first, append=len(start))
    begin, row = start[first], row[first]
    seg = _runs(sums, begin, begin + count + window - 1)
    return row, grams[least[first]].view(np.int64), seg.view(np.int64), begin - words.rows[row], count


def _fingerprint(window: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b in pieces.slices(batch.column(2), SLICE):
                part = batch.slice(a, b - a)
                row, fp, seg, at, n = _segments(part.column(2), window)
                doc, th = (part.column(k).take(pa.array(row)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(seg), doc, th, pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["fp", "seg", "doc", "th", "at", "n"])
            pieces.trim()

    return batches


def segments(docs: DataFrame, window: int = 20) -> DataFrame:
    """SEGMENT rows of docs (doc, th, text)."""
    if window <= GRAM:
        raise ValueError(f"a window needs more than {GRAM} words")
    return docs.select("doc", "th", "text").mapInArrow(_fingerprint(window), SEGMENT)


def repeated_places(found: DataFrame) -> DataFrame:
    """The segments whose fingerprint occurs twice or more."""
    twice = found.groupBy("fp").agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    return found.join(twice.hint("merge"), "fp")


def distinct_segments(places: DataFrame) -> DataFrame:
    """(fp, seg, doc, th, at, n, c, alone): equal segments once, at their earliest place, with their number; alone: no other has the fingerprint."""
    once = places.groupBy("fp", "seg").agg(F.min(F.struct("doc", "th", "at")).alias("p"), F.max("n").alias("n"), F.count("*").alias("c"))
    spread = once.groupBy("fp").agg((F.min("seg") == F.max("seg")).alias("alone"))
    return once.join(spread.hint("merge"), "fp").select("fp", "seg", "p.doc", "p.th", "p.at", "n", "c", "alone")


def _cut(window: int):
    """For documents and their segments' places: the segments' words and the hashes of their windows."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b in pieces.slices(batch.column(2), SLICE):
                part = batch.slice(a, b - a)
                words, lists = Words(part.column(2)), part.column(3)
                sums, each = words.sums(), lists.flatten()
                fp, seg, at, n, c, alone = (each.field(k) for k in range(6))
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                count = n.to_numpy().astype(np.int64)
                start = words.rows[row] + at.to_numpy()
                left, right = words.at[start].tolist(), (words.at[start + count + window - 1] - 1).tolist()
                text = pa.array([words.text[x:y] for x, y in zip(left, right, strict=True)], pa.binary())
                count[alone.to_numpy(zero_copy_only=False)] = 0  # all their windows are references
                stops = np.cumsum(count)
                flat = np.repeat(start - (stops - count), count) + np.arange(stops[-1] if len(stops) else 0)
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(_runs(sums, flat, flat + window).view(np.int64)))
                doc, th = (part.column(k).take(pa.array(row)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([fp, seg, doc, th, at, n, c, alone, text, hashes], names=["fp", "seg", "doc", "th", "at", "n", "c", "alone", "words", "hashes"])
            pieces.trim()

    return batches


def cut_segments(distinct: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """distinct with words binary, joined by a space, and hashes array<long>, one a window where it isn't alone; equal documents give equal rows."""
    lists = distinct.groupBy("doc", "th").agg(F.collect_list(F.struct("fp", "seg", "at", "n", "c", "alone")).alias("found"))  # a document's own
    joined = docs.join(lists.hint("merge"), ["doc", "th"]).select("doc", "th", "text", "found")
    return joined.mapInArrow(_cut(window), SEGMENT + ", c long, alone boolean, words binary, hashes array<long>")


def _cell(doc: Column, th: Column, at: Column) -> Column:
    """What is dealt to one shard: the references of so many words of a document."""
    return F.xxhash64(doc, th, F.call_function("div", at, F.lit(CELL)))


def with_references(cut: DataFrame) -> DataFrame:
    """cut with refs, the windows of a segment that are the earliest of their words and occur twice or more, and cells, where the earliest
    places of all its windows that occur twice or more belong, in place of hashes."""
    each = cut.where("not alone").select("fp", "seg", "doc", "th", "at", "c", F.posexplode("hashes").alias("i", "h"))
    first = each.groupBy("fp", "h").agg(F.min(F.struct("doc", "th", (F.col("at") + F.col("i")).alias("at"), "seg", "i")).alias("p"), F.sum("c").alias("c")).where("c > 1")
    own = F.when((F.col("p.seg") == F.col("seg")) & (F.col("p.i") == F.col("i")), F.col("i"))
    told = each.select("fp", "seg", "i", "h").join(first.select("fp", "h", "p").hint("merge"), ["fp", "h"]).groupBy("fp", "seg").agg(
        F.collect_set(_cell(F.col("p.doc"), F.col("p.th"), F.col("p.at") - F.col("p.i"))).alias("cells"), F.sort_array(F.collect_set(own)).alias("own"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    kept = ["fp", "seg", "doc", "th", "at", "n", "words"]
    mixed = cut.where("not alone").select(*kept).join(told.hint("merge"), ["fp", "seg"], "left").select(*kept, none("own", "int"), none("cells", "long"))
    single = cut.where("alone").select(*kept, F.sequence(F.lit(0), F.col("n") - 1).alias("own"), F.array(_cell(F.col("doc"), F.col("th"), F.col("at"))).alias("cells"))
    return single.unionByName(mixed).withColumnRenamed("own", "refs")


class Automaton:
    """Suffix automaton of passages of words, with the place where each state's words end first."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.size, self.last = 0, 0

    def _add(self, added: Iterable[int]) -> None:
        nxt, link, length, first, size, last = self.next, self.link, self.length, self.first, self.size, self.last
        for code in added:
            cur, p = len(nxt), last
            nxt.append({})
            length.append(length[p] + 1)
            first.append(size)
            while p >= 0 and code not in nxt[p]:
                nxt[p][code] = cur
                p = link[p]
            if p < 0:
                link.append(0)
            else:
                q = nxt[p][code]
                if length[q] == length[p] + 1:
                    link.append(q)
                else:
                    clone = cur + 1
                    link += [clone, link[q]]
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    first.append(first[q])
                    while p >= 0 and nxt[p].get(code) == q:
                        nxt[p][code] = clone
                        p = link[p]
                    link[q] = clone
            last = cur
            size += 1
        self.size, self.last = size, last

    def extend(self, words: list[bytes]) -> None:
        codes = self.codes
        self._add([codes.setdefault(w, len(codes)) for w in words])

    def close(self) -> None:
        """End a passage. What stands between passages occurs once and matches nothing."""
        self._add([-1 - self.size])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(state * words + word, target) of all transitions by a word."""
        width = len(self.codes)
        edges = np.fromiter((s * width + c for s, d in enumerate(self.next) for c in d if c >= 0), np.int64)
        return edges, np.fromiter((t for d in self.next for c, t in d.items() if c >= 0), np.int64)


def _build(window: int):
    def automaton(group: pa.Table) -> pa.Table:
        """The automaton of a shard; windows that follow each other in a document share their words."""
        sam, starts, docs, ths, ats = Automaton(), [], [], [], []
        last = None  # the document and window that would go on with the passage
        group = group.sort_by([(c, "ascending") for c in ("doc", "th", "at")])
        for doc, th, at, words, refs in zip(*(group.column(c).to_pylist() for c in ("doc", "th", "at", "words", "refs")), strict=True):
            split = words.split(b" ")
            whole_ = refs[-1] - refs[0] + 1 == len(refs)
            for a, b in [(refs[0], refs[-1])] if whole_ else [(int(x[0]), int(x[-1])) for x in np.split(refs, np.flatnonzero(np.diff(refs) != 1) + 1)]:
                if last == (doc, th, at + a):
                    sam.extend(split[a + window - 1 : b + window])
                elif last is None or last[:2] != (doc, th) or last[2] < at + a:  # not a row of an equal document
                    if last:
                        sam.close()
                    starts.append(sam.size), docs.append(doc), ths.append(th), ats.append(at + a)
                    sam.extend(split[a : b + window])
                else:
                    continue
                last = (doc, th, at + b + 1)
        edges, targets = sam.edges()
        # steps instead of the numbers themselves: most are 1, which packs well
        order = np.argsort(edges)
        step = lambda x: np.diff(x, prepend=0)
        row = [group.column("shard")[0].as_py(), list(sam.codes), step(edges[order]), step(targets[order]), sam.link, step(sam.length), step(sam.first), starts, docs, ths, ats]
        kinds = {"int": pa.int32(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        return pa.table({name: pa.array([v], kinds[kind]) for (name, kind), v in zip(map(str.split, AUTOMATON.split(", ")), row, strict=True)})

    return automaton


def _match(window: int):
    """Spans of windows of each segment that the shard's automaton holds."""
    def spans(automata: pa.Table, group: pa.Table) -> pa.Table:
        fps, segs, sizes, flat, starts, docs, ths, ats = [], [], [], [], *(np.empty(0, np.int64) for _ in range(4))
        if automata.num_rows and group.num_rows:
            get = lambda c: automata.column(c)[0].values
            codes = {w: i for i, w in enumerate(get("words").to_pylist())}
            summed = lambda c: np.cumsum(get(c).to_numpy().astype(np.int64)).tolist()
            step = dict(zip(summed("edges"), summed("targets"), strict=True))
            link, length, first = get("links").to_pylist(), summed("lengths"), summed("firsts")
            starts, docs, ths, ats = (get(c).to_numpy() for c in ("starts", "docs", "ths", "ats"))
            width, last, state, matched = len(codes), None, 0, 0
            group = group.sort_by([(c, "ascending") for c in ("doc", "th", "at")])
            for fp, seg, doc, th, at, n, words in zip(*(group.column(c).to_pylist() for c in ("fp", "seg", "doc", "th", "at", "n", "words")), strict=True):
                split, e = words.split(b" "), 0
                if last == (doc, th, at):  # goes on with the document's segment before, whose last words it shares
                    e = window - 1
                else:
                    state = matched = 0
                last = (doc, th, at + n)
                found: list[list[int]] = []  # [window, number, place of its first word in the automaton's text]
                for e in range(e, len(split)):
                    code = codes.get(split[e])
                    if code is None:
                        state = matched = 0
                        continue
                    to = step.get(state * width + code)
                    while to is None and state:
                        state = link[state]
                        matched = length[state]
                        to = step.get(state * width + code)
                    if to is None:
                        matched = 0
                        continue
                    state, matched = to, matched + 1
                    if matched >= window:
                        i, place = e - window + 1, first[state] - window + 1
                        if found and found[-1][0] + found[-1][1] == i and found[-1][2] + found[-1][1] == place:
                            found[-1][1] += 1
                        else:
                            found.append([i, 1, place])
                if found:
                    fps.append(fp), segs.append(seg), sizes.append(len(found))
                    flat += found
        i, n, place = np.array(flat, np.int64).reshape(-1, 3).T
        k = np.searchsorted(starts, place, "right") - 1
        columns = {"i": (i, pa.int32()), "n": (n, pa.int32()), "doc": (docs[k], pa.int64()), "th": (ths[k], pa.int64()), "at": (ats[k] + place - starts[k], pa.int32())}
        struct = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in columns.values()], names=list(columns))
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), struct)
        return pa.table({"fp": pa.array(fps, pa.int64()), "seg": pa.array(segs, pa.int64()), "spans": listed})

    return spans


def matches(cut: DataFrame, window: int) -> DataFrame:
    """(fp, seg, spans) of the segments that hold windows of the references; cut is a stored table with refs and cells."""
    total = cut.agg(F.coalesce(F.sum(F.size("refs")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD))
    to = lambda cell: F.pmod(cell, F.lit(shards)).cast("int")
    refs = cut.where(F.size("refs") > 0).select(to(_cell(F.col("doc"), F.col("th"), F.col("at"))).alias("shard"), "doc", "th", "at", "words", "refs")
    automata = settled(materialize(refs.groupBy("shard").applyInArrow(_build(window), AUTOMATON), "automata"))
    dealt = cut.select(F.explode(F.array_distinct(F.transform("cells", to))).alias("shard"), "fp", "seg", "doc", "th", "at", "n", "words")
    sizes = small(dealt.groupBy("shard").agg(F.ceil(F.sum("n") / STREAM).cast("int").alias("slices")))
    sent = automata.join(sizes, "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).drop("slices")
    stream = dealt.join(sizes, "shard").withColumn("slice", F.pmod(F.xxhash64("doc", "th", F.call_function("div", F.col("at"), F.lit(CELL))), F.col("slices")).cast("int")).drop("slices")
    return sent.groupBy("shard", "slice").cogroup(stream.groupBy("shard", "slice")).applyInArrow(_match(window), SPANS)


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc, th, gone array<struct<a, b>>): ranges of words of each document that windows cover whose words also start earlier."""
    spark = docs.sparkSession
    places = settled(materialize(repeated_places(segments(docs, window)), "places"))
    start = mark(spark)
    distinct = settled(materialize(distinct_segments(places), "distinct_segments"))
    segments_ = settled(materialize(cut_segments(distinct, docs, window), "segments"))
    stop = mark(spark)
    cut = settled(materialize(with_references(segments_), "referring"))
    release(spark, start, stop)
    found = settled(materialize(matches(cut, window), "spans"))
    release(spark, stop, mark(spark) - 1)  # all but the spans
    met = places.join(found.hint("merge"), ["fp", "seg"]).select("doc", "th", "at", F.explode("spans").alias("s"))
    later = met.where(~((F.col("s.doc") == F.col("doc")) & (F.col("s.th") == F.col("th")) & (F.col("s.at") == F.col("at") + F.col("s.i"))))
    start = F.col("at") + F.col("s.i")
    return later.groupBy("doc", "th").agg(F.collect_set(F.struct(start.alias("a"), (start + F.col("s.n") + window - 1).alias("b"))).alias("gone"))


def _drop(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(carried, kept, n_words, n_removed) of (carried, text, gone)."""
    for batch in rows:
        for a, b in pieces.slices(batch.column(1), SLICE):
            part = batch.slice(a, b - a)
            words, gone = Words(part.column(1)), part.column(2)
            n, ranges = len(words.at) - 1, gone.flatten()
            base = np.repeat(words.rows[:-1], gone.fill_null([]).value_lengths().to_numpy())
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, base + ranges.field(0).to_numpy(), 1)
            np.add.at(steps, base + ranges.field(1).to_numpy(), -1)
            removed = np.cumsum(steps)[:n] > 0
            count = np.diff(words.rows)
            lost = np.diff(np.concatenate([[0], np.cumsum(removed)])[words.rows])
            size = np.diff(words.at)
            plain = words.plain[np.repeat(~removed, size)].tobytes()
            stops = np.concatenate([[0], np.cumsum(np.where(removed, 0, size))])[words.rows]
            kept = [plain[x : max(x, y - 1)] for x, y in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(lost, pa.int64())], names=["_carried", "_kept", "_n_words", "_n_removed"])
        pieces.trim()


def dedup(docs: DataFrame, text: str = "text", window: int = 20) -> DataFrame:
    """docs with the kept words joined by one space as their text, and n_words, n_removed long."""
    ship(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc")
    body = whole(text)
    keyed = docs.select(doc, F.xxhash64(body).alias("th"), body.alias("text"))
    gone = repeats(keyed, window)
    held = carried(docs, text).select("_carried", F.col(text).alias("_text"))
    id_ = F.coalesce(F.col("_carried.doc_id").cast("long"), F.lit(LEAST))
    met = held.select("_carried", whole("_text").alias("text"), id_.alias("doc"), F.xxhash64(whole("_text")).alias("th")).join(gone.hint("merge"), ["doc", "th"], "left")
    schema = T.StructType([held.schema["_carried"]]).add("_kept", "string").add("_n_words", "long").add("_n_removed", "long")
    done = met.select("_carried", "text", "gone").mapInArrow(_drop, schema)
    return restored(done, docs, {text: F.col("_kept")}, n_words=F.col("_n_words"), n_removed=F.col("_n_removed"))
