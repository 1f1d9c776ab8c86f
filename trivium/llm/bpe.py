"""Byte-pair encoding and decoding of whole texts (operator 4).

A word is a doubly linked list of symbols. A priority queue holds (merge rank, position); the
lowest rank is merged first, leftmost first, and entries that a former merge has made stale are
skipped when they surface. Decoding concatenates vocabulary strings, joined as the tokenizer file
says. Texts are normalised and split in words by the tokenizers library. Words repeat, so each distinct
piece of a batch is encoded once and a Python worker remembers a bounded number of them; the
memory changes no result.

Defined results: null and empty texts have no ids and decode to the empty string; texts of any
length are encoded whole; repeated rows each give a row; an empty table gives an empty table; an input
column that clashes with an output column is replaced by it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivium.llm import pieces
from trivium.llm.pieces import REMEMBERED, Memory
from trivium.llm.text import carried, restored, whole
from trivium.shipping import ship

#: Words that a worker remembers.
WORDS = 100_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def merge_word(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Merge adjacent symbols by rank.

    merges: pair (left << 20 | right) -> rank << 20 | merged symbol. An entry of the queue is that value and the
    pair's position in one integer, so the order is by rank, then from the left. An entry is stale if its
    symbol has gone (-1) or its pair is no longer the one it was made for.
    """
    n, get = len(symbols), merges.get
    queue = []
    for i in range(n - 1):
        found = get(symbols[i] << 20 | symbols[i + 1])
        if found is not None:
            queue.append(found << 32 | i)
    if not queue:
        return symbols
    heapify(queue)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    while queue:
        entry = heappop(queue)
        i, made = entry & 0xFFFFFFFF, entry >> 32
        j, symbol = right[i], symbols[i]
        if symbol < 0 or j >= n or get(symbol << 20 | symbols[j]) != made:
            continue
        symbol = symbols[i] = made & 0xFFFFF
        symbols[j] = -1
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            found = get(symbol << 20 | symbols[after])
            if found is not None:
                heappush(queue, found << 32 | i)
        before = left[i]
        if before >= 0:
            found = get(symbols[before] << 20 | symbol)
            if found is not None:
                heappush(queue, found << 32 | before)
    return [s for s in symbols if s >= 0]


class BPE:
    """The tokenizer that a tokenizers-library JSON text describes: BPE over words that hold no white space.

    Normalizing and splitting in words are the library's own, so letters, cases and canonical forms are its too; the
    merges are ours. Raises ValueError for files whose tokens can reach across white space.
    """

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        library, spec = Tokenizer.from_str(spec), json.loads(spec)
        if spec["normalizer"] is None:
            raise ValueError("the file's tokens can hold white space")
        model, added = spec["model"], spec["added_tokens"]
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in added}
        if self.split("a b")[-1][0] != "b" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added):
            raise ValueError("the file's tokens can hold white space")
        if max([*self.vocab.values(), *self.added.values()]) >= 1 << 20:
            raise ValueError("ids beyond 2**20 don't fit in the pairs that merges are looked up by")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        v = self.vocab
        self.merges = {v[a] << 20 | v[b]: r << 20 | v[a + b] for r, (a, b) in enumerate(merges)}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        names = {i: t for t, i in (v | self.added).items()}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self.words: dict[str, bytes] = {}
        self.memory = Memory(self.pieces)

    def word(self, word: str) -> bytes:
        """The packed ids of one word, in the characters that stand for its bytes."""
        ids = self.words.get(word)
        if ids is None:
            ids = array("i", merge_word([self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]], self.merges)).tobytes()
            if len(word) <= REMEMBERED:
                self.words[word] = ids
        return ids

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids) of texts without ASCII white space: all are split in words at once, with a space between them."""
        if len(self.words) > WORDS:
            self.words.clear()
        plain = [t.decode() for t in texts.to_pylist()]
        parts, special = [1] * len(plain), {}
        if self.specials.search(" ".join(plain)):  # special tokens are taken out first; split gives plain and special parts by turns
            split = [self.specials.split(t) for t in plain]
            parts, plain = list(map(len, split)), [p for x in split for p in x]
            special = {k: self.added[p] for k, p in enumerate(plain) if p in self.added}
            plain = ["" if p in self.added else p for p in plain]
        plain = list(map(self.normalize, plain))
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
        words = self.split(" ".join(plain))
        at = np.searchsorted(ends, np.fromiter((x[1][0] for x in words), np.int64, len(words)), "right")
        found = [self.word(w) for w, _ in words]
        if special:  # in their places among the words
            at = np.concatenate([at, np.fromiter(special, np.int64, len(special))])
            found += [array("i", [i]).tobytes() for i in special.values()]
            order = np.argsort(at, kind="stable")
            at, found = at[order], [found[k] for k in order.tolist()]
        sizes = np.bincount(at, np.fromiter(map(len, found), np.int64, len(found)), len(plain)).astype(np.int64) // 4
        if len(parts) < len(plain):
            sizes = np.add.reduceat(sizes, np.cumsum(parts) - parts)
        return sizes, np.frombuffer(b"".join(found), np.int32)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Lists of ids for a string array without nulls."""
        offsets, ids = pieces.encode(texts, pieces.cut_words, self.memory)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, lists: pa.Array) -> pa.Array:
        """Vocabulary strings, joined by a space where the file names no decoder; special tokens stay, unknown ids go."""
        ids, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        known = (ids >= 0) & (ids < len(self.names))
        known[known] = self.names.take(pa.array(ids[known])).is_valid().to_numpy(zero_copy_only=False)
        strings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(known)])[offsets], pa.int32()), self.names.take(pa.array(ids[known])))
        return pc.binary_join(strings, " ")


@lru_cache(1)
def bpe_of(spec: str) -> BPE:
    """One tokenizer, and its memory of words, for each Python worker, whatever the number of its tasks."""
    return BPE(spec)


def _run(spec, column: str, encode: bool, decode: bool):
    """A mapInArrow function that appends ids (from the text in column) and, or, their decoded string."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(spec.value)
        for batch in rows:
            source = batch.column(batch.schema.get_field_index(column if encode else "ids"))
            for a, b in pieces.slices(source) if encode else [(0, len(source))]:
                part = batch.slice(a, b - a)
                ids = bpe.encode(source.slice(a, b - a)) if encode else part.column(part.schema.get_field_index("ids"))
                columns, names = list(part.columns), list(part.schema.names)
                if encode:
                    drop = names.index(column)
                    columns.pop(drop), names.pop(drop)
                    columns.append(ids), names.append("ids")
                if decode:
                    columns.append(bpe.decode(ids)), names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            pieces.trim()

    return batches


def _vocabulary(df: DataFrame, path: str):
    """The tokenizer file, read once by the driver: a few MB whatever the size of the data."""
    ship(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs without the text, with ids array<int>; decoded=True adds what the ids decode to, as a string."""
    held = carried(docs, text).select("_carried", whole(F.col(f"`{text}`")).alias("_whole"))
    schema = T.StructType(held.schema.fields[:-1]).add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("decoded", T.StringType()) if decoded else schema
    done = held.mapInArrow(_run(_vocabulary(docs, path), "_whole", True, decoded), schema)
    return restored(done, docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in {"ids", "decoded", text.lower()}]), **{c: F.col(c) for c in schema.names[1:]})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded, which has ids, with the decoded string; null ids decode to the empty string."""
    held = carried(encoded, "ids").select("_carried", "ids")
    done = held.mapInArrow(_run(_vocabulary(encoded, path), "", False, True), T.StructType(list(held.schema.fields)).add("decoded", T.StringType()))
    return restored(done, encoded, decoded=F.col("decoded"))


def digests(coded: DataFrame) -> DataFrame:
    """The contract's columns from an operator's ids and decoded strings, on the JVM."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
