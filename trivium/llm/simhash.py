"""SimHash near-duplicates through Golay-code keys (operator 5).

A 64-bit fingerprint is cut in three segments of 22, 21 and 21 bits. If two fingerprints differ in
at most two bits, at least one segment is equal in both (pigeonhole) and its neighbour differs in
at most two bits. The neighbour, padded to 23 bits, is decoded by the perfect binary Golay code
[23, 12, 7]: its keys are the 12-bit indices of the code words nearest to it and to each word one
bit away, one to six in number. Two words at most two bits apart have a word between them, whose
code word both list, so they share a key. A candidate key is (which segment, its bits, an index).

Fingerprints that share a key are joined and verified. A key held by more than SMALL fingerprints is split first: each of its
fingerprints goes to the words at most one bit away from it outside the equal segment. Two that link have such a word between
them, and at most 44 fingerprints have one word in common, so a group of any size makes only pairs that link: at most 2,080 a fingerprint.

Equal fingerprints count once from the start. Defined results: null and empty texts, and texts of
white space, have fingerprint zero and link like any other; repeated rows are each returned; a null
doc_id is returned with its group's least doc_id (null if it has none); other columns are not read;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivium.llm.components import components
from trivium.llm.pieces import trim
from trivium.llm.store import materialize
from trivium.llm.text import whole
from trivium.shipping import ship

#: Generator polynomial of the code: fixed value.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are joined with each other before it is split.
SMALL = 32


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(check bits of each 12-bit message, error pattern of each 11-bit syndrome), made by rule."""

    def remainder(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        return word

    checks = np.array([remainder(m << 11) for m in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    bits = [1 << i for i in range(23)]
    for a in [0, *bits]:
        for b in [0, *bits]:
            for c in [0, *bits]:
                e = a | b | c
                errors[checks[e >> 11] ^ (e & 0x7FF)] = e
    return checks, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """Index of the one code word within three bits of each 23-bit word."""
    checks, errors = golay()
    return (words ^ errors[checks[words >> 11] ^ (words & 0x7FF)]) >> 11


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for each of the Golay keys of unsigned fingerprints."""
    at, keys = [], []
    segments = [((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    for i in range(3):
        j = (i + 1) % 3
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[j][1]))], np.int64)
        index = np.sort(nearest(segments[j][:, None] ^ flips), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, _ = np.nonzero(new)
        at.append(row)
        keys.append((np.int64(i) << 40) | (segments[i][row] << 12) | index[new])
    return np.concatenate(at), np.concatenate(keys)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the XXH64 bits of the word shingles; ties and texts without words give zero bits."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split are ASCII only
    if not words:
        return 0
    line, stops = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *stops]
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(line, seed)
    return majority(np.array([digest(line[a : b - 1], seed) for a, b in zip(starts, stops[shingle - 1 :])], np.uint64))  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, print long: the fingerprint's 64 bits as a signed integer)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            prints = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "print"]
            )
            trim()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).mapInArrow(
        batches, "doc_id long, print long"
    )


def golay_keys(prints: DataFrame) -> DataFrame:
    """(print, key) for each row of prints(print)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, keys = keys_of(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(values[at]), pa.array(keys)], names=["print", "key"])

    return prints.select("print").mapInArrow(batches, "print long, key long")


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """All links (a, b), a < b, between different fingerprints of prints(print) at most max_bits apart."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2: the keys are complete up to two differing bits")
    keys = materialize(golay_keys(prints), "golay_keys")
    held = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keys.join(held, "key"), "shared_keys")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    few = shared.where(F.col("n") <= SMALL).select("key", "print")
    # a key's top bits tell its equal segment; crowded keys with the same one are split together
    crowded = shared.where(F.col("n") > SMALL).select(F.shiftright("key", 40).alias("part"), "print").distinct()
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64) if not start <= b < start + n]) for start, n in SEGMENTS])
    between = crowded.select("part", "print", F.explode(F.get(flips, F.col("part").cast("int"))).alias("flip")).select(
        F.struct("part", F.col("print").bitwiseXOR(F.col("flip")).alias("word")).alias("key"), "print")
    both = lambda df: df.select("key", F.col("print").alias("a")).join(df.select("key", F.col("print").alias("b")), "key").where("a < b").where(near).select("a", "b")
    return both(few).unionByName(both(between)).distinct()


def groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, print, component_id): component_id is the least doc_id reachable by links."""
    held = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    classes = materialize(held.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    part = components(links(classes, max_bits)).withColumnRenamed("node", "print")
    rooted = classes.join(part, "print")
    least = rooted.groupBy("component").agg(F.min("least").alias("root"))
    moved = rooted.join(least, "component").select("print", "root")
    labels = materialize(
        classes.join(moved, "print", "left").select("print", F.coalesce("root", "least").alias("component_id")), "labels"
    )
    return held.join(labels, "print").select("doc_id", "print", "component_id")
