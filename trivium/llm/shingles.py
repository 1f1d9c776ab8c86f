"""Near-duplicates by SimHash groups and the exact similarity of word shingles (the pipeline's stage of operator 5).

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is at least 0.8. Texts so similar differ in
up to a dozen of 64 fingerprint bits, more than Golay keys of a fingerprint can bridge, so the stage has two sources of candidates:

* the groups of operator 5 (simhash.links over five-word fingerprints): each text with its group's first one;
* a prefix filter, which is complete: put in one order for all texts, the first n - ceil(0.8 * n) + 1 of a text's n
  shingles hold one that any text so similar has among its own first ones.

Candidates of both are verified alike. Each text has parities of its shingles, about a bit a shingle; two texts differ in at least as
many shingles as parities, so nearly all candidates that aren't alike go without their texts being read. The others
are compared by the 64-bit hashes of all their shingles.

The order puts shingles that are common in a sample of the texts last, so a passage of many texts makes no candidates of
them; the sample decides on work only, as any order gives the same links. Equal texts count once. Where a text's first
shared shingle stands late in its order, it has too few left for the similarity (positional filter), so copies with many changes of
one text aren't paired with each other. A shingle held by up to SMALL texts makes all pairs that are left so. One held by more first
makes pairs with the one that holds it earliest, mostly the text of which the others are copies; once all these are
linked, only pairs that are still in different components are left to verify.

Defined results: words and white space are as in simhash; a text of fewer than five words is one shingle; null, empty
and blank texts are equal. Rows are told apart by themselves, not by doc_id: of each group the row with the least doc_id stays,
rows without one last, then the least hash of the text; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivium.llm import simhash
from trivium.llm.components import components
from trivium.llm.pieces import trim
from trivium.llm.store import materialize
from trivium.llm.text import unused, whole
from trivium.shipping import ship

WIDTH = 5
#: Texts of one shingle that are all paired with each other, and the least number of a text's parities.
SMALL, BITS = 16, 256
#: One text in SAMPLE is counted for the order, and shingles of at least COMMON of these are put last, HEAVIEST at most.
SAMPLE, COMMON, HEAVIEST = 16, 6, 200_000
ROW = "_trivium_row"


def pieces(text: str, width: int = WIDTH) -> tuple[bytes, list[bytes]]:
    """(the words in lower case with single spaces, their shingles)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    if len(words) < width:
        return line, [line] if words else []
    stops = np.cumsum([len(w) + 1 for w in words]).tolist()
    return line, [line[a : b - 1] for a, b in zip([0, *stops], stops[width - 1 :])]  # noqa: B905


@lru_cache(8)
def shingle_hashes(text: str) -> np.ndarray:
    """The sorted different hashes of a text's shingles."""
    return np.unique(_hashes(pieces(text)[1]))


def alike(a: str, b: str) -> bool:
    """Whether the Jaccard similarity is at least 0.8."""
    x, y = shingle_hashes(a), shingle_hashes(b)
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * common >= 4 * (len(x) + len(y) - common)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 * n) + 1 of n different sorted hashes, common ones last."""
    n = len(hashes)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = common[at] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: n - -(-4 * n // 5) + 1] if n else hashes


def parities(hashes: np.ndarray) -> np.ndarray:
    """A power of two bits, at least one for each hash, as signed integers: whether an odd number of hashes falls on each."""
    bits = max(BITS, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(16)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _hashes(shingles: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many of the sampled texts hold."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py()).view(np.int64))], names=["h"])
            trim()

    sampled = texts.where(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(SAMPLE)) == 0).select("text")
    counted = sampled.mapInArrow(batches, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    heaviest = counted.orderBy(F.desc("count"), "h").limit(HEAVIEST).select("h").toPandas()["h"]
    return np.sort(heaviest.to_numpy(np.int64).view(np.uint64))


def shingled(texts: DataFrame) -> DataFrame:
    """(row, doc_id, h1, h2, n, print, bits, keys) of texts(row, doc_id, text): hashes of the words, number of shingles, fingerprint, parities, prefix."""
    common = common_shingles(texts)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in rows:
            h1, h2, n, prints, bits, keys = [], [], [], [], [], []
            for t in batch.column(2):
                line, shingles = pieces(t.as_py())
                digest, every = xxhash.xxh3_128_intdigest(line), _hashes(shingles)
                hashes = np.unique(every)
                h1.append(digest >> 64)
                h2.append(digest & (1 << 64) - 1)
                n.append(len(hashes))
                prints.append(simhash.majority(every))
                bits.append(parities(hashes))
                keys.append(prefix(hashes, common).view(np.int64))
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), signed(h1), signed(h2), pa.array(n, pa.int64()), signed(prints), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "doc_id", "h1", "h2", "n", "print", "bits", "keys"])
            trim()

    return texts.select("row", "doc_id", "text").mapInArrow(batches, "row long, doc_id long, h1 long, h2 long, n long, print long, bits array<long>, keys array<long>")


def _differing(a: str, b: str):
    """The number of parities in which two texts differ; the one with more is folded first (lengths allow twice as many)."""
    def folded(x, y):
        half = F.floor(F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    bits = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda t, x: t + x)


def _close(a, b):
    """Whether two numbers of shingles allow the similarity."""
    return (5 * F.least(a, b)) >= (4 * F.greatest(a, b))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts(row, text) are alike; nodes(row, n, bits) rule out most others."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            good = [alike(a.as_py(), b.as_py()) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            trim()

    side = lambda df, c, s: df.select(F.col("row").alias(s), *[F.col(x).alias(f"{x}_{s}") for x in c])
    # alike texts have at most a ninth of their shingles, counted in both, in one only
    possible = materialize(pairs.join(side(nodes, ("n", "bits"), "a"), "a").join(side(nodes, ("n", "bits"), "b"), "b").where(_close(F.col("n_a"), F.col("n_b"))).where(
        9 * _differing("bits_a", "bits_b") <= F.col("n_a") + F.col("n_b")).select("a", "b"), "possible_pairs")
    held = materialize(texts.join(possible.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "row", "left_semi"), "candidate_texts")
    met = possible.join(side(held, ("text",), "a"), "a").join(side(held, ("text",), "b"), "b").select("a", "b", "text_a", "text_b")
    return materialize(met.mapInArrow(batches, "a long, b long"), "alike")


def simhash_stars(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text with the first one of its group by operator 5; not verified yet."""
    prints = materialize(nodes.groupBy("print").agg(F.min("row").alias("first")), "prints")
    part = components(simhash.links(prints)).withColumnRenamed("node", "print")
    root = prints.join(part, "print", "left").withColumn("group", F.coalesce("component", "print"))
    least = root.groupBy("group").agg(F.min("first").alias("a"))
    return nodes.select("row", "print").join(root.join(least, "group").select("print", "a"), "print").where("a < row").select("a", F.col("row").alias("b"))


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between alike texts of nodes(row, n, print, bits, keys): all links, or enough of them for the same components."""
    # a shingle's place and the text's number of shingles share one column
    held = nodes.select(F.posexplode("keys").alias("pos", "key"), "row", "n").select("key", "row", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))
    shared = held.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    members = materialize(held.join(materialize(shared, "shared_shingles"), "key").select(
        "key", "row", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("pos"), "held"), "members")
    few, many = members.where(F.col("held") <= SMALL).drop("held"), members.where(F.col("held") > SMALL).drop("held")
    # what the first common shingle leaves of both texts must hold all that alike texts have in common
    enough = 9 * F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("other_pos")) >= 4 * (F.col("n") + F.col("m"))
    other = lambda df: df.select("key", F.col("row").alias("other"), F.col("n").alias("m"), F.col("pos").alias("other_pos"), *[c for c in df.columns if c not in members.columns])
    paired = lambda df: df.where(enough).select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()
    each = few.join(other(few), "key").where("row < other")
    lead = many.groupBy("key").agg(F.min(F.struct("pos", F.xxhash64("row").alias("h"), "row", "n")).alias("x")).select("key", "x.*")
    led = many.join(other(lead.drop("h")), "key").where("row <> other")
    first = verified(materialize(paired(each).unionByName(paired(led)).unionByName(simhash_stars(nodes)).distinct(), "pairs"), nodes, texts)
    if many.isEmpty():
        return first
    part = materialize(components(first), "parts")
    flat = many.join(part.withColumnRenamed("node", "row"), "row", "left").withColumn("part", F.coalesce("component", "row")).drop("component")
    flat = materialize(flat, "crowded")
    largest = flat.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = materialize(flat.join(largest.select("key", "main"), "key"), "open")
    # texts of a shingle meet by length: alike ones are in the same class or in neighbouring ones
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int").alias("size")
    rest = open_.where("part <> main").select(*flat.columns, F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    others = other(open_.select(*members.drop("held").columns, F.col("part").alias("apart"), size))
    cross = rest.join(others, ["key", "size"]).where("part <> apart")
    return first.unionByName(verified(materialize(paired(cross), "cross_pairs"), nodes, texts))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of texts that links connect."""
    ship(docs.sparkSession)
    own = unused(docs, ROW)
    numbered = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    made = materialize(shingled(texts), "shingled")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "row")).alias("best")
    classes = materialize(made.groupBy("h1", "h2").agg(F.min("row").alias("node"), best), "text_classes")
    nodes = materialize(made.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select("row", "n", "print", "bits", "keys"), "nodes")
    part = components(links(nodes, texts.select("row", "text")))
    rooted = classes.join(part, "node", "left").withColumn("group", F.coalesce("component", "node"))
    chosen = materialize(rooted.groupBy("group").agg(F.min("best").alias("best")).select(F.col("best.row").alias(own)), "chosen")
    return numbered.join(chosen.hint("merge"), own, "left_semi").drop(own)  # at every size: the kept rows grow with the corpus
