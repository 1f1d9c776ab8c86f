"""How far the sources of a language diverge in their terms, by exact whole numbers (operator 13).

A term is a run of letters: A-Z in lower case, a-z, and everything beyond ASCII. Each language keeps the terms that at least
min_docs of its documents hold. With n occurrences in a group of N kept occurrences, and V kept terms, a term's share is
p = 1 + floor(10**9 (n + 1) / (N + V)), and two shares diverge by f = floor((p - q)**2 / q).

A group lacks most terms, and all that it lacks have one share, p0. So the sum of f over all terms for groups a and b is
V f(p0a, p0b) plus deviations of the terms that either has, which heavy and light terms give apart:

* heavy: terms in more than an eighth of the groups (or in over MOST groups) are dealt to tiles of about TILE terms; a tile meets
  blocks of BLOCK groups as dense numpy arrays;
* light: a histogram of counts by group gives what a term adds where only one of both groups has it; a term's posting list, at
  most MOST long, gives the corrections for the pairs of groups that both have it.

Both partial sums are whole numbers, so their sum is exact: at most (10**9 + V)**2 / V + (10**9 + V) 10**9, which fits a long up to V = 7 * 10**9.

Defined results: null text, lang or source counts as empty; each row is a document, equal rows and rows of one doc_id included; a group
without kept terms has its pairs, and f is 0 everywhere where its language keeps no term; ties go by the item's UTF-8 bytes; a
language with one source has no pairs; other columns aren't read; an empty table gives an empty result; texts of any length are
read whole, in slices. Sources by language are meant to be few enough for all their pairs, which are the result.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.llm.store import materialize
from trivium.llm.text import whole
from trivium.schema import small
from trivium.shipping import ship

#: Groups in a block, terms in a tile, groups of a light term, entries that a worker counts before it hands them on, and bytes of text at a time.
BLOCK, TILE, MOST, HELD, SLICE = 64, 4096, 1000, 400_000, 1 << 22
COUNTS = "lang string, source string, term string, n long, docs long"
#: What each byte of a text becomes: letters in lower case and bytes beyond ASCII stay, all else is a space.
LETTERS = bytes(b + 32 if chr(b) in string.ascii_uppercase else b if b > 127 or chr(b) in string.ascii_lowercase else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number of bytes at a time."""
    raw = text.encode().translate(LETTERS)
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + SLICE)
        stop = len(raw) if stop < 0 else stop
        yield raw[start:stop].split()
        start = stop


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by group and term, added up in the task; a row without a term says that the group occurs."""
    n, docs = defaultdict(Counter), defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            held = docs[lang, source]
            columns = [pa.array([lang] * len(found)), pa.array([source] * len(found)), pa.array(found.keys(), pa.binary()).cast(pa.string()),
                       pa.array(found.values(), pa.int64()), pa.array([held[t] for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        n.clear(), docs.clear()

    for batch in rows:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            group = lang.as_py(), source.as_py()
            seen: set[bytes] = set()
            n[group][b""] += 0
            for part in terms(text.as_py()):
                n[group].update(part)
                seen.update(part)
            docs[group].update(seen)
            if sum(map(len, n.values())) > HELD:
                yield from told()
    yield from told()


def term_counts(docs: DataFrame, text: str = "text", domain: str = "lang", group: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; the empty term stands for each group that occurs."""
    ship(docs.sparkSession)
    found = docs.select(whole(domain).alias("lang"), whole(group).alias("source"), whole(text).alias("text")).mapInArrow(_count, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, total, k, first): the postings of the terms that enough documents of their language hold.

    total: occurrences in the language; k: groups that hold it; first: one posting of each term has it.
    """
    w = Window.partitionBy("lang", "term")  # at most a row for each source
    each = counts.select("lang", "source", "term", "n", F.sum("docs").over(w).alias("df"), F.sum("n").over(w).alias("total"),
                         F.count("*").over(w).alias("k"), (F.min("source").over(w) == F.col("source")).alias("first"))
    return each.where((F.col("df") >= min_docs) | (F.col("term") == "")).drop("df")


def group_sizes(kept: DataFrame) -> DataFrame:
    """(lang, source, size, g, groups, vocabulary, lang_size): a row a group, numbered within its language."""
    each = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if(F.col("first") & (F.col("term") != "")).alias("v"))
    w = Window.partitionBy("lang")
    return each.select("lang", "source", "size", (F.row_number().over(w.orderBy("source")) - 1).alias("g"), F.count("*").over(w).alias("groups"),
                       F.sum("v").over(w).alias("vocabulary"), F.sum("size").over(w).alias("lang_size"))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column | int, size: Column) -> Column:
    """1 + floor(10**9 (n + 1) / size), three digits at a time so that no product passes a long."""
    whole_, rest = F.lit(1).cast("long"), (F.lit(n).cast("long") if isinstance(n, int) else n) + 1
    for unit in (1_000_000, 1_000, 1):
        whole_, rest = whole_ + div(rest * 1000, size) * unit, (rest * 1000) % size
    return whole_


def shares(n: np.ndarray, size: int) -> np.ndarray:
    out, rest = np.ones(n.shape, np.int64), n + 1
    for unit in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out += rest // size * unit
        rest %= size
    return out


def divergence(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def _dense(block: int):
    """(lang, a, b, delta) of a tile and two blocks of groups: sums over the tile's terms of f(p, q) - f(p0, q0)."""
    def deviations(cell: pa.Table) -> pa.Table:
        lang, i, j = (cell.column(c)[0].as_py() for c in ("lang", "i", "j"))
        g, size, n = (cell.column(c).to_numpy() for c in ("g", "size", "n"))
        coded = cell.column("term").combine_chunks().dictionary_encode()
        code, width = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        ids, at = np.unique(g, return_index=True)
        sizes, real = size[at], ~np.isnan(code)  # each group has a row without a term
        counts = np.zeros((len(ids), width), np.int64)
        counts[np.searchsorted(ids, g[real]), code[real].astype(np.int64)] = n[real]
        p = np.stack([shares(x, s) for x, s in zip(counts, sizes, strict=True)])
        none = np.array([shares(np.zeros(1, np.int64), s)[0] for s in sizes])
        of = {k: np.flatnonzero(ids // block == k) for k in (i, j)}
        out = []
        for rows, columns in {(i, j), (j, i)}:
            q, q0 = p[of[columns]], none[of[columns]]
            for a in of[rows]:
                gaps = p[a] - q
                delta = (gaps * gaps // q).sum(1) - width * ((none[a] - q0) ** 2 // q0)
                out += [(ids[a], b, d) for b, d in zip(ids[of[columns]], delta, strict=True) if b != ids[a]]
        a, b, d = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "delta": d})

    return deviations


def heavy_deviations(heavy: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, delta) of the heavy postings (lang, term, first, g, n, size), tile by tile."""
    tiles = heavy.where("first").groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = groups.join(tiles, "lang").select("lang", "source", "g", "groups", F.col("n_all").alias("size"), "tiles")
    rows = heavy.select("lang", "source", "term", "n").join(small(tiled), ["lang", "source"]).withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"))
    marks = tiled.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    own = div(F.col("g"), F.lit(BLOCK))
    other = F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("groups") - 1, F.lit(BLOCK)))).alias("other")
    every = rows.select("lang", "tile", "term", "g", "size", "n", "groups").unionByName(marks.select("lang", "tile", "term", "g", "size", "n", "groups"))
    cells = every.select("lang", "tile", "term", F.col("g").cast("long").alias("g"), "size", "n", own.alias("own"), other).select(
        "lang", "tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "term", "g", "size", "n")
    return cells.groupBy("lang", "tile", "i", "j").applyInArrow(_dense(BLOCK), "lang string, a long, b long, delta long")


def light_deviations(light: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, delta) of the light postings (lang, term, k, g, n, size)."""
    p0 = lambda size: share(0, size)
    other = small(groups.select("lang", F.col("g").alias("h"), F.col("n_all").alias("other_size")))
    counted = light.groupBy("lang", "g", "size", "n").agg(F.count("*").alias("m"))
    met = counted.join(other, "lang").where("g <> h").select(
        "lang", "g", "h", "m", share(F.col("n"), F.col("size")).alias("p"), p0(F.col("size")).alias("p0"), p0(F.col("other_size")).alias("q0"))
    one = met.select(F.inline(F.array(
        F.struct("lang", F.col("g").alias("a"), F.col("h").alias("b"), (F.col("m") * (divergence(F.col("p"), F.col("q0")) - divergence(F.col("p0"), F.col("q0")))).alias("delta")),
        F.struct("lang", F.col("h").alias("a"), F.col("g").alias("b"), (F.col("m") * (divergence(F.col("q0"), F.col("p")) - divergence(F.col("q0"), F.col("p0")))).alias("delta")))))
    held = light.where("k > 1").select("lang", "term", F.struct("g", share(F.col("n"), F.col("size")).alias("p"), p0(F.col("size")).alias("p0")).alias("x"))
    lists = held.groupBy("lang", "term").agg(F.collect_list("x").alias("xs"))  # at most MOST long
    pairs = lists.select("lang", "xs", F.explode("xs").alias("x")).select("lang", "x", F.explode("xs").alias("y")).where("x.g <> y.g")
    p, q, x0, y0 = (F.col(c) for c in ("x.p", "y.p", "x.p0", "y.p0"))
    both = pairs.select("lang", F.col("x.g").alias("a"), F.col("y.g").alias("b"), (divergence(p, q) - divergence(p, y0) - divergence(x0, q) + divergence(x0, y0)).alias("delta"))
    return one.unionByName(both)


def audit(docs: DataFrame, text: str = "text", domain: str = "lang", group: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distance from every other source of its language (part `pair`), and
    the terms that it has more of than its language, the `top` greatest (part `term`)."""
    kept = materialize(kept_terms(term_counts(docs, text, domain, group), min_docs), "terms")
    sized = group_sizes(kept).withColumn("n_all", F.col("size") + F.col("vocabulary"))
    groups = materialize(sized, "groups")
    postings = kept.where("term <> ''").join(small(groups.select("lang", "source", "g", "groups", F.col("n_all").alias("size"), (F.col("lang_size") + F.col("vocabulary")).alias("all"))), ["lang", "source"])
    is_heavy = (8 * F.col("k") > F.col("groups")) | (F.col("k") > MOST)
    deltas = heavy_deviations(postings.where(is_heavy), groups).unionByName(light_deviations(postings.where(~is_heavy), groups).select(
        "lang", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "delta")).groupBy("lang", "a", "b").agg(F.sum("delta").alias("delta"))
    side = lambda s: groups.select("lang", F.col("source").alias(f"source_{s}"), F.col("g").cast("long").alias(s), F.col("n_all").alias(f"size_{s}"), *(["vocabulary"] if s == "a" else []))
    base = side("a").join(side("b"), "lang").where("a <> b")
    none = F.col("vocabulary") * divergence(share(0, F.col("size_a")), share(0, F.col("size_b")))
    pairs = base.join(deltas, ["lang", "a", "b"], "left").select(
        "lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"),
        F.when(F.col("vocabulary") > 0, none + F.coalesce("delta", F.lit(0))).otherwise(0).cast("long").alias("value"))
    more = postings.select("lang", "source", "term", share(F.col("n"), F.col("size")).alias("p"), share(F.col("total"), F.col("all")).alias("q")).where("p > q")
    told = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(told.withColumn("rank", rank).where(F.col("rank") <= top))
