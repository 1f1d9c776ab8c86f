"""Line deduplication over the corpus (operator 7).

Lines are exploded, normalised (white space stripped at both ends, A-Z lower-cased) and hashed to
128 bits. Each hash counts its distinct documents; lines of a hash that too many documents hold are
dropped, except in the smallest doc_id that holds it, and the others are joined again by position.
Only hashes travel for counting; a very common line is pre-aggregated before the exchange.

Defined results: a null or empty text is one empty line; keys shorter than min_chars never count;
rows that share a doc_id are one document when counting and are each returned; lines of a row
without doc_id stay and aren't counted; other columns are carried along, and an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.llm.store import materialize
from trivium.llm.text import WHITE, ascii_lower, hash128, let, unused, whole


def line_keys(docs: DataFrame, text: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, row, at, h1, h2) for every line whose key counts; row tells rows of one doc_id apart."""
    body = whole(text)
    lines = docs.where("doc_id is not null").select(
        "doc_id", F.xxhash64(body).alias("row"), F.posexplode(F.split(body, "\n", -1)).alias("at", "line")
    )
    keyed = lines.select("doc_id", "row", "at", ascii_lower(F.btrim("line", F.lit(WHITE))).alias("key")).where(
        F.length("key") >= min_chars
    )
    h1, h2 = hash128(F.col("key"))
    return keyed.select("doc_id", "row", "at", h1.alias("h1"), h2.alias("h2"))


def frequent(keys: DataFrame, min_docs: int = 2) -> DataFrame:
    """(h1, h2, first): hashes that at least min_docs documents hold, and the smallest of these."""
    if min_docs <= 2:  # two documents hold it exactly when the least and the greatest differ
        spread = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        return (spread.where("first < last") if min_docs == 2 else spread).select("h1", "h2", "first")
    once = keys.groupBy("h1", "h2", "doc_id").agg(F.count("*"))
    many = once.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"))
    return many.where(F.col("docs") >= min_docs).select("h1", "h2", "first")


def kept_text(text: Column, dropped: Column) -> Column:
    """text without the lines at the positions in dropped (null: all stay)."""
    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return F.when(dropped.isNull(), text).otherwise(let(F.split(text, "\n", -1), without))


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """docs with their text reduced, and n_lines, n_dropped long."""
    keys = line_keys(docs, text, min_chars)
    common = materialize(frequent(keys, min_docs), "common_lines")
    doc, row, lost = (unused(docs, c) for c in ("_doc", "_row", "_gone"))
    gone = (
        keys.join(common.hint("merge"), ["h1", "h2"]).where("doc_id <> first")
        .groupBy("doc_id", "row").agg(F.collect_set("at").alias(lost))
        .withColumnsRenamed({"doc_id": doc, "row": row})
    )
    gone = materialize(gone, "dropped_lines")
    kept = [c for c in docs.columns if c.lower() not in {"n_lines", "n_dropped"}]
    body = whole(text)
    joined = docs.select(*[F.col(f"`{c}`") for c in kept]).join(  # by merging at every size: what is dropped grows with the corpus
        gone.hint("merge"), (F.col("doc_id") == F.col(doc)) & (F.xxhash64(body) == F.col(row)), "left"
    )
    return joined.select(
        *[kept_text(body, F.col(lost)).alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        F.size(F.split(body, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
    )
