"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All stages but the last return the columns of documents; the last returns
doc_id, source, ids and the decoded string for each document that is taken, repeats included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivium.llm import bpe, lines, mixing, quality, shingles
from trivium.llm.queries import tokenizer
from trivium.llm.store import mark, materialize, release
from trivium.llm.text import read


def carried(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns that a stage doesn't use in one struct, where no operator's column can clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(F.lit(0).alias("_"), *rest).alias("_carried"))


def restored(done: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs again, in their order; new ones in place of their namesakes."""
    inner = done.schema["_carried"].dataType.names
    return done.select(*[(new[c] if c in new else F.col("_carried")[c] if c in inner else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    judged = quality.judge(carried(docs, "doc_id", "text"), read(spark, sf_dir, "labels"))
    return restored(judged.where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    done = lines.dedup_lines(carried(docs, "doc_id", "text"))
    return restored(done, docs, n_chars=F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more on five-word shingles stays."""
    return shingles.keep_one(docs).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's rate and its own chance say."""
    return restored(mixing.emit(mixing.mix(carried(docs, "doc_id", "source", "text"))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and what they decode to."""
    return bpe.encode(docs.select("doc_id", "source", "text"), tokenizer("word_bpe_49k.json"), decoded=True)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources), ("bpe", encode),
]

#: SQL can express neither the merges of byte pairs nor the similarity join over all shingles at this size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, stored; what a stage wrote is deleted once the next table is stored."""
    docs, start = read(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        inner = mark(spark)
        docs = materialize(made, name)
        release(spark, start, inner)  # the former stage's table and this one's own
        start = inner
    return docs
