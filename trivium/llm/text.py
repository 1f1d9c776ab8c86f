"""Expressions that several operators share. White space is the six ASCII characters everywhere."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.shipping import ship

WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def whole(column: str | Column) -> Column:
    """The whole text; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def carried(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns that an operator doesn't use in one struct, where none of its own columns can clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used] or [F.lit(0).alias("_")]
    return docs.select(*[F.col(f"`{c}`") for c in used], F.struct(*rest).alias("_carried"))


def restored(done: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None, **added: Column) -> DataFrame:
    """The columns of docs again, in their order, with changed ones; added columns follow and replace namesakes."""
    changed, inner = changed or {}, done.schema["_carried"].dataType.names
    own = lambda c: changed[c] if c in changed else F.col("_carried")[c] if c in inner else F.col(f"`{c}`")
    taken = {c.lower() for c in added}
    return done.select(*[own(c).alias(c) for c in docs.columns if c.lower() not in taken], *[v.alias(k) for k, v in added.items()])


def hash128(column: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: at 10**12 different values a chance match is still unlikely."""
    return F.xxhash64(column), F.xxhash64(F.lit(7), column)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, though body names it often or in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that come out of a generator: no later filter or projection makes Spark compute them again."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept, name = [c for c in df.columns if c not in columns], unused(df, "_trivium_once")
    made = df.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(row)).alias(name))
    return made.select(*[F.col(f"`{c}`") for c in kept], f"{name}.*")


def prefix_sums(values: Column) -> Column:
    """Sum of the values before each position, for an array of bigint.

    Two levels (blocks of about the square root of the length) keep the work at n ** 1.5
    for arrays of any length, without a shuffle.
    """

    def total(v: Column, start: Column, length: Column) -> Column:
        return F.aggregate(F.slice(v, start, length), F.lit(0).cast("long"), lambda a, x: a + x)

    def sums(v: Column, block: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(v) / block).cast("int")), lambda b: total(v, b * block + 1, block))
        return let(blocks, lambda each: let(
            F.transform(each, lambda _, b: total(each, F.lit(1), b)),
            lambda before: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(before, (i / block).cast("int")) + total(
                v, (i / block).cast("int") * block + 1, i % block))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda b: sums(v, b))).otherwise(
        F.array().cast("array<bigint>")))
