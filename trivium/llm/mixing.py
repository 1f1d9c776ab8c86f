"""Mixing sources to target weights (operator 8), with DataFrame functions only.

Sizes are summed by source (map-side first), targets follow from the weights by filling up to a
limit, a source's repetition rate is target / size, and each document is taken floor(rate) times
plus once more with the fraction's probability, decided by a hash of its doc_id.

Resharing what is above a limit by weight until none is above ends where each target is
min(limit, level * weight) with one level for all. Sorted by limit / weight, the sources at their
limit come first, so running sums give the level without iterating.

Defined results: a null or empty text has size 0; null is a source of its own, the last; a source of
size 0 has target 0; rows that share a doc_id are taken alike, rows without one by their text's
hash; an empty table gives an empty table; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.llm.store import materialize
from trivium.llm.text import WORD, unused, whole

WEIGHTS, LIMIT, SEED = (5, 2, 1), 3, "mix-1"
#: Sources up to which their table is broadcast; it has about 60 bytes a source.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"size", "source_size", "target", "copies", "taken"}],
        F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) of sizes(source, size). The windows run over one row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = by.select(
        "source", "source_size", F.get(F.array(*map(F.lit, weights)), turn).cast("long").alias("w"),
        (F.col("source_size") * limit).alias("cap"),
    )
    # by cap / w without division: both sides of the order are exact
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    summed = weighed.select(
        "*",
        F.row_number().over(order).alias("place"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open"),
    )
    # the first source that isn't at its limit sets the level: left / open
    free = F.col("left") * F.col("w") <= F.col("cap") * F.col("open")
    level = F.min_by(F.struct("left", "open"), "place").over(Window.partitionBy("free"))
    marked = summed.withColumn("free", free).withColumn("level", level)
    target = F.when(F.col("free"), F.col("w") * F.col("level.left") / F.col("level.open")).otherwise(F.col("cap"))
    return marked.select("source", "source_size", target.cast("double").alias("target"))


def chance(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of the seed and the doc_id."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(whole(text))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies and taken = copies * size."""
    ids = docs.select("source", F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"))
    name = unused(docs, "_mix_source")
    wanted = materialize(targets(ids, weights, limit), "targets").withColumnRenamed("source", name)
    small = wanted.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = sized(docs, text).join(F.broadcast(wanted) if small else wanted, F.col("source").eqNullSafe(F.col(name))).drop(name)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (chance(F.col("doc_id"), F.col(text), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + extra).withColumn("taken", F.col("copies") * F.col("size"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as many times as it is taken."""
    name = unused(mixed, "_mix_copy")
    return mixed.where("copies > 0").withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop(name)
