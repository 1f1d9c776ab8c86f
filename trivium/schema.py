"""Schemas of trials, embeddings and levels, and checks of the columns that an operator needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.scratch import materialize

TRIALS = (
    "trial_ix long, worker_id string, rt double, Center string, Left string, Right string, Answer string, "
    "head long, winner long, loser long, sampleAlg string, sampleSet string"
)
EMBEDDINGS = "worker_ix long, worker_id string, item_ix long, item string, coords array<double>"
LEVELS = "item_ix long, item string, path string"
CLUSTERS = "worker_id string, cluster int"
#: Rows up to which a lookup table is broadcast by hint; beyond it the join is left to Spark.
BROADCAST_ROWS = 200_000


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def hash_uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys of a row, and on nothing else.

    The first 32 bits of an md5, so other SQL engines give the same number.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; this counts up to that bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A lookup table that is read several times, computed once.

    Up to so many rows it is kept in the plan itself and broadcast; beyond, it is a stored table and Spark picks the join.
    """
    found = df.limit(rows + 1).toArrow()
    if found.num_rows <= rows:
        return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))
    return materialize(df, "lookup")
