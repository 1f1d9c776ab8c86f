"""Triplet trials and embeddings derived from the driver's events and embeddings tables, in integer arithmetic.

The same SQL text serves Spark and, as common table expressions, DuckDB.
"""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivium.scratch import new_path
from trivium.shipping import ship

TRIALS_SQL = """
WITH h AS (SELECT event_id, user_id, event_type, value, (event_id * 2654435761) % 4294967296 AS h FROM {events}),
a AS (SELECT *, CASE event_type WHEN 'error' THEN 'check' WHEN 'signup' THEN 'validation' ELSE 'random' END AS alg,
  CASE WHEN event_type = 'signup' THEN (h {div} 16) % 12 ELSE h {div} 16 END AS g FROM h),
b AS (SELECT *, g % 36 AS c, 1 + (g {div} 36) % 35 AS o1, (g {div} 1260) % 34 AS w FROM a),
x AS (SELECT *, (c + o1) % 36 AS p, (c + 1 + (o1 + w) % 35) % 36 AS q0 FROM b),
y AS (SELECT *, CASE WHEN alg = 'check' THEN c ELSE q0 END AS q, (h {div} 8) % 2 AS swap, (h {div} 1024) % 20 AS noise, (h {div} 65536) % 5 AS tst FROM x),
z AS (SELECT *, CASE WHEN alg = 'check' THEN (CASE WHEN noise < 3 THEN p ELSE q END) WHEN noise < 13 THEN least(p, q) ELSE greatest(p, q) END AS ans FROM y)
SELECT CAST(user_id AS VARCHAR(20)) AS worker_id, event_id AS trial_ix, value * 100 AS rt,
  concat('item_', lpad(CAST(c AS VARCHAR(20)), 3, '0')) AS Center,
  concat('item_', lpad(CAST(CASE WHEN swap = 1 THEN q ELSE p END AS VARCHAR(20)), 3, '0')) AS {q}Left{q},
  concat('item_', lpad(CAST(CASE WHEN swap = 1 THEN p ELSE q END AS VARCHAR(20)), 3, '0')) AS {q}Right{q},
  concat('item_', lpad(CAST(ans AS VARCHAR(20)), 3, '0')) AS Answer, alg AS sampleAlg,
  CASE WHEN alg = 'check' THEN NULL WHEN alg = 'random' AND tst = 0 THEN 'test' ELSE 'train' END AS sampleSet
FROM z"""

EMB_SQL = """
SELECT CAST(w.user_id AS VARCHAR(20)) AS worker_id, w.user_id AS worker_ix, e.vec_id AS item_ix,
  concat('item_', lpad(CAST(e.vec_id AS VARCHAR(20)), 3, '0')) AS item,
  CAST({at}(e.embedding, CAST(w.user_id % 64 AS INT) + 1) AS DOUBLE) AS dim_0,
  CAST({at}(e.embedding, CAST((w.user_id % 64 + 1 + (w.user_id {div} 64) % 63) % 64 AS INT) + 1) AS DOUBLE) AS dim_1
FROM (SELECT DISTINCT user_id FROM {events}) w CROSS JOIN {embeddings} e WHERE e.vec_id < 36"""

CLUSTERS_SQL = "SELECT DISTINCT CAST(user_id AS VARCHAR(20)) AS worker_id, CAST(user_id % 3 + 1 AS INT) AS cluster FROM {events}"

_DUCK = {"div": "//", "at": "list_extract", "q": '"', "events": "events", "embeddings": "embeddings"}
#: Common table expressions for DuckDB; a query continues after the comma.
WITH = "WITH RECURSIVE trials AS MATERIALIZED (" + TRIALS_SQL.format(**_DUCK) + "),\nemb AS MATERIALIZED (" + EMB_SQL.format(**_DUCK) + "),\nclusters AS MATERIALIZED (" + CLUSTERS_SQL.format(**_DUCK) + "),\n"



def plain(*names: str) -> str:
    """The named fixtures only, as plain expressions for DuckDB; a query continues after the comma."""
    sql = {"trials": TRIALS_SQL, "emb": EMB_SQL, "clusters": CLUSTERS_SQL}
    return "WITH " + "".join(f"{n} AS ({sql[n].format(**_DUCK)}),\n" for n in names)


def _view(spark: SparkSession, sql: str, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "embeddings") if "{" + t + "}" in sql}
    return spark.sql(sql.format(div="div", at="element_at", q="`", events="{events}", embeddings="{embeddings}"), **tables)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, TRIALS_SQL, sf_dir)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, EMB_SQL, sf_dir).select("worker_ix", "worker_id", "item_ix", "item", F.array("dim_0", "dim_1").alias("coords"))


def embeddings64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; names have three digits or, beyond 999, as many as the number."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    name = F.col("vec_id").cast("string")
    item = F.concat(F.lit("item_"), F.when(F.length(name) < 3, F.lpad(name, 3, "0")).otherwise(name))
    return e.select(F.lit(0).cast("long").alias("worker_ix"), F.lit("group").alias("worker_id"), F.col("vec_id").alias("item_ix"), item.alias("item"), F.col("embedding").cast("array<double>").alias("coords"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, CLUSTERS_SQL, sf_dir)


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials as a raw export would hold them, all text."""
    picture = lambda folder, c: F.concat(F.lit(folder), F.col(c), F.lit(".png"))
    choices = F.concat(F.lit('["'), picture("resources/", "Left"), F.lit('","'), picture("resources/", "Right"), F.lit('"]'))
    return trials(spark, sf_dir).select(
        "worker_id", F.col("trial_ix").cast("string").alias("trial_index"), F.col("rt").cast("string").alias("rt"), picture("assets/stimuli/", "Center").alias("stimulus"),
        choices.alias("choices"), F.when(F.col("Answer") == F.col("Left"), "0").otherwise("1").alias("response"), F.col("sampleAlg").alias("trial_category"))


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    alg = F.when(F.col("sampleAlg") == "validation", "Test").when(F.col("sampleAlg") == "random", "Random").otherwise(F.col("sampleAlg"))
    return trials(spark, sf_dir).select(
        F.col("worker_id").alias("session_ID"), F.col("Center").alias("Target"), F.col("Left").alias("Option1"), F.col("Right").alias("Option2"),
        F.col("Answer").alias("primary"), alg.alias("AlgSample"), "trial_ix")


def png(vector: np.ndarray) -> bytes:
    """An 8 x 8 grey PNG of 64 numbers, white where they are above 0; its rows are filtered in all five ways by turns."""
    grey = np.where(np.asarray(vector) > 0, 255, 100).astype(np.int64).reshape(8, 8)
    lines = b""
    for y, row in enumerate(grey):
        left, up = np.roll(row, 1) * (np.arange(8) > 0), grey[y - 1] if y else np.zeros(8, np.int64)
        corner = np.roll(up, 1) * (np.arange(8) > 0)
        far = [abs(left + up - corner - z) for z in (left, up, corner)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        guess = (0 * row, left, up, (left + up) // 2, paeth)[y % 5]
        lines += bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): a PNG file for each vector of embeddings."""
    ship(spark)

    @F.pandas_udf("binary")
    def drawn(v: pd.Series) -> pd.Series:
        return v.map(png)

    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("vec"), F.col("vec_id").cast("string")).alias("name"), drawn("embedding").alias("content"))


def picture_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the PNG files, each written by the task that drew it; the scratch folder must be a path that tasks can write to."""
    folder = new_path(spark, "pictures")
    path = folder.removeprefix("file://")
    if "://" in path:
        raise RuntimeError("pictures are written to file systems that are mounted only")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                with tempfile.NamedTemporaryFile(dir=path, prefix=".", delete=False) as f:
                    f.write(content.as_py())
                os.replace(f.name, f"{path}/{name.as_py()}.png")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    pictures(spark, sf_dir).mapInArrow(write, "n long").agg(F.sum("n")).first()
    return folder
