"""Tables of a study in buckets by participant, so that what is done by participant needs no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trivium.schema import require
from trivium.scratch import new_path


def write_bucketed(d: DataFrame, buckets: int, table: str | None = None, path: str | None = None, by: str = "worker_id", order: tuple[str, ...] = ()) -> str:
    """Store d as a table of so many buckets by a column, each sorted by it and by `order`; returns the table's name.

    Rows are dealt out once, so a bucket is one file. Tables with the same number of buckets meet without an exchange. An
    existing table of that name is replaced. Without a path the files go to the library's scratch folder.
    """
    spark = d.sparkSession
    table = table or f"trivium_{uuid.uuid4().hex}"
    dealt = require(d, by, *order).repartition(buckets, by)
    dealt.write.mode("overwrite").bucketBy(buckets, by).sortBy(by, *order).option("path", path or new_path(spark, table)).saveAsTable(table)
    return table


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
