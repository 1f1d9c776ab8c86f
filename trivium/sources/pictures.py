"""Pictures of a folder, read by Spark's image source, as rasters of colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAR, OPAQUE = "#00000000", "#000000FF"


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(name, height, width, channels, data) of a folder's PNG files; the name has neither folder nor extension.

    Samples have 8 bits, by rows; colours are in the order blue, green, red. A file that isn't a picture has a height of -1.
    """
    files = spark.read.format("image").option("pathGlobFilter", "*.png").load(folder)
    name = F.regexp_replace(F.url_decode(F.element_at(F.split("image.origin", "/"), -1)), r"\.png$", "")
    return files.select(name.alias("name"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def rasters(pictures: DataFrame, colour: str = OPAQUE) -> DataFrame:
    """(name, raster) of read_pictures: rows of colours, clear where the first channel (red, or grey) is white, else opaque; null for
    what isn't a picture."""
    red = F.when(F.col("channels") >= 3, 2).otherwise(0)
    white = lambda y, x: F.substring("data", (y * F.col("width") + x) * F.col("channels") + red + 1, F.lit(1)) == F.unhex(F.lit("FF"))
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    rows = F.transform(up_to("height"), lambda y: F.transform(up_to("width"), lambda x: F.when(white(y, x), CLEAR).otherwise(colour)))
    return pictures.select("name", F.when((F.col("height") > 0) & (F.col("width") > 0), rows).alias("raster"))


def recolour(rasters_: DataFrame, colour: str | Column) -> DataFrame:
    """Opaque black pixels in another colour, the same for all pictures or a column's."""
    return rasters_.withColumn("raster", F.transform("raster", lambda row: F.transform(row, lambda p: F.when(p == OPAQUE, colour).otherwise(p))))
