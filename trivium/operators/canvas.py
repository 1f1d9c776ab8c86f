"""Pictures painted into a canvas of pixels, as a table.

Boxes are cut by the tiles of the canvas, so a large box is painted by many tasks; each pixel takes the colour of the picture's cell
at its centre. The topmost opaque colour owns a pixel, and the translucent ones above it are laid over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.schema import require


def _axis(low: Column, high: Column, start: Column, stop: Column, size: int) -> tuple[Column, Column]:
    """First and last pixel, from 0, that the stretch from low to high touches on an axis from start to stop."""
    at = lambda v: (v - start) / (stop - start) * size
    return F.greatest(F.floor(at(low)), F.lit(0)), F.least(F.ceil(at(high)) - 1, F.lit(size - 1))


def _channel(colour: str, k: int) -> Column:
    return F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("long")


def paint(boxes: DataFrame, rasters: DataFrame, width: int, height: int, tile: int = 64, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """(tile, y, x, colour) of the pixels that boxes(item, place, x0, y0, x1, y1) paint with rasters(name, raster) of their items.

    The canvas spans all boxes; rows count from the top, tiles by rows. Pictures with a higher place lie above, equal ones by item.
    Colours are #RRGGBBAA; a translucent one gives (own * AA + below * (255 - AA)) div 255. A box without a picture, without
    extent or with an empty picture paints nothing. A pixel's translucent layers are held in one row.
    """
    require(boxes, "item", "place", "x0", "y0", "x1", "y1")
    limits = boxes.agg(F.min("x0").alias("lx0"), F.min("y0").alias("ly0"), F.max("x1").alias("lx1"), F.max("y1").alias("ly1"))
    b = boxes.where("x1 > x0 and y1 > y0").join(F.broadcast(limits), F.lit(True))  # one row
    left, right = _axis(F.col("x0"), F.col("x1"), F.col("lx0"), F.col("lx1"), width)
    # from the top: an axis that runs down
    top, bottom = _axis(-F.col("y1"), -F.col("y0"), -F.col("ly1"), -F.col("ly0"), height)
    placed = b.withColumns({"left": left, "right": right, "top": top, "bottom": bottom})
    tiles = lambda a, z: F.explode(F.sequence(F.call_function("div", F.col(a), F.lit(tile)), F.call_function("div", F.col(z), F.lit(tile))))
    cut = placed.where("left <= right and top <= bottom").withColumn("tx", tiles("left", "right")).withColumn("ty", tiles("top", "bottom"))
    met = cut.join(rasters.select(F.col("name").alias("item"), "raster"), "item").where("size(raster) > 0")
    span = lambda a, z, t: F.explode(F.sequence(F.greatest(F.col(a), F.col(t) * tile), F.least(F.col(z), F.col(t) * tile + tile - 1)))
    y = met.withColumn("y", span("top", "bottom", "ty"))
    down = F.floor((F.col("y1") - (F.col("ly1") - (F.col("y") + 0.5) / height * (F.col("ly1") - F.col("ly0")))) / (F.col("y1") - F.col("y0")) * F.size("raster")).cast("int")
    row = y.withColumn("row", F.get("raster", down)).drop("raster").withColumn("x", span("left", "right", "tx"))
    across = F.floor((F.col("lx0") + (F.col("x") + 0.5) / width * (F.col("lx1") - F.col("lx0")) - F.col("x0")) / (F.col("x1") - F.col("x0")) * F.size("row")).cast("int")
    number = F.col("ty") * (-(-width // tile)) + F.col("tx")
    seen = row.select(number.alias("tile"), "y", "x", "place", "item", F.get("row", across).alias("colour")).where("colour is not null")
    layers = seen.select("tile", "y", "x", F.struct("place", "item").alias("at"), _channel("colour", 3).alias("a"), *[_channel("colour", k).alias(c) for k, c in enumerate("rgb")]).where("a > 0")
    opaque, glass = F.col("a") == 255, F.col("a") < 255
    pixels = layers.groupBy("tile", "y", "x").agg(
        F.max(F.when(opaque, F.struct("at", "r", "g", "b"))).alias("owner"), F.sort_array(F.collect_list(F.when(glass, F.struct("at", "a", "r", "g", "b")))).alias("glass"))
    base = F.struct(*[F.coalesce(f"owner.{c}", F.lit(v).cast("long")).alias(c) for v, c in zip(background, "rgb", strict=True)])
    above = F.filter("glass", lambda x: F.col("owner").isNull() | (x["at"] > F.col("owner.at")))
    over = lambda s, x: F.struct(*[F.call_function("div", x[c] * x["a"] + s[c] * (255 - x["a"]), F.lit(255)).alias(c) for c in "rgb"])
    mixed = pixels.select("tile", "y", "x", F.aggregate(above, base, over).alias("m"))
    return mixed.select("tile", "y", "x", F.concat(F.lit("#"), *[F.lpad(F.hex(f"m.{c}"), 2, "0") for c in "rgb"]).alias("colour"))
