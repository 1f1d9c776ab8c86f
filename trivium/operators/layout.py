"""Where pictures go in a plot: a table of boxes; drawing itself is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivium.schema import hash_uniform, require


def plot_layout(
    points: DataFrame, x: int = 1, y: int = 2, pr: float | list[int] = 1.0, pc: str | list[str] | None = None, psize: float = 0.05,
    xlim: tuple[float, float] | None = None, ylim: tuple[float, float] | None = None, pictures: DataFrame | None = None, seed: int = 42,
) -> DataFrame:
    """(item, x0, y0, x1, y1, color) for points(item_ix, item, coords).

    x, y: 1-based dimensions. pr: share of items, by hash, or 1-based places. pc: one colour or one for
    each item. A box reaches psize times the axis range to each side; without limits the range is the
    data's. pictures(name): raises unless there are as many as points.
    """
    require(points, "item_ix", "item", "coords")
    if pictures is not None and pictures.count() != points.count():
        raise ValueError("points and pictures differ in number")
    if isinstance(pc, list) and len(pc) != points.count():
        raise ValueError("points and colours differ in number")
    px, py = F.get("coords", x - 1), F.get("coords", y - 1)
    span = points.agg((F.max(px) - F.min(px)).alias("_w"), (F.max(py) - F.min(py)).alias("_h"))
    if xlim:
        span = span.withColumn("_w", F.lit(float(max(xlim) - min(xlim))))
    if ylim:
        span = span.withColumn("_h", F.lit(float(max(ylim) - min(ylim))))
    chosen = points.where(F.col("item_ix").isin([i - 1 for i in pr])) if isinstance(pr, list) else points.where(hash_uniform(seed, "item") <= pr)
    color = F.get(F.array(*map(F.lit, pc)), F.col("item_ix").cast("int")) if isinstance(pc, list) else F.lit(pc).cast("string")
    w, h = F.col("_w") * psize, F.col("_h") * psize
    return chosen.join(F.broadcast(span), F.lit(True)).select(  # one row
        "item", (px - w).alias("x0"), (py - h).alias("y0"), (px + w).alias("x1"), (py + h).alias("y1"), color.alias("color"))
