"""Hierarchical clustering from a long distance table, tree cutting and leaf layout, over the cluster.

Two clusters that are each other's nearest are merged sooner or later, whatever else is merged before (ward.D and complete have
this property), so each round merges all such pairs at once and updates the table of distances by joins and sums. Rounds are about
the logarithm of the number of items where merges are spread over the tree, and as many as merges for a chain. A round's
tables are stored. What is said of merges, parents and offsets has a row an item, never the distances. Items at distance 0 from each
other and equally far from all others (copies) need no distances of their own: they join first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.schema import BROADCAST_ROWS, require, small
from trivium.scratch import mark, materialize, release
from trivium.sources.trials import numbered

METHODS = ("ward.D", "complete")


def items_of(dist: DataFrame, a: str, b: str) -> DataFrame:
    """(name, ix): the items of both columns, numbered from 0 in name order."""
    names = dist.select(F.col(a).alias("name")).union(dist.select(F.col(b))).where("name is not null").distinct()
    return numbered(names, "name", "place").select("name", (F.col("place") - 1).cast("long").alias("ix"))


def _updated(upper: DataFrame, state: DataFrame, method: str) -> DataFrame:
    """(i, j, d) after a round's merges; state(x, n, into, m, h): each cluster and its size before, the one that it went into and that one's
    size, and the height of the merge, null where there was none.

    Both ends are merged at once: a new distance comes from up to four, of the first or second member on either side.
    """
    of = lambda side: state.select(F.col("x").alias(side), *[F.col(c).alias(c + side) for c in ("n", "into", "m", "h")])
    met = upper.join(of("i"), "i").join(of("j"), "j").where("intoi <> intoj")
    straight = F.col("intoi") < F.col("intoj")
    pick = lambda x, y, name: F.when(straight, x).otherwise(y).alias(name)
    late, later = F.col("i") != F.col("intoi"), F.col("j") != F.col("intoj")
    sides = met.select(pick(F.col("intoi"), F.col("intoj"), "i"), pick(F.col("intoj"), F.col("intoi"), "j"), pick(late, later, "p"), pick(later, late, "q"), "d", ((F.col("ni") + F.col("nj")) * F.col("d")).alias("s"),
                       *[pick(F.col(f"{c}{x}"), F.col(f"{c}{y}"), f"{c}{x}") for c in ("m", "h") for x, y in ("ij", "ji")])
    each = sides.groupBy("i", "j").agg(F.max("d").alias("d"), *[F.max(c).alias(c) for c in ("mi", "mj", "hi", "hj")], *[F.max(F.when(at, F.col("s"))).alias(f"s{k}") for k, at in enumerate((~F.col("p") & ~F.col("q"), ~F.col("p") & F.col("q"), F.col("p") & ~F.col("q"), F.col("p") & F.col("q")))])
    s = [F.coalesce(f"s{k}", F.lit(0.0)) for k in range(4)]  # added in a fixed order, so that reruns agree
    ward = ((s[0] + s[1]) + (s[2] + s[3]) - F.col("mj") * F.coalesce("hi", F.lit(0.0)) - F.col("mi") * F.coalesce("hj", F.lit(0.0))) / (F.col("mi") + F.col("mj"))
    new = F.when(F.col("hi").isNull() & F.col("hj").isNull(), F.col("d")).otherwise(F.greatest(ward, "hi", "hj") if method == "ward.D" else F.col("d"))  # below a merge by rounding only
    return each.select("i", "j", new.alias("d"))


def agglomerate(dist: DataFrame, items: DataFrame, a: str, b: str, method: str, sizes: DataFrame | None = None) -> DataFrame:
    """(a, b, na, nb, height, round), stored: clusters go by their least item, and b's items join those of a. Of equal distances the
    one to the least item counts as nearest; an item pair that is given twice counts with its greatest distance, an unknown distance as
    the farthest. sizes(x, n): clusters to begin with, of items at one place, by their least
    item's number, if not every item is one; dist is that of two such items, and none is below 0 then."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    table = small(items)
    coded = dist.join(table.select(F.col("name").alias(a), F.col("ix").alias("i")), a).join(table.select(F.col("name").alias(b), F.col("ix").alias("j")), b).where("i <> j")
    start = mark(dist.sparkSession)
    far = F.max(F.coalesce("dist", F.lit(float("nan"))))
    begun = coded.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(far.alias("d"))
    if sizes is not None:  # what merging n items of one place with m of another makes of the distance of two
        n, many = small(sizes), 2 * F.col("n") * F.col("m") / (F.col("n") + F.col("m"))
        begun = begun.join(n.withColumnRenamed("x", "i"), "i").join(n.select(F.col("x").alias("j"), F.col("n").alias("m")), "j").select(
            "i", "j", (F.greatest("d", F.lit(0.0)) * (many if method == "ward.D" else F.lit(1.0))).alias("d"))
    upper = materialize(begun, "distances")
    sizes = sizes if sizes is not None else items.select(F.col("ix").alias("x"), F.lit(1).cast("long").alias("n"))
    left, made = sizes.count(), None
    for turn in range(1 << 30):
        lookup = F.broadcast if left <= BROADCAST_ROWS else (lambda df: df)
        both = upper.union(upper.select("j", "i", "d"))
        nearest = both.join(lookup(both.groupBy("i").agg(F.min("d").alias("d"))), ["i", "d"]).groupBy("i").agg(F.min("j").alias("j"), F.min("d").alias("d"))
        mutual = nearest.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("d").alias("height"), F.count("*").alias("c")).where("c = 2")
        sized = lambda side: lookup(sizes.select(F.col("x").alias(side), F.col("n").alias(f"n{side}")))  # noqa: B023, E731
        found = materialize(mutual.join(sized("a"), "a").join(sized("b"), "b").select("a", "b", "na", "nb", "height", F.lit(turn).alias("round")), "merges")
        count = found.count()
        if not count:
            break
        made, left = found if made is None else made.unionByName(found), left - count
        ends = found.select(F.explode(F.array("a", "b")).alias("x"), F.col("a").alias("into"), (F.col("na") + F.col("nb")).alias("m"), F.col("height").alias("h"))
        state = materialize(sizes.join(ends, "x", "left").select("x", "n", F.coalesce("into", "x").alias("into"), F.coalesce("m", "n").alias("m"), "h"), "sizes")
        sizes = state.where("x = into").select("x", F.col("m").alias("n"))
        if left == 1:
            break
        upper = materialize(_updated(upper, lookup(state), method), "distances")
    every = materialize(made if made is not None else found, "all_merges")
    release(dist.sparkSession, start, mark(dist.sparkSession) - 1)
    return every


def _copied(copies: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b, na, nb, height, round, step), stored: the merges of copies with the first of their kind, at height 0, which come before all others."""
    table = small(items)
    told = require(copies, "name", "first").join(table.select("name", F.col("ix").alias("b")), "name").join(table.select(F.col("name").alias("first"), F.col("ix").alias("a")), "first").where("a <> b")
    placed = materialize(numbered(materialize(told.select("a", "b"), "copies"), "a", "step", then=("b",)), "placed")
    one = F.lit(1).cast("long")
    begun = placed.groupBy("a").agg(F.min("step").alias("begun"))
    return materialize(placed.join(begun, "a").select("a", "b", (F.col("step") - F.col("begun") + 1).alias("na"), one.alias("nb"), F.lit(0.0).alias("height"), F.lit(-1).alias("round"), "step"), "merged_copies")


def hclust(dist: DataFrame, a: str = "worker_a", b: str = "worker_b", method: str = "ward.D", copies: DataFrame | None = None) -> DataFrame:
    """(step, left, right, height) over the items of dist(a, b, dist): leaves are -1, -2, ... in name order, earlier merges 1, 2, ... by
    height. Leaves stand before clusters, lower first.

    copies(name, first): all items, each beside the first in name order of those that are at distance 0 from it and equally far from any
    other. dist then needs the first ones alone, and the tree is that of all items.
    """
    return _tree(require(dist, a, b, "dist"), a, b, method, copies)[0].select(F.col("step").cast("int"), F.col("left").cast("int"), F.col("right").cast("int"), "height")


def _tree(dist: DataFrame, a: str, b: str, method: str, copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((step, left, right, height, size_left), items), both stored."""
    items = materialize(items_of(dist, a, b) if copies is None else items_of(copies, "name", "first"), "items")
    if copies is None:
        steps = numbered(agglomerate(dist, items, a, b, method), "height", "step", then=("round", "a"))
    else:
        same = _copied(copies, items)
        many = same.groupBy(F.col("a").alias("x")).agg((F.count("*") + 1).alias("n"))
        first = items.select(F.col("ix").alias("x")).join(same.select(F.col("b").alias("x")), "x", "left_anti")
        sizes = materialize(first.join(many, "x", "left").select("x", F.coalesce("n", F.lit(1).cast("long")).alias("n")), "sizes")
        rest = numbered(agglomerate(dist, items, a, b, method, sizes), "height", "step", then=("round", "a"))
        steps = same.unionByName(rest.withColumn("step", F.col("step") + same.count()))
    steps = materialize(steps, "steps")
    # a cluster's last merge before is the one that its least item took part in
    before = F.coalesce(F.lag("step").over(Window.partitionBy("a").orderBy("step")), -F.col("a") - 1)
    last = steps.groupBy(F.col("a").alias("b")).agg(F.max("step").alias("last"))
    sides = steps.withColumn("one", before).join(last, "b", "left").withColumn("two", F.coalesce("last", -F.col("b") - 1))
    key = lambda x: F.struct(F.col(x) > 0, F.abs(F.col(x)))
    straight = key("one") < key("two")
    pick = lambda x, y: F.when(straight, F.col(x)).otherwise(F.col(y))
    return materialize(sides.select("step", pick("one", "two").alias("left"), pick("two", "one").alias("right"), "height", pick("na", "nb").alias("size_left")), "tree"), items


def _climbed(nodes: DataFrame) -> DataFrame:
    """nodes(node, up, off) with up the last node that is reached upwards, and off the sum on the way; a root is its own up. Each
    round doubles the way, so there are as many as the logarithm of the depth."""
    now = materialize(nodes, "nodes")
    while True:
        top = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("off").alias("more"))
        more = F.when(F.col("up") == F.col("node"), 0).otherwise(F.col("more"))
        new = materialize(now.join(top, "up").select("node", F.col("next").alias("up"), (F.col("off") + more).alias("off"), (F.col("next") != F.col("up")).alias("moved")), "nodes")
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def _nodes(tree: DataFrame, items: DataFrame, below: Column) -> DataFrame:
    """(node, up, off): each leaf and step with its parent, if that is a step that meets the condition, else with itself; off: leaves
    of the parent that stand before its own."""
    kept = tree.where(below)
    zero = F.lit(0).cast("long")
    up = kept.select("step", F.explode(F.array(F.struct(F.col("left").alias("node"), zero.alias("off")), F.struct(F.col("right").alias("node"), F.col("size_left").alias("off")))).alias("c")).select(
        "c.node", F.col("step").alias("up"), "c.off")
    every = items.select((-F.col("ix") - 1).alias("node")).union(kept.select("step"))
    return every.join(up, "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.coalesce("off", zero).alias("off"))


def hclust_cut(dist: DataFrame, k: int, a: str = "worker_a", b: str = "worker_b", method: str = "ward.D", copies: DataFrame | None = None) -> DataFrame:
    """(worker_id, cluster): the tree cut in k groups, numbered by their first item in name order; of fewer items each is a group.
    copies: as in hclust."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    tree, items = _tree(require(dist, a, b, "dist"), a, b, method, copies)
    merged = items.count() - k
    root = _climbed(_nodes(tree, items, F.col("step") <= merged)).where("node < 0").select((-F.col("node") - 1).alias("ix"), "up")
    first = root.groupBy("up").agg(F.min("ix").alias("first"))
    label = first.select("up", F.row_number().over(Window.orderBy("first")).alias("cluster"))  # a row a group
    return root.join(small(label), "up").join(items, "ix").select(F.col("name").alias("worker_id"), F.col("cluster").cast("int").alias("cluster"))


def tip_coords(dist: DataFrame, a: str = "item_a", b: str = "item_b", method: str = "complete") -> DataFrame:
    """(item, x, y): leaves of the tree drawn from its root at 0: y is the place in drawing order, x the root's height over 2.

    All leaves of a dendrogram are as far from the root, half its height in branch length.
    """
    tree, items = _tree(require(dist, a, b, "dist"), a, b, method)
    place = _climbed(_nodes(tree, items, F.lit(True))).where("node < 0").select((-F.col("node") - 1).alias("ix"), (F.col("off") + 1).cast("double").alias("y"))
    height = tree.agg(F.coalesce(F.max_by("height", "step") / 2, F.lit(0.0)).alias("x"))
    return place.join(items, "ix").join(F.broadcast(height)).select(F.col("name").alias("item"), "x", "y")  # one row
