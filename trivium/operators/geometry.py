"""Distances, nearest items, Procrustes alignment and averaging of embeddings (worker_id, item_ix, item, coords).

An embedding is packed as one row before pairs are formed: its coordinates by dimension, ordered by item,
centred, with unit sum of squares. Pairs then move one small row a participant, and each pair costs
d * d sums, from which the Procrustes distance follows: 1 - (sum of the singular values of the cross
products). Two dimensions have a closed form in plain arithmetic; beyond, numpy sees d * d numbers
a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.operators.predict import squared_distance
from trivium.schema import held, require, small
from trivium.scratch import mark, materialize, release, settled
from trivium.shipping import ship

#: Bytes of a tile of packed embeddings.
TILE_BYTES = 1 << 22
#: Tiles that are sent together.
SIDE = 64
#: Participants of the same embedding that share a row of a tile.
COPIES = 64


def pairwise_dist(embeddings: DataFrame) -> DataFrame:
    """(worker_id, item_a, item_b, dist): Euclidean distances of all items within each embedding, both ways and with itself."""
    e = require(embeddings, "worker_id", "item", "coords")
    a = e.select("worker_id", F.col("item").alias("item_a"), F.col("coords").alias("a"))
    b = e.select("worker_id", F.col("item").alias("item_b"), F.col("coords").alias("b"))
    return a.join(b, "worker_id").select("worker_id", "item_a", "item_b", F.sqrt(squared_distance(F.col("a"), F.col("b"))).alias("dist"))


def nearest_k(dist: DataFrame, k: int = 5, by: tuple[str, ...] = (), order: str = "item_b") -> DataFrame:
    """(by..., item_a, item_b, dist, rank): items ranked 2 to k + 1 by distance from item_a, itself included in the ranking."""
    place = F.row_number().over(Window.partitionBy(*by, "item_a").orderBy("dist", order))
    ranked = require(dist, "item_a", "item_b", "dist").withColumn("place", place)
    return ranked.where((F.col("place") >= 2) & (F.col("place") <= k + 1)).select(*by, "item_a", "item_b", "dist", (F.col("place") - 1).alias("rank"))


class Index:
    """Pivots of an embedding with, for each, the number and the radius of the items nearest to it, and its blocks."""

    def __init__(self, pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray, block: int):
        self.pivots, self.counts, self.radii = pivots, counts, radii
        self.parts = np.maximum(1, -(-counts // block))  # a pivot's items are dealt to so many blocks

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each row to each pivot."""
        step = max(1, (1 << 22) // max(1, self.pivots.size))
        each = [np.sqrt(((x[i : i + step, None] - self.pivots) ** 2).sum(2)) for i in range(0, len(x), step)]
        return np.concatenate(each) if each else np.empty((0, len(self.pivots)))

    def bounds(self, far: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each row surely has k + 1 items: enough pivots' items are all nearer than it."""
        reach = np.where(self.counts > 0, far + self.radii, np.inf)
        order = np.argsort(reach, axis=1)
        enough = np.cumsum(self.counts[order], axis=1) >= k + 1
        at = np.where(enough.any(1), enough.argmax(1), len(self.pivots) - 1)
        return np.where(enough.any(1), np.take_along_axis(reach, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], np.inf)


def _closest(names_a: list, a: np.ndarray, names_b: list, b: np.ndarray, limit: np.ndarray, k: int) -> list[tuple[list, list]]:
    """(names, distances) of the k + 1 rows of b nearest to each row of a and not beyond its limit; ties go by name, as b is sorted.

    Products tell roughly which are near enough; exact distances are taken of those only.
    """
    square_a, square_b, kept = (a * a).sum(1), (b * b).sum(1), min(k, len(b) - 1)
    rough = square_a[:, None] + square_b - 2 * (a @ b.T)
    most = np.minimum(np.partition(rough, kept, axis=1)[:, kept], limit * limit) + 1e-9 * (square_a + square_b.max())
    out = []
    for i in range(len(a)):
        at = np.nonzero(rough[i] <= most[i])[0]
        dist = np.sqrt(((b[at] - a[i]) ** 2).sum(1))
        best = np.argsort(dist, kind="stable")[: k + 1]
        out.append(([names_b[j] for j in at[best]], dist[best].tolist()))
    return out


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def nearest_index(embedding: DataFrame, block: int, pivots: int) -> tuple[DataFrame, Index]:
    """(stored blocks (pivot, part, r array<struct<item, coords>>), index). Pivots are a bounded number of items, least by hash."""
    spark = embedding.sparkSession
    e = require(embedding, "item", "coords").select("item", "coords")
    n = e.count()
    chosen = e.orderBy(F.xxhash64("item"), "item").limit(max(1, min(pivots, -(-4 * n // block)))).select("coords").collect()
    points = np.array([r.coords for r in chosen], float) if chosen else np.zeros((1, 0))
    held = spark.sparkContext.broadcast(Index(points, np.zeros(len(points), np.int64), np.zeros(len(points)), block))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = held.value.distances(_matrix(batch.column(1)))
            at = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(far[np.arange(len(at)), at])], names=["item", "coords", "pivot", "far"])

    dealt = materialize(e.mapInArrow(assigned, "item string, coords array<double>, pivot int, far double"), "pivots")
    told = {r.pivot: (r.n, r.radius) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # at most a row a pivot
    index = Index(points, *(np.array([told.get(k, (0, 0.0))[x] for k in range(len(points))]) for x in (0, 1)), block)
    parts = F.get(F.array(*[F.lit(int(x)) for x in index.parts]), F.col("pivot"))
    blocks = dealt.select("pivot", F.pmod(F.xxhash64("item"), parts).cast("int").alias("part"), F.struct("item", "coords").alias("x")).groupBy("pivot", "part").agg(F.sort_array(F.collect_list("x")).alias("r"))
    return materialize(blocks, "blocks"), index


def nearest_visits(blocks: DataFrame, index: Index, k: int) -> DataFrame:
    """(item, coords, near array<struct<item_b, dist>>, bound, pivot, part, visits array<int>) of each item, stored: the k + 1 nearest of
    its own block, a distance within which it surely has as many, and the pivots that may have items within it."""
    held = blocks.sparkSession.sparkContext.broadcast(index)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                items = batch.column(2)[row].values
                names, x = items.field("item").to_pylist(), _matrix(items.field("coords"))
                far = held.value.distances(x)
                bound = held.value.bounds(far, k)
                near = _closest(names, x, names, x, np.full(len(x), np.inf), k)
                bound = np.array([min(t, d[k]) if len(d) > k else t for t, (_, d) in zip(bound, near, strict=True)])
                # the triangle inequality, with room for rounding
                may = (far - held.value.radii - bound[:, None] <= 1e-9 * (far + held.value.radii + 1)) & (held.value.counts > 0)
                lists = [[{"item_b": n, "dist": d} for n, d in zip(*x_, strict=True)] for x_ in near]
                yield pa.RecordBatch.from_arrays(
                    [items.field("item"), items.field("coords"), pa.array(lists, pa.list_(pa.struct([("item_b", pa.string()), ("dist", pa.float64())]))), pa.array(bound),
                     pa.array([batch.column(0)[row].as_py()] * len(x), pa.int32()), pa.array([batch.column(1)[row].as_py()] * len(x), pa.int32()),
                     pa.array([np.flatnonzero(m).tolist() for m in may], pa.list_(pa.int32()))], names=["item", "coords", "near", "bound", "pivot", "part", "visits"])

    schema = "item string, coords array<double>, near array<struct<item_b: string, dist: double>>, bound double, pivot int, part int, visits array<int>"
    return materialize(blocks.select("pivot", "part", "r").mapInArrow(visit, schema), "visits")


def _best(q: np.ndarray, r: np.ndarray, bound: np.ndarray, own: np.ndarray | None, other: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q, rows of r, distances) of the k + 1 rows of r nearest to each row of q and about within its bound, ties by place in r.
    Rows of an equal own and other don't count. Products tell roughly which are near enough; exact distances are taken of those only."""
    square_q, square_r, kept = (q * q).sum(1), (r * r).sum(1), min(k, len(r) - 1)
    rough = square_q[:, None] + square_r - 2 * (q @ r.T)
    if own is not None:
        rough[own[:, None] == other] = np.inf
    most = np.minimum(np.partition(rough, kept, axis=1)[:, kept], bound * bound) + 1e-9 * (square_q + square_r.max())
    row, near = np.nonzero((rough <= most[:, None]) & (rough < np.inf))
    each = [((r[near[s : s + 65536]] - q[row[s : s + 65536]]) ** 2).sum(1) for s in range(0, len(row), 65536)]
    dist = np.sqrt(np.concatenate(each)) if each else np.empty(0)
    order = np.lexsort((near, dist, row))
    row = row[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k + 1
    return row[first], near[order][first], dist[order][first]


def nearest_groups(index: Index, size: int) -> list[tuple[int, int, int]]:
    """(pivot, part, grp) of all blocks: blocks of about so many items in all make a group, those of pivots as far from the first one together."""
    order = np.argsort(((index.pivots - index.pivots[:1]) ** 2).sum(1), kind="stable")
    blocks = [(int(p), part, index.counts[p] / index.parts[p]) for p in order for part in range(index.parts[p])]
    return [(p, part, int(before // size)) for (p, part, n), before in zip(blocks, np.cumsum([0, *[n for _, _, n in blocks]]), strict=False)]


def nearest_k_blocks(embedding: DataFrame, k: int = 5, block: int = 1024, pivots: int = 1024, queries: int = 16384) -> DataFrame:
    """nearest_k of the distances within one embedding(item, coords), without a row for each pair.

    Items are dealt to blocks by the nearest of a bounded number of pivots. An item's own block bounds the distance of its k-th
    neighbour; by the triangle inequality it has to visit only pivots whose items may lie within that bound. Blocks make groups of
    about `queries` items, and two groups, one of which has to visit the other, meet in one cell of a grid: an item is sent once
    for each such partner of its group, not for each block. A cell keeps the k + 1 best of each item. Exact for any data: without clusters, all
    groups meet. Items' names are different.
    """
    spark = embedding.sparkSession
    ship(spark)
    start = mark(spark)
    blocks, index = nearest_index(embedding, block, pivots)
    items = nearest_visits(blocks, index, k)
    release(spark, start, mark(spark) - 1)  # the items have all that follows
    own = items.select(F.col("item").alias("item_a"), F.explode("near").alias("x")).select("item_a", "x.item_b", "x.dist")
    groups = F.broadcast(spark.createDataFrame(nearest_groups(index, queries), "pivot int, part int, grp int"))  # about a row a block
    goes = items.select("pivot", "part", "visits").distinct().join(groups, ["pivot", "part"]).select("grp", F.explode("visits").alias("pivot")).distinct()
    pairs = goes.join(groups.select("pivot", F.col("grp").alias("to")), "pivot").select(F.least("grp", "to").alias("i"), F.greatest("grp", "to").alias("j")).distinct()
    pairs = held(pairs)
    cells = pairs.count()
    met = pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("grp"), "i", "j")
    placed = items.select("item", "coords", "bound", "pivot", "part").join(groups, ["pivot", "part"])
    sent = placed.join(met, "grp").select("i", "j", "grp", "pivot", "part", "item", "coords", "bound")
    shared = spark.sparkContext.broadcast(index)

    def nearest(cell: pa.Table) -> pa.Table:
        cell = cell.take(pa.compute.sort_indices(cell.column("item")))  # ties go by name
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        grp, pivot, part, bound = (cell.column(c).to_numpy() for c in ("grp", "pivot", "part", "bound"))
        x, at, out = np.concatenate([_matrix(c) for c in cell.column("coords").chunks]), (pivot.astype(np.int64) << 32) + part, []
        for g, h in ((i, j), (j, i))[: 1 + (i != j)]:
            q, r = np.flatnonzero(grp == g), np.flatnonzero(grp == h)
            there = np.unique(pivot[r])
            for s in range(0, len(q), 256):
                a = q[s : s + 256]
                far = np.sqrt(((x[a, None] - shared.value.pivots[there]) ** 2).sum(2))
                radii = shared.value.radii[there]
                may = far - radii - bound[a, None] <= 1e-9 * (far + radii + 1)
                a, b = a[may.any(1)], r[np.isin(pivot[r], there[may.any(0)])]
                if len(a) and len(b):
                    row, near, dist = _best(x[a], x[b], bound[a], *((at[a], at[b]) if i == j else (None, None)), k)
                    out.append((a[row], b[near], dist))
        a, b, dist = (np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64 if c < 2 else float) for c in range(3))
        return pa.table({"item_a": cell.column("item").take(pa.array(a)), "item_b": cell.column("item").take(pa.array(b)), "dist": pa.array(dist)})

    # a number of its own: the cells would else be coalesced into a few tasks
    dealt = sent.repartition(max(4 * spark.sparkContext.defaultParallelism, cells // 2), "i", "j")
    return nearest_k(own.unionByName(dealt.groupBy("i", "j").applyInArrow(nearest, "item_a string, item_b string, dist double")), k)


def nearest_to(dist: DataFrame, item: str, k: int = 5) -> DataFrame:
    """nearest_k of one item; raises if there is none of that name."""
    own = dist.where(F.col("item_a") == item)
    if own.isEmpty():
        raise ValueError(f"unknown item: {item}")
    return nearest_k(own, k)


def dimensions(embeddings: DataFrame) -> int:
    first = embeddings.select(F.size("coords").alias("d")).first()
    return first.d if first else 0


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _at(k: int):
    return lambda x: F.get(x["coords"], k)


def _minus(column: str):
    return lambda x: x - F.col(column)


def _times(factor: Column):
    return lambda x: x * factor


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def same_items(p: DataFrame) -> None:
    """Raises if packed embeddings have different items."""
    if p.agg(F.count_distinct(F.sort_array("items")).alias("n")).first().n > 1:
        raise ValueError("all embeddings need the same items")


def packed(embeddings: DataFrame, dims: int, strict: bool = True) -> DataFrame:
    """(worker_id, worker_ix, items, c0, c1, ...): arrays by item, centred, with unit sum of squares.

    strict: raise if participants have different items.
    """
    require(embeddings, "worker_id", "item", "coords", "item_ix")
    ship(embeddings.sparkSession)
    rows = embeddings.groupBy("worker_id").agg(
        F.min("worker_ix").alias("worker_ix") if "worker_ix" in embeddings.columns else F.min("worker_id").alias("worker_ix"),
        F.sort_array(F.collect_list(F.struct("item_ix", "item", "coords"))).alias("r"))
    flat = rows.select("worker_id", "worker_ix", F.transform("r", lambda x: x["item"]).alias("items"), *[
        F.transform("r", _at(k)).alias(f"r{k}") for k in range(dims)])
    if strict:
        same_items(flat)
    centred = flat.select("worker_id", "worker_ix", "items", *[(_sum(F.col(f"r{k}")) / F.size("items")).alias(f"m{k}") for k in range(dims)], *[f"r{k}" for k in range(dims)]).select(
        "worker_id", "worker_ix", "items", *[F.transform(f"r{k}", _minus(f"m{k}")).alias(f"r{k}") for k in range(dims)])
    norm = F.sqrt(sum((_dot(F.col(f"r{k}"), F.col(f"r{k}")) for k in range(dims)), F.lit(0.0)))
    return centred.withColumn("norm", F.nullif(norm, F.lit(0.0))).select(
        "worker_id", "worker_ix", "items", *[F.transform(f"r{k}", lambda x: x / F.col("norm")).alias(f"c{k}") for k in range(dims)])


def _cross(dims: int, a: str = "a_", b: str = "b_") -> list[Column]:
    return [_dot(F.col(f"{a}c{i}"), F.col(f"{b}c{j}")).alias(f"m{i}{j}") for i in range(dims) for j in range(dims)]


def nuclear_norm(dims: int) -> Column:
    """Sum of the singular values of the matrix in columns m00, m01, ..."""
    if dims == 1:
        return F.abs("m00")
    if dims == 2:
        m = [F.col(c) for c in ("m00", "m01", "m10", "m11")]
        return F.sqrt(m[0] * m[0] + m[1] * m[1] + m[2] * m[2] + m[3] * m[3] + 2 * F.abs(m[0] * m[3] - m[1] * m[2]))

    @F.pandas_udf("double")
    def values(*columns: pd.Series) -> pd.Series:
        m = np.stack([c.to_numpy() for c in columns], 1).reshape(-1, dims, dims)
        return pd.Series(np.linalg.svd(m, compute_uv=False).sum(1))

    return values(*[F.col(f"m{i}{j}") for i in range(dims) for j in range(dims)])


def _shape(p: DataFrame, dims: int) -> tuple[DataFrame, list[str]]:
    """(packed p with columns that are equal just for the very same embedding, their names). One without a name, that can't be scaled or has
    unknown coordinates is only its own: `alone` is not empty."""
    known = reduce(lambda x, k: x & F.forall(f"c{k}", lambda v: v.isNotNull() & ~F.isnan(v)), range(dims), F.col("worker_id").isNotNull())
    shape = ["items", *[f"c{k}" for k in range(dims)]]
    own = F.when(F.coalesce(known, F.lit(False)), "").otherwise(F.concat(F.lit("="), F.coalesce("worker_id", F.lit(""))))
    return p.withColumn("alone", own).withColumn("h", F.xxhash64(*shape, "alone")), ["h", *shape, "alone"]


def _copies(p: DataFrame, dims: int) -> DataFrame:
    """(worker_id array<string>, c0, c1, ...), stored: packed p with a row for up to about COPIES participants of the very same embedding."""
    marked, shape = _shape(p, dims)
    known, alone = marked.where("alone = ''"), marked.where("alone <> ''")
    many = known.groupBy(*shape).agg(F.count("*").alias("n"))
    bucket = F.pmod(F.xxhash64("worker_id"), F.ceil(F.col("n") / COPIES))
    rows = known.join(many, shape).withColumn("bucket", bucket).groupBy(*shape, "bucket").agg(F.sort_array(F.collect_list("worker_id")).alias("worker_id"))
    columns = [f"c{k}" for k in range(dims)]
    return materialize(rows.select("worker_id", *columns).unionByName(alone.select(F.array("worker_id").alias("worker_id"), *columns)), "different_embeddings")


def _tiles(p: DataFrame, dims: int, count: int) -> DataFrame:
    """(tile, ids, xs): packed embeddings dealt to so many tiles, each row flat by dimension and item."""
    flat = F.flatten(F.array(*[F.col(f"c{k}") for k in range(dims)]))
    tile = F.pmod(F.xxhash64("worker_id"), F.lit(count)).cast("int")
    return p.select(tile.alias("tile"), F.struct("worker_id", flat.alias("x")).alias("r")).groupBy("tile").agg(F.sort_array(F.collect_list("r")).alias("r")).select(
        "tile", F.transform("r", lambda x: x["worker_id"]).alias("ids"), F.transform("r", lambda x: x["x"]).alias("xs"))


def _traces(a: np.ndarray, b: np.ndarray, dims: int) -> np.ndarray:
    """Sums of the singular values of all cross products of two stacks of embeddings (n, dims * items)."""
    a, b = a.reshape(len(a), dims, -1), b.reshape(len(b), dims, -1)
    m = np.stack([a[:, i] @ b[:, j].T for i in range(dims) for j in range(dims)], axis=-1)
    if dims == 1:
        return np.abs(m[:, :, 0])
    if dims == 2:
        return np.sqrt((m * m).sum(-1) + 2 * np.abs(m[:, :, 0] * m[:, :, 3] - m[:, :, 1] * m[:, :, 2]))
    return np.linalg.svd(m.reshape(*m.shape[:2], dims, dims), compute_uv=False).sum(-1)


def rep_dist(embeddings: DataFrame, rootflag: bool = True, dims: int | None = None, strict: bool = True, tile: int = 256, digits: int | None = None) -> DataFrame:
    """(worker_a, worker_b, dist): symmetric Procrustes distances, both ways, 0 from oneself.

    rootflag: 1 - root of the explained share; else 1 - the share itself. digits: round to so many. All pairs are the result, so packed
    embeddings are gathered in tiles of at most `tile` rows and TILE_BYTES, and tiles in packs of up to SIDE, which meet in the
    cells of a grid: a pack is sent once for each partner. A cell gives its rows out by pairs of tiles. Participants with the very same
    embedding, centred and scaled, share a row, are sent and compared once, and come apart only in the result.
    """
    dims = dims or dimensions(embeddings)
    p = settled(materialize(packed(embeddings, dims, strict=False), "packed_embeddings"))
    if strict:
        same_items(p)
    n, items = p.agg(F.count("*"), F.coalesce(F.max(F.size("items")), F.lit(1))).first()
    different = _copies(p, dims)
    held = different.count()
    settled(different)  # after a job of its own: Spark still holds the last one's plan
    shared = held < n
    each = 8 * dims * max(1, items)
    many = max(1, min(tile, TILE_BYTES // each))
    # the fewer packs, the less is sent; small ones may be sent more often, for more tasks
    least = 16 if held * each <= 4 * TILE_BYTES else 8
    count = max(1, -(-held // many), min(held, least, n // 1024))
    side = max(1, min(SIDE, count // least, 4 * TILE_BYTES // (each * many)))
    blocks = -(-count // side)
    packs = _tiles(different if shared else p, dims, count).groupBy(F.expr(f"tile div {side}").cast("int").alias("own")).agg(F.collect_list(F.struct("tile", "ids", "xs")).alias("tiles"))
    # a number of its own: the few packs would else be coalesced into one task. Neither side is small, whatever its estimate says
    tasks = max(4 * p.sparkSession.sparkContext.defaultParallelism, blocks * (blocks + 1) // 2)
    left = packs.select(F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("j"), F.col("tiles").alias("a")).repartition(tasks, "i", "j")
    right = packs.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("tiles").alias("b")).repartition(tasks, "i", "j")

    def opened(tiles: pa.StructArray) -> list[tuple[int, pa.Array, np.ndarray]]:
        return [(t.as_py(), ids.values, np.asarray(xs.values.flatten()).reshape(len(ids), -1)) for t, ids, xs in zip(*[tiles.field(c) for c in ("tile", "ids", "xs")], strict=True)]

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same, second = batch.column("same")[row].as_py(), opened(batch.column("b")[row].values)
                for at, ids_a, xs_a in opened(batch.column("a")[row].values):
                    for bt, ids_b, xs_b in second:
                        if same and at > bt:
                            continue
                        t = _traces(xs_a, xs_b, dims)
                        d = (1 - t) if rootflag else (1 - t * t)
                        r, c = np.triu_indices(len(ids_a), 1) if at == bt else (x.ravel() for x in np.indices(d.shape))
                        if at == bt:
                            yield pa.RecordBatch.from_arrays([ids_a, ids_a, pa.array(np.zeros(len(ids_a)))], names=["worker_a", "worker_b", "dist"])
                        for s in range(0, len(r), 16384):
                            r_, c_ = r[s : s + 16384], c[s : s + 16384]
                            a, b, v = ids_a.take(pa.array(r_)), ids_b.take(pa.array(c_)), pa.array(d[r_, c_])
                            for x, y in ((a, b), (b, a)):
                                yield pa.RecordBatch.from_arrays([x, y, v], names=["worker_a", "worker_b", "dist"])

    met = left.hint("merge").join(right, ["i", "j"]).select((F.col("i") == F.col("j")).alias("same"), "a", "b")
    name = "array<string>" if shared else "string"
    found = met.mapInArrow(distances, f"worker_a {name}, worker_b {name}, dist double")
    if digits is not None:
        found = found.withColumn("dist", F.round("dist", digits) + 0.0)
    if shared:
        found = found.select(F.explode("worker_a").alias("worker_a"), "worker_b", "dist").select("worker_a", F.explode("worker_b").alias("worker_b"), "dist")
    return found


def same_shapes(embeddings: DataFrame, dims: int | None = None) -> DataFrame:
    """(name, first), stored: each participant beside the first one by name whose embedding has the same items and, centred and scaled, the very
    same coordinates, which is at distance 0 in rep_dist. One that can't be scaled or has unknown coordinates is only its own."""
    dims = dims or dimensions(embeddings)
    p, shape = _shape(packed(embeddings, dims, strict=False), dims)
    p = materialize(p, "shapes")
    return materialize(p.join(p.groupBy(*shape).agg(F.min("worker_id").alias("first")), shape).select(F.col("worker_id").alias("name"), "first"), "same_shapes")


def _summed(rows: DataFrame, keys: list[str], size: int, fan: int = 64) -> DataFrame:
    """(keys..., m): sums of the arrays m of so many numbers by key, in a tree: first of the rows of one bucket, then of the buckets."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys) + ", m array<double>"

    def total(group: pa.Table) -> pa.Table:
        m = np.zeros(size)
        for chunk in group.column("m").chunks:
            m += np.asarray(chunk.flatten()).reshape(-1, size).sum(0)
        return group.select(keys).slice(0, 1).append_column("m", pa.array([m], pa.list_(pa.float64())))

    first = rows.withColumn("bucket", F.col("bucket") % fan).groupBy(*keys, "bucket").applyInArrow(total, schema)
    return first.groupBy(*keys).applyInArrow(total, schema)


def normalised(embeddings: DataFrame, dims: int, strict: bool = True) -> DataFrame:
    """(worker_id, item_ix, coords): rows of centred embeddings with unit sum of squares; a row holds one item. strict: raise if
    participants have different items, or the same at different places."""
    e = require(embeddings, "worker_id", "item", "coords", "item_ix")
    at = [F.get("coords", k) for k in range(dims)]
    told = e.groupBy("worker_id").agg(F.count("*").alias("n"), F.array(*[F.avg(x) for x in at]).alias("mean"), F.sum(F.xxhash64("item_ix", "item").cast("decimal(38,0)")).alias("items"))
    told = materialize(told, "means")
    if strict and told.agg(F.count_distinct("n", "items").alias("n")).first().n > 1:
        raise ValueError("all embeddings need the same items")
    centred = e.join(small(told.select("worker_id", "mean")), "worker_id").select("worker_id", "item_ix", F.zip_with(F.slice("coords", 1, dims), "mean", lambda x, m: x - m).alias("coords"))
    norms = centred.groupBy("worker_id").agg(F.sqrt(F.sum(_dot(F.col("coords"), F.col("coords")))).alias("norm"))
    return centred.join(held(norms), "worker_id").select("worker_id", "item_ix", F.transform("coords", lambda x: x / F.nullif(F.col("norm"), F.lit(0.0))).alias("coords"))


def rep_dist_ranges(embeddings: DataFrame, rootflag: bool = True, dims: int | None = None, strict: bool = True, items: int = 1024, workers: int = 32) -> DataFrame:
    """rep_dist for embeddings of any number of items: no row or task holds one.

    Rows are dealt to buckets of about so many items, and within them to groups of about so many participants. A cell of a bucket
    and two groups gives the d * d cross products of their pairs over its items, which are summed in a tree.
    """
    ship(embeddings.sparkSession)
    dims = dims or dimensions(embeddings)
    rows = materialize(normalised(embeddings, dims, strict), "normalised_rows")
    n, w = rows.agg(F.count("*"), F.count_distinct("worker_id")).first()
    buckets, groups = max(1, -(-n // max(1, w) // items)), max(1, -(-w // workers))
    dealt = rows.select("worker_id", "item_ix", "coords", F.pmod(F.xxhash64("item_ix"), F.lit(buckets)).alias("bucket"), F.pmod(F.xxhash64("worker_id"), F.lit(groups)).cast("int").alias("own"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "worker_id", "item_ix", "coords")

    def cross(cell: pa.Table) -> pa.Table:
        bucket, i, j = (cell.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        names = sorted(set(cell.column("worker_id").to_pylist()))
        of = {x: k for k, x in enumerate(names)}
        own, worker = cell.column("own").to_numpy(), np.array([of[x] for x in cell.column("worker_id").to_pylist()])
        places, place = np.unique(cell.column("item_ix").to_numpy(), return_inverse=True)
        x = np.zeros((len(names), len(places), dims))
        x[worker, place] = np.concatenate([_matrix(c) for c in cell.column("coords").chunks])
        group = np.zeros(len(names), np.int64)
        group[worker] = own
        pairs = [(a, b) for a in range(len(names)) for b in range(len(names)) if a < b and sorted((group[a], group[b])) == [i, j]]
        return pa.table({"worker_a": pa.array([names[a] for a, _ in pairs], pa.string()), "worker_b": pa.array([names[b] for _, b in pairs], pa.string()),
                         "bucket": pa.array([bucket] * len(pairs), pa.int64()), "m": pa.array([(x[a].T @ x[b]).ravel() for a, b in pairs], pa.list_(pa.float64()))})

    products = cells.groupBy("bucket", "i", "j").applyInArrow(cross, "worker_a string, worker_b string, bucket long, m array<double>")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.linalg.svd(_matrix(batch.column(2)).reshape(-1, dims, dims), compute_uv=False).sum(1) if batch.num_rows else np.empty(0)
            d = pa.array((1 - t) if rootflag else (1 - t * t))
            for a, b in ((0, 1), (1, 0)):
                yield pa.RecordBatch.from_arrays([batch.column(a), batch.column(b), d], names=["worker_a", "worker_b", "dist"])

    schema = "worker_a string, worker_b string, dist double"
    found = _summed(products, ["worker_a", "worker_b"], dims * dims).mapInArrow(distances, schema)
    same = rows.select("worker_id").distinct().select(F.col("worker_id").alias("worker_a"), F.col("worker_id").alias("worker_b"), F.lit(0.0).alias("dist"))
    return found.unionByName(same)


def _rotation(dims: int, scale: bool) -> Column:
    """c * A by rows, from m: the cross products of base and embedding (base rows, embedding columns)."""
    if dims == 1:
        s = F.when(F.col("m00") < 0, -1.0).otherwise(1.0)
        return F.array(s * (F.abs("m00") if scale else F.lit(1.0)))
    if dims == 2:
        m00, m01, m10, m11 = (F.col(c) for c in ("m00", "m01", "m10", "m11"))
        det = m00 * m11 - m01 * m10
        s = F.when(det < 0, -1.0).otherwise(1.0)
        t = F.nullif(nuclear_norm(2), F.lit(0.0))
        q = [m00 + s * m11, m01 - s * m10, m10 - s * m01, m11 + s * m00]
        q = [q[0], q[2], q[1], q[3]]
        return F.array(*[x if scale else x / t for x in q])

    @F.pandas_udf("array<double>")
    def turn(*columns: pd.Series) -> pd.Series:
        m = np.stack([c.to_numpy() for c in columns], 1).reshape(-1, dims, dims)
        u, s, vt = np.linalg.svd(m)
        a = np.einsum("nij,njk->nik", u, vt).transpose(0, 2, 1) * (s.sum(1)[:, None, None] if scale else 1.0)
        return pd.Series(list(a.reshape(len(a), -1)))

    return turn(*[F.col(f"m{i}{j}") for i in range(dims) for j in range(dims)])


def _align(p: DataFrame, base: DataFrame, dims: int, scale: bool, by: str | None = None) -> DataFrame:
    """Rows of packed p turned onto base (worker columns b_...): (by, worker_id, items, c0, ...)."""
    met = p.join(base, by) if by else p.join(F.broadcast(base), F.lit(True))  # the base is one row a group
    named = met.select(*([by] if by else []), "worker_id", "worker_ix", "items", *[F.col(f"c{k}").alias(f"a_c{k}") for k in range(dims)], *[f"b_c{k}" for k in range(dims)])
    turned = named.select("*", *_cross(dims, "b_", "a_")).withColumn("rot", _rotation(dims, scale))

    def column(j: int) -> Column:
        parts = [F.transform(f"a_c{i}", _times(F.get("rot", i * dims + j))) for i in range(dims)]
        total = parts[0]
        for x in parts[1:]:
            total = F.zip_with(total, x, lambda s, y: s + y)
        return total.alias(f"c{j}")

    return turned.select(*([by] if by else []), "worker_id", "worker_ix", "items", *[column(j) for j in range(dims)])


def _unpack(p: DataFrame, dims: int, *keys: str) -> DataFrame:
    rows = F.arrays_zip(F.col("items").alias("item"), *[F.col(f"c{k}") for k in range(dims)])
    return p.select(*keys, F.posexplode(rows).alias("item_ix", "x")).select(
        *keys, F.col("item_ix").cast("long"), "x.item", F.array(*[F.col(f"x.c{k}") for k in range(dims)]).alias("coords"))


def align_embeddings(embeddings: DataFrame, scale: bool = True, base: str | None = None, dims: int | None = None, strict: bool = True) -> DataFrame:
    """(worker_id, item_ix, item, coords): each embedding turned, reflected and scaled onto the base's, all centred with unit sum of squares.

    base: a worker_id; the first by worker_ix if not given. scale=False keeps the normalised size.
    """
    dims = dims or dimensions(embeddings)
    p = packed(embeddings, dims, strict)
    chosen = p.where(F.col("worker_id") == base) if base else p.orderBy("worker_ix", "worker_id").limit(1)
    if base and chosen.isEmpty():
        raise ValueError(f"unknown participant: {base}")
    return _unpack(_align(p, chosen.select(*[F.col(f"c{k}").alias(f"b_c{k}") for k in range(dims)]), dims, scale), dims, "worker_id")


def group_mean_aligned(embeddings: DataFrame, clusters: DataFrame, dims: int | None = None, strict: bool = True) -> DataFrame:
    """(cluster, item_ix, item, coords): mean of each group's embeddings, aligned on its first member."""
    dims = dims or dimensions(embeddings)
    p = packed(embeddings, dims, strict).join(held(clusters.select("worker_id", F.col("cluster").cast("int").alias("cluster"))), "worker_id")
    first = p.groupBy("cluster").agg(F.min_by(F.struct(*[f"c{k}" for k in range(dims)]), F.struct("worker_ix", "worker_id")).alias("b")).select(
        "cluster", *[F.col(f"b.c{k}").alias(f"b_c{k}") for k in range(dims)])
    rows = _unpack(_align(p, first, dims, True, by="cluster"), dims, "cluster")
    return rows.groupBy("cluster", "item_ix", "item").agg(F.array(*[F.avg(F.get("coords", k)) for k in range(dims)]).alias("coords"))


def principal_axes(mean: DataFrame, dims: int) -> DataFrame:
    """(cluster, n, axes): the eigenvectors of each group's d * d moments, flat by column, by falling eigenvalue; a row a group."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cluster, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for c in np.unique(cluster):
                own = x[cluster == c]
                held[c] = held.get(c, 0) + np.append(own.T @ own, len(own))
        if held:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([part] * len(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["cluster", "bucket", "m"])

    def axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            vectors = [np.linalg.eigh(r[:-1].reshape(dims, dims))[1][:, ::-1].T.ravel() for r in m]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m[:, -1].astype(np.int64)), pa.array(vectors, pa.list_(pa.float64()))], names=["cluster", "n", "axes"])

    parts = mean.select("cluster", "coords").mapInArrow(moments, "cluster int, bucket long, m array<double>")
    return _summed(parts, ["cluster"], dims * dims + 1).mapInArrow(axes, "cluster int, n long, axes array<double>")


def rotated(mean: DataFrame, dims: int) -> DataFrame:
    """(cluster, item_ix, item, coords): U * D of each group's coordinates, by rows; in each column the coordinate of largest magnitude
    (the first on a tie) is positive. A group's rows stay where they are: only its moments and signs are gathered."""
    axes = small(materialize(principal_axes(mean, dims), "axes"))
    turned = mean.join(axes, "cluster").select("cluster", "item_ix", "item", "n", *[_dot(F.col("coords"), F.slice("axes", k * dims + 1, dims)).alias(f"y{k}") for k in range(dims)])
    turned = materialize(turned, "turned")
    largest = [F.max_by(F.signum(f"y{k}"), F.struct(F.round(F.abs(f"y{k}"), 12), -F.col("item_ix"))).alias(f"s{k}") for k in range(dims)]
    signs = held(turned.groupBy("cluster").agg(*largest))
    kept = F.slice(F.array(*[F.when(F.col(f"s{k}") < 0, -F.col(f"y{k}")).otherwise(F.col(f"y{k}")) for k in range(dims)]), 1, F.least(F.lit(dims), F.col("n")).cast("int"))
    return turned.join(signs, "cluster").select("cluster", "item_ix", "item", kept.alias("coords"))


def group_list_mean(embeddings: DataFrame, clusters: DataFrame, dims: int | None = None, strict: bool = True) -> DataFrame:
    """(group, item_ix, item, coords): group means on their principal axes."""
    dims = dims or dimensions(embeddings)
    made = rotated(materialize(group_mean_aligned(embeddings, clusters, dims, strict), "group_means"), dims)
    return made.select(F.concat(F.lit("group-"), F.col("cluster").cast("string")).alias("group"), "item_ix", "item", "coords")
