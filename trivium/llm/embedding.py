"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 9).

Equal vectors of one label count once, with their number. Unit vectors are turned onto the principal axes
of all vectors' second moments, sorted by label and nearest pivots over the cluster, and cut
into tiles. Pivots are PIVOTS vectors, least by hash; like the axes, they steer the order of the work, never the result. A tile's summary (centre and radius in the leading axes, least and greatest suffix norm) rules out most
tiles of its label before any vector moves; the salted join of summaries has no hot label. Open pairs of tiles
meet in grid cells of BLOCK by BLOCK tiles, up to eight times as many along a side where tiles are many and small, so a tile is sent once for
each cell, not for each partner. A cell's pairs meet its tiles there and don't ride on them.

In a cell two tiles are compared by products of the leading STEP dimensions first; the rest is bounded by the product of the
suffix norms (Cauchy-Schwarz), rows and columns that cannot reach the threshold any more are dropped, and the
comparison stops when none is left. The bounds are taken in single precision, with room for its rounding. Pairs that remain are decided
by the cosine of the original vectors in double precision.

A pair of tiles gives each vector's number of links and a spanning forest of the links, never the pairs,
so a label that holds a third of all vectors, or a group of near copies, gives rows in
proportion to its vectors for each tile that it meets.

Defined results: rows with a null label, or a vector that is null, empty, zero or holds null or non-finite
values, link with nothing; vectors of different length don't link; a null vec_id links with nothing and isn't
kept; repeated rows are linked with each other and each returned; rows that share a vec_id but
not the vector each count their own vector's links and are one node of the components; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivium.llm.components import components
from trivium.llm.store import materialize, settled
from trivium.schema import small
from trivium.shipping import ship

#: Vectors and bytes of a tile, tiles along a side of a cell of few tiles, bytes along one of many, dimensions of a step and of a summary, pivots.
TILE, TILE_BYTES, BLOCK, BLOCK_BYTES, STEP, LEAD, PIVOTS, SLACK = 1024, 1 << 22, 16, 1 << 25, 16, 16, 256, 1e-9
TILE_SCHEMA = "label long, dim int, part int, seq int, ids array<long>, nodes array<long>, weights array<long>, vectors binary, centre array<double>, radius double, least double, most double"
FOUND = "id long, n long, a long, b long"


def _batch(columns, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _rows(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v, good): good tells whether a row can link. Single-precision vectors stay so until they are compared."""
    single = isinstance(getattr(vectors.schema[embedding].dataType, "elementType", None), T.FloatType)
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    return vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v")
    ).withColumn("good", F.coalesce(good, F.lit(False)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaling first keeps squares finite and above zero for any double."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(table: pa.Table) -> pa.Table:
    """One row with the sum of a group's packed doubles."""
    total = sum(np.frombuffer(x.as_py()) for x in table.column("s"))
    return pa.table({"d": table.column("d")[:1], "chunk": table.column("chunk")[:1], "slot": pa.array([0], pa.int32()), "s": pa.array([total.tobytes()], pa.binary())})


def principal_axes(classes: DataFrame, slots: int = 64, chunk: int = 1 << 16) -> dict[int, np.ndarray]:
    """By dimension, the eigenvectors of the unit vectors' second moments, largest first.

    Each task sums its vectors to one packed matrix, in chunks; chunks are summed in two steps over the cluster, and d * d doubles
    a dimension reach the driver (the dimensions that occur are few). They steer only the order of the work, never the result.
    """
    schema = "d int, chunk int, slot int, s binary"

    def moments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for batch in rows:
            dims = np.asarray(batch.column(0).value_lengths())
            for d in np.unique(dims):
                u = _unit(_matrix(batch.column(0).filter(pa.array(dims == d)), int(d)).astype(float))
                sums[int(d)] = sums.get(int(d), 0) + u.T @ u
        for d, s in sums.items():
            for k in range(0, d * d, chunk):
                yield _batch([[d], [k // chunk], [TaskContext.get().partitionId() % slots], [s.ravel()[k : k + chunk].tobytes()]], schema)

    parts = classes.select("v").mapInArrow(moments, schema)
    for keys in (("d", "chunk", "slot"), ("d", "chunk")):
        parts = parts.groupBy(*keys).applyInArrow(_summed, schema)
    packed: dict[int, dict[int, bytes]] = {}
    for r in parts.collect():
        packed.setdefault(r.d, {})[r.chunk] = r.s
    return {d: np.linalg.eigh(np.frombuffer(b"".join(s[k] for k in sorted(s))).reshape(d, d))[1][:, ::-1] for d, s in packed.items()}


def _chain(pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivots as columns, each next to one near it; the number of wide gaps before each)."""
    cosine, order = pivots @ pivots.T, [0]
    left = np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        order.append(int(np.argmax(np.where(left, cosine[order[-1]], -2))))
        left[order[-1]] = False
    gaps = np.array([0, *(cosine[a, b] < 0.8 for a, b in zip(order, order[1:]))])  # noqa: B905
    return pivots[order].T, np.cumsum(gaps)


def tiles(classes: DataFrame, axes) -> DataFrame:
    """TILE_SCHEMA rows of classes(id, node, label, v, weight), sorted by label, the two nearest pivots and the cosine with the first."""
    chosen: dict[int, list] = {}
    for r in classes.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect():
        chosen.setdefault(len(r.v), []).append(r.v)
    pivots = classes.sparkSession.sparkContext.broadcast({d: _chain(_unit(np.array(v, float))) for d, v in chosen.items()})

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            v = batch.column(batch.schema.get_field_index("v"))
            dims, lead = np.asarray(v.value_lengths()), np.zeros(batch.num_rows)
            group, code = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims):
                at = dims == d
                if int(d) not in pivots.value:
                    continue
                columns, gaps = pivots.value[int(d)]
                near = _unit(_matrix(v.filter(pa.array(at)), int(d)).astype(float)) @ columns
                best, every = near.argmax(1), np.arange(len(near))
                group[at], code[at], lead[at] = gaps[best], best * PIVOTS, near[every, best]
                near[every, best] = -2
                code[at] += near.argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(group), pa.array(code), pa.array(lead)], names=[*batch.schema.names, "dim", "group", "code", "lead"])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, key, held, parts = TaskContext.get().partitionId(), 0, None, 0, []

        def tile() -> pa.RecordBatch:
            ids, nodes, weights, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            y = _unit(v.astype(float)) @ axes.value[key[1]][:, :LEAD]
            centre, rest = y.mean(0), np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))
            radius = np.sqrt(((y - centre) ** 2).sum(1).max())
            return _batch([[key[0]], [key[1]], [part], [seq], [ids], [nodes], [weights], [v.tobytes()], [centre], [radius], [rest.min()], [rest.max()]], TILE_SCHEMA)

        for batch in rows:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            label, dim, group, ids, nodes, weights = (column[c].to_numpy(zero_copy_only=False) for c in ("label", "dim", "group", "id", "node", "weight"))
            new = np.flatnonzero((np.diff(label) != 0) | (np.diff(dim) != 0) | (np.diff(group) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                now = int(label[a]), int(dim[a]), int(group[a])
                # behind a gap between pivots, a tile that is an eighth full ends, so that tiles stay small in space
                if parts and (key[:2] != now[:2] or key != now and 8 * held >= size):
                    yield tile()
                    seq, held, parts = seq + 1, 0, []
                key, size = now, max(32, min(TILE, TILE_BYTES // (8 * now[1])))
                vectors = _matrix(column["v"].slice(a, b - a), key[1])
                while a < b:
                    n = min(b - a, size - held)
                    parts.append((ids[a : a + n], nodes[a : a + n], weights[a : a + n], vectors[:n]))
                    a, held, vectors = a + n, held + n, vectors[n:]
                    if held == size:
                        yield tile()
                        seq, held, parts = seq + 1, 0, []
        if parts:
            yield tile()

    element = classes.schema["v"].dataType.simpleString()
    placed = classes.select("id", "node", "label", "v", "weight").mapInArrow(place, f"id long, node long, label long, v {element}, weight long, dim int, group long, code long, lead double")
    ordered = placed.repartitionByRange("label", "dim", "code", "lead", "id").sortWithinPartitions("label", "dim", "code", "lead", "id")
    return ordered.mapInArrow(cut, TILE_SCHEMA)


def open_pairs(cut: DataFrame, threshold: float) -> DataFrame:
    """(dim, ta, tb) of tiles of one label that can hold a link, ta <= tb, by their summaries.

    Unit vectors with a cosine of t are sqrt(2 - 2 t) apart. Two tiles are at least as far apart as their balls in the leading axes
    and their suffix norms.
    """
    salts = max(1, cut.count() // 64)
    t = F.struct("part", "seq")
    own = cut.select("label", "dim", t.alias("ta"), *[F.col(c).alias(f"{c}_a") for c in ("centre", "radius", "least", "most")], F.pmod(F.xxhash64(t), F.lit(salts)).alias("salt"))
    every = cut.select("label", "dim", t.alias("tb"), *[F.col(c).alias(f"{c}_b") for c in ("centre", "radius", "least", "most")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    square = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    lead = F.greatest(F.lit(0.0), F.sqrt(square) - F.col("radius_a") - F.col("radius_b"))
    rest = F.greatest(F.lit(0.0), F.col("least_a") - F.col("most_b"), F.col("least_b") - F.col("most_a"))
    near = lead * lead + rest * rest <= 2 - 2 * threshold + 1e-6
    return own.join(every, ["label", "dim", "salt"]).where("ta <= tb").where(near).select("dim", "ta", "tb")


def sides(tiles: int, vectors: int, dim: int) -> int:
    """Tiles along a side of a cell: BLOCK, or up to eight times as many if there are enough tiles for many cells and a side stays about in BLOCK_BYTES."""
    return max(BLOCK, min(8 * BLOCK, tiles // 8, BLOCK_BYTES * tiles // (8 * dim * max(1, vectors))))


def reachable(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two blocks of turned unit vectors whose cosine can reach the threshold, and maybe some that are a rounding below it."""
    least = threshold - SLACK - 2 * a.shape[1] * float(np.finfo(a.dtype).eps)
    rest_a = np.sqrt(np.cumsum((a * a)[:, ::-1], 1)[:, ::-1])
    rest_b = np.sqrt(np.cumsum((b * b)[:, ::-1], 1)[:, ::-1])
    rows, columns, total = np.arange(len(a)), np.arange(len(b)), 0
    for k in range(0, a.shape[1], STEP):
        total = total + a[rows, k : k + STEP] @ b[columns, k : k + STEP].T
        end = k + STEP
        bound = total + np.outer(rest_a[rows, end], rest_b[columns, end]) if end < a.shape[1] else total
        open_ = bound >= least
        r, c = open_.any(1), open_.any(0)
        if not r.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if not (r.all() and c.all()):
            rows, columns, total, open_ = rows[r], columns[c], total[np.ix_(r, c)], open_[np.ix_(r, c)]
    i, j = np.nonzero(open_)
    return rows[i], columns[j]


class Forest:
    """Union-find over row numbers that keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def compare(axes, threshold: float, single: bool):
    """A cogrouped applyInArrow function over a cell's tiles and its open pairs: rows (id, n) add n links to vector id, rows (a, b) link two nodes."""

    def found(table: pa.Table, cell: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        held, pairs = {}, cell.column("pairs")[0].as_py()
        for k, (part, seq) in enumerate(zip(table.column("part").to_pylist(), table.column("seq").to_pylist(), strict=True)):
            take = lambda c, k=k: np.array(table.column(c)[k].as_py(), np.int64)
            u = _unit(np.frombuffer(table.column("vectors")[k].as_py(), np.float32 if single else float).reshape(-1, dim).astype(float))
            held[part, seq] = u, (u @ axes.value[dim]).astype(np.float32), take("ids"), take("nodes"), take("weights")
        counts, links = [], []
        for p in pairs:
            ka, kb = ((p[x]["part"], p[x]["seq"]) for x in ("ta", "tb"))
            (ua, ya, ia, na, wa), (ub, yb, ib, nb, wb) = held[ka], held[kb]
            i, j = reachable(ya, yb, threshold)
            if ka == kb:
                i, j = i[i < j], j[i < j]
            hit = np.zeros(len(i), bool)
            for s in range(0, len(i), 65_536):
                hit[s : s + 65_536] = (ua[i[s : s + 65_536]] * ub[j[s : s + 65_536]]).sum(1) >= threshold
            i, j = i[hit], j[hit]
            for ids, number in ((ia, np.bincount(i, wb[j], len(ia))), (ib, np.bincount(j, wa[i], len(ib)))):
                some = np.flatnonzero(number)
                counts.append((ids[some], number[some].astype(np.int64)))
            nodes = np.concatenate([na, nb])
            forest, j = Forest(len(nodes)), j if ka == kb else j + len(na)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(x, y)
            x, y = np.array(forest.links, np.int64).reshape(-1, 2).T
            links.append((nodes[x], nodes[y]))
        (ids, n), (a, b) = ([np.concatenate(c) for c in zip(*x, strict=True)] for x in (counts, links))
        empty = lambda k: pa.nulls(k, pa.int64())
        columns = [(ids, empty(len(a))), (n, empty(len(a))), (empty(len(ids)), a), (empty(len(ids)), b)]
        return pa.table({c: pa.chunked_array([pa.array(x, pa.int64()) for x in parts], pa.int64()) for c, parts in zip("id n a b".split(), columns, strict=True)})

    return found


def within(keys: DataFrame) -> DataFrame:
    """keys with a hint for their join with tiles: broadcast up to BROADCAST_ROWS, else by exchange, as a compressed table's size tells little of its rows'."""
    told = small(keys)
    return told if told is not keys else keys.hint("merge")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    ship(vectors.sparkSession)
    rows = _rows(vectors, vec_id, embedding, label)
    keyed = materialize(rows.where("good").select("vec_id", "label", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"), "v"), "usable_vectors")
    by = ("label", "h1", "h2")
    classes = materialize(keyed.groupBy(*by).agg(F.min(F.struct("vec_id", "v")).alias("m"), F.count("*").alias("weight")).select(
        F.monotonically_increasing_id().alias("id"), F.col("m.vec_id").alias("node"), *by, F.col("m.v").alias("v"), "weight"), "vector_classes")
    settled(classes)
    axes = vectors.sparkSession.sparkContext.broadcast(principal_axes(classes))
    cut = settled(materialize(tiles(classes, axes), "tiles"))
    side = sum((F.when(F.col("dim") == r.dim, sides(r.n, r.vectors, r.dim)).otherwise(0) for r in cut.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("vectors")).collect()), F.lit(0))  # dimensions are few
    block = lambda t: F.struct(F.col(f"{t}.part").alias("part"), F.floor(F.col(f"{t}.seq") / side).alias("seq"))
    cells = open_pairs(cut, threshold).groupBy("dim", block("ta").alias("i"), block("tb").alias("j")).agg(F.collect_list(F.struct("ta", "tb")).alias("pairs"))
    cells = materialize(cells, "cells")
    # a cell's pairs meet its tiles once, in the cogroup, and don't ride on each of them
    wanted = cells.select("dim", "i", "j", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["ta"], p["tb"]))))).alias("t"))
    sent = within(wanted.select("dim", "i", "j", "t.part", "t.seq")).join(cut.select("part", "seq", "ids", "nodes", "weights", "vectors"), ["part", "seq"])
    single = classes.schema["v"].dataType.elementType == T.FloatType()
    given = cells.select(*[F.col(c).alias(f"of_{c}") for c in ("dim", "i", "j")], "pairs").groupBy("of_dim", "of_i", "of_j")
    found = materialize(sent.groupBy("dim", "i", "j").cogroup(given).applyInArrow(compare(axes, threshold, single), FOUND), "found")
    number = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    # a vec_id with several vectors makes one node of their classes
    several = keyed.select("vec_id", *by).distinct().groupBy("vec_id").count().where("count > 1").select("vec_id")
    own = classes.select("id", "node", *by, "weight")
    shared = keyed.select("vec_id", *by).join(several, "vec_id").distinct().join(own, [*by]).select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    part = components(found.where("a is not null").select("a", "b").unionByName(shared))
    named = own.join(number, "id", "left").join(part, "node", "left").select(
        *by, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = keyed.select("vec_id", *by).join(materialize(named, "named"), [*by]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
