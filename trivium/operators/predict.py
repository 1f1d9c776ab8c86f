"""Predicting choices from similarity embeddings or distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.schema import held, require, small
from trivium.scratch import materialize
from trivium.shipping import ship

#: Coordinates that one packed model may hold (80 MB), items of a model that trials meet in one row, and dimensions that are written out.
PACKED, LOOKUP, UNROLLED = 10_000_000, 2_000, 8
#: Trials, bytes of models and models in a tile of the prediction matrix; models and judges that are compared at once.
TILE_TRIALS, TILE_BYTES, TILE_MODELS, MODELS, JUDGES = 1 << 17, 1 << 22, 4096, 256, 2048
CELL = "judge_id string, model_id string, n long, right long, unknown long"
MOMENTS = "judge_id string, cluster int, n long, models long, total long, squares long, own long"


def squared_distance(a: Column, b: Column, dims: int | None = None) -> Column:
    """Squared Euclidean distance; with dims given, unrolled into plain arithmetic, which is compiled."""
    if dims:
        return reduce(lambda s, k: s + (F.get(a, k) - F.get(b, k)) * (F.get(a, k) - F.get(b, k)), range(dims), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _packed_lookup(d: DataFrame, model: DataFrame, by: tuple[str, ...], distances: bool) -> DataFrame:
    """d with d1, d2, each model packed as one row with its items' names beside their points (or distances) and met once by its keys.

    The trials move once, by the keys alone, so adaptive execution can split a participant with very many of them.
    """
    at = lambda names, side: F.array_position(names, F.col(side)).cast("int") - 1  # noqa: E731  -1, beyond the array, if absent
    if distances:
        rows = model.repartition(*by).groupBy(*by, "item_a").agg(F.sort_array(F.collect_list(F.struct("item_b", "dist"))).alias("row"))
        packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("item_a", F.col("row.item_b").alias("names"), F.col("row.dist").alias("dists")))).alias("_rows"))
        met = d.join(packed, list(by), "left").withColumn("_row", F.get("_rows", at(F.col("_rows.item_a"), "Center")))
        found = {out: F.get(F.col("_row.dists"), at(F.col("_row.names"), side)) for side, out in (("Left", "d1"), ("Right", "d2"))}
        return met.withColumns(found).drop("_rows", "_row")
    sizes = model.agg(F.min(F.size("coords")).alias("least"), F.max(F.size("coords")).alias("most")).first()
    dims = sizes.most if sizes.least == sizes.most and sizes.most <= UNROLLED else None
    packed = model.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("item", "coords"))).alias("_points"))
    met = d.join(packed.select(*by, F.col("_points.item").alias("_names"), F.col("_points.coords").alias("_coords")), list(by), "left")
    point = lambda side: F.get("_coords", at(F.col("_names"), side))
    return met.withColumns({out: squared_distance(point("Center"), point(side), dims) for side, out in (("Left", "d1"), ("Right", "d2"))}).drop("_names", "_coords")


def _with_distances(d: DataFrame, model: DataFrame, by: tuple[str, ...], distances: bool) -> DataFrame:
    """d with d1, d2: distances of Center from Left and Right (squared for embeddings); null if an item is missing.

    by: columns that trials and model share, such as worker_id; without them one model serves all trials. Models of at most
    LOOKUP items are packed (an item that a model names twice counts once there); others are joined by item.
    """
    require(d, "Center", "Left", "Right")
    model = require(model, "item_a", "item_b", "dist") if distances else require(model, "item", "coords")
    if by:
        most = model.groupBy(*by).agg((F.count_distinct("item_a") if distances else F.count("*")).alias("n")).agg(F.max("n").alias("n")).first().n
        if (most or 0) <= LOOKUP:
            return _packed_lookup(d, model, by, distances)
    for side, out in (("Left", "d1"), ("Right", "d2")) if distances else ():
        table = model.select(*by, F.col("item_a").alias("Center"), F.col("item_b").alias(side), F.col("dist").alias(out))
        d = d.join(table if by else small(table), [*by, "Center", side], "left")
    if distances:
        return d
    table = model.select(*by, "item", "coords")
    table = table if by else small(table)
    for side in ("Center", "Left", "Right"):
        d = d.join(table.select(*by, F.col("item").alias(side), F.col("coords").alias(f"_{side}")), [*by, side], "left")
    return d.withColumns({"d1": squared_distance(F.col("_Center"), F.col("_Left")), "d2": squared_distance(F.col("_Center"), F.col("_Right"))}).drop("_Center", "_Left", "_Right")


def test_model(d: DataFrame, model: DataFrame, by: tuple[str, ...] = (), distances: bool = False) -> DataFrame:
    """d with ModPred, the option nearer to the Center; a tie goes Right, a missing item gives null."""
    nearer = F.when(F.col("d1") < F.col("d2"), F.col("Left")).when(F.col("d1") >= F.col("d2"), F.col("Right"))
    return _with_distances(d, model, by, distances).withColumn("ModPred", nearer).drop("d1", "d2")


test_model.__test__ = False


def missing_items(d: DataFrame, model: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., item): items of the trials that the model lacks; by: columns that trials and model share."""
    named = d.select(*by, F.explode(F.array("Center", "Left", "Right")).alias("item")).where("item is not null").distinct()
    return named.join(model.select(*by, "item"), [*by, "item"], "left_anti")


def model_strength(d: DataFrame, model: DataFrame, by: tuple[str, ...] = (), distances: bool = False) -> DataFrame:
    """d with strength, max(d1, d2) / (d1 + d2); null where both are 0 or an item is missing."""
    root = (lambda c: F.col(c)) if distances else (lambda c: F.sqrt(c))
    a, b = root("d1"), root("d2")
    return _with_distances(d, model, by, distances).withColumn("strength", F.greatest(a, b) / F.nullif(a + b, F.lit(0.0))).drop("d1", "d2")


def accuracy(equal: Column) -> Column:
    """Mean of a comparison; null if any is unknown or there is none."""
    return F.when(F.count_if(equal.isNull()) == 0, F.avg(equal.cast("double")))


def hoacc(d: DataFrame, model: DataFrame, trialtype: str = "test", by: tuple[str, ...] = (), distances: bool = False) -> DataFrame:
    """(by..., acc, n): accuracy of the model's predictions on one sampleSet; one row without by."""
    tested = test_model(require(d, "sampleSet", "Answer").where(F.col("sampleSet") == trialtype), model, by, distances)
    return tested.groupBy(*by).agg(accuracy(F.col("ModPred") == F.col("Answer")).alias("acc"), F.count("*").alias("n"))


def item_codes(embeddings: DataFrame) -> DataFrame:
    """(item, code): places of the items in packed models."""
    once = embeddings.groupBy("item").agg(F.min("item_ix").alias("item_ix"))
    return once.select("item", (F.row_number().over(Window.orderBy("item_ix", "item")) - 1).alias("code"))


def _choices(triplets: np.ndarray, known: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, has), by triplet of item codes (Center, Left, Right) and model: whether it is Left that is nearer, and whether the model has
    all three items; points: (models, items, dimensions). The distances of all items are taken first where there are more triplets."""
    (c, a, b), has, x = triplets, known.T.copy(), points.transpose(2, 1, 0).copy()
    left, all_has = np.empty((len(c), len(points)), bool), np.empty((len(c), len(points)), bool)
    near = sum((p[:, None] - p) ** 2 for p in x) if len(x) and x.shape[1] ** 2 <= len(c) else None
    for i in range(0, len(c), 1024):
        c_, a_, b_ = c[i : i + 1024], a[i : i + 1024], b[i : i + 1024]
        left[i : i + 1024] = near[c_, a_] < near[c_, b_] if near is not None else sum((p[c_] - p[a_]) ** 2 for p in x) < sum((p[c_] - p[b_]) ** 2 for p in x)
        all_has[i : i + 1024] = has[c_] & has[a_] & has[b_]
    return left, all_has


def _counted(table: np.ndarray, place: np.ndarray, k: np.ndarray, start: np.ndarray, many: np.ndarray, kind: type) -> np.ndarray:
    """(judges, models): sums of the table's rows at the places of each judge's trials, each k times; a judge has many from start on."""
    order = np.argsort(-many, kind="stable")
    start, falling, out = start[order], -many[order], np.zeros((len(many), table.shape[1]), kind)
    for r in range(-falling.min(initial=0)):
        live = np.searchsorted(falling, -r)  # judges with more than r trials stand first
        at = start[:live] + r
        rows, times = table[place[at]], k[at]
        out[:live] += rows if (times == 1).all() else rows * times[:, None].astype(kind)
    back = np.empty_like(out)
    back[order] = out
    return back


def agreement_tiles(many: np.ndarray, triplets: np.ndarray, answer: np.ndarray, k: np.ndarray, known: np.ndarray, points: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(judges, models, n, right, unknown) of slices of judges and models, n by judge and the others by both.

    many: trials by judge, whose trials stand behind each other; triplets: item codes of Center, Left and Right, -1 for items without a
    code; answer: bits 1 if it is Left, 2 if Right, -1 if unknown; k: how often; known: whether a model has an item. A model's choices on
    different triplets are rows of a table, of which each judge's answers select those that agree.
    """
    judge = np.repeat(np.arange(len(many)), many)
    n, blank = np.bincount(judge, k, len(many)).astype(np.int64), (answer < 0) | (triplets < 0).any(0)
    gaps = np.bincount(judge[blank], k[blank], len(many)).astype(np.int64)
    judge, triplets, answer, k = judge[~blank], triplets[:, ~blank], answer[~blank].astype(np.int64), k[~blank]
    kind = next(x for x in (np.uint8, np.uint16, np.int64) if n.max(initial=0) <= np.iinfo(x).max)
    base = int(triplets.max(initial=0)) + 1
    if base < 1 << 20:
        key, place = np.unique((triplets[0].astype(np.int64) * base + triplets[1]) * base + triplets[2], return_inverse=True)
        different = np.stack([key // (base * base), key // base % base, key % base])
    else:
        different, place = np.unique(triplets, axis=1, return_inverse=True)
    place, t = place.reshape(-1), different.shape[1]
    told = answer > 0
    ends = lambda j: (np.searchsorted(j, np.arange(len(many))), np.bincount(j, minlength=len(many)))
    (start, size), (every, sizes) = ends(judge[told]), ends(judge)
    right_at, right_k = place[told] + t * (answer[told] - 1), k[told]
    for m in range(0, len(points), MODELS):
        left, has = _choices(different, known[m : m + MODELS], points[m : m + MODELS])
        sides = [left & has, ~left & has] + ([has] if (answer == 3).any() else [])
        table, lacks = np.concatenate(sides).view(np.uint8), None if has.all() else (~has).view(np.uint8)
        for j in range(0, len(many), JUDGES):
            at = slice(j, j + JUDGES)
            right = _counted(table, right_at, right_k, start[at], size[at], kind)
            unknown = np.broadcast_to(gaps[at, None], right.shape)
            if lacks is not None:
                unknown = unknown + _counted(lacks, place, k, every[at], sizes[at], kind)
            yield at, slice(m, m + MODELS), n[at], right, unknown


def _cell(judges: pa.StructArray, models: pa.StructArray, items: int, dims: int) -> tuple[pa.Array, pa.StructArray, Iterator]:
    """(names of the judges, models by cluster, their agreement) of a cell of the grid."""
    names = lambda c: judges.field(c).flatten().to_numpy()
    if (cluster := models.field("cluster")).null_count < len(cluster):
        models = models.take(pa.compute.sort_indices(cluster))
    lists = models.field("codes")
    row, code = np.repeat(np.arange(len(models)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    points, known = np.zeros((len(models), items, dims)), np.zeros((len(models), items), bool)
    points[row, code] = models.field("coords").flatten().to_numpy().reshape(-1, dims)
    known[row, code] = True
    many = judges.field("k").value_lengths().to_numpy().astype(np.int64)
    return judges.field("judge_id"), models, agreement_tiles(many, np.stack([names(c) for c in ("c", "a", "b")]), names("answer"), names("k"), known, points)


def _pairs(items: int, dims: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names, models, tiles = _cell(batch.column("judges")[r].values, batch.column("models")[r].values, items, dims)
                for at, own, n, right, unknown in tiles:
                    judge, model = (pa.array(x.ravel()) for x in np.indices(right.shape))
                    columns = [names[at].take(judge), models.field("id")[own].take(model), pa.array(n[judge.to_numpy()]), pa.array(right.ravel().astype(np.int64)), pa.array(unknown.ravel().astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["judge_id", "model_id", "n", "right", "unknown"])

    return pairs


def _sums(items: int, dims: int):
    """Of each judge and cluster, over a cell's models but the judge's own: how many are known, their hits and squares of hits."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names, models, tiles = _cell(batch.column("judges")[r].values, batch.column("models")[r].values, items, dims)
                coded = models.field("cluster").dictionary_encode("encode")
                cluster, held = coded.indices.to_numpy(), {}
                own_model = pa.compute.index_in(names, models.field("id"), skip_nulls=True).fill_null(-1).to_numpy()
                named, own_named = (~x.is_null().to_numpy(zero_copy_only=False) for x in (names, models.field("id")))  # nobody's are neither own nor others'

                def told(c, at, n, sums, own):
                    keys = [names[at], coded.dictionary.take(pa.array(np.full(len(n), c)))]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*keys, pa.array(n), *[pa.array(x) for x in sums], own], names=["judge_id", "cluster", "n", "models", "total", "squares", "own"])

                for at, part, n, right, unknown in tiles:
                    here = cluster[part]
                    seen = np.unique(here)
                    valid = (unknown == 0) & named[at, None] & own_named[part]
                    kind = np.float64 if n.max(initial=0) <= 1 << 20 else np.int64  # whole numbers below 2 ** 53 either way
                    mine = own_model[at] - part.start
                    rows = np.flatnonzero((mine >= 0) & (mine < len(here)))
                    hits, fine = right[rows, mine[rows]].astype(np.int64), valid[rows, mine[rows]]
                    valid[rows, mine[rows]] = False
                    x, v = right.astype(kind), valid.astype(kind)
                    x *= v
                    of = (here[:, None] == seen).astype(kind)
                    each = [(y @ of).astype(np.int64) for y in (v, x, x * x)]
                    for at_c, c in enumerate(seen):
                        own = np.full(len(n), -1)
                        mask = fine & (here[mine[rows]] == c)
                        own[rows[mask]] = hits[mask]
                        now = (*(y[:, at_c] for y in each), own)
                        if len(seen) == 1:  # models stand by cluster: its sums go on
                            was = held.get((c, at.start))
                            held[c, at.start] = (at, n, now) if was is None else (at, n, (*(p + q for p, q in zip(was[2][:3], now[:3], strict=True)), np.maximum(was[2][3], own)))
                        else:
                            yield told(c, at, n, now[:3], pa.array(own, mask=own < 0))
                    for key in [key for key in held if key[0] != here[-1]]:
                        at_, n_, now = held.pop(key)
                        yield told(key[0], at_, n_, now[:3], pa.array(now[3], mask=now[3] < 0))
                for (c, _), (at, n, now) in held.items():
                    yield told(c, at, n, now[:3], pa.array(now[3], mask=now[3] < 0))

    return sums


class Study:
    """Different trials of one sampleSet by judge, coded and stored, and the models that meet them.

    Raises if a model has more than PACKED coordinates, as such models don't fit in rows, or if models differ in their dimensions.
    """

    def __init__(self, embeddings: DataFrame, trials: DataFrame, trialtype: str, dims: int | None):
        ship(trials.sparkSession)
        used = require(trials, "worker_id", "sampleSet", "Center", "Left", "Right", "Answer").where(F.col("sampleSet") == trialtype)
        self.embeddings, self.codes = embeddings, held(item_codes(embeddings))  # read five times; one row an item
        self.items, sizes = self.codes.count(), embeddings.agg(F.count_distinct("worker_id").alias("models"), F.min(F.size("coords")).alias("least"), F.max(F.size("coords")).alias("most")).first()
        self.dims, self.models = dims or sizes.most or 1, sizes.models
        if self.items * self.dims > PACKED or sizes.least != sizes.most or sizes.most not in (None, self.dims):
            raise ValueError(f"models of more than {PACKED} coordinates, or of different dimensions")
        coded = used.select(F.col("worker_id").alias("judge_id"), "Center", "Left", "Right", "Answer")
        for side in ("Center", "Left", "Right"):
            coded = coded.join(self.codes.select(F.col("item").alias(side), F.col("code").cast("int").alias(f"{side}_")), side, "left")
        right = F.when(F.col("Answer").isNull(), -1).otherwise((F.col("Answer") == F.col("Left")).cast("int") + 2 * (F.col("Answer") == F.col("Right")).cast("int"))
        at = lambda side, out: F.coalesce(F.col(f"{side}_"), F.lit(-1)).alias(out)
        named = coded.select("judge_id", at("Center", "c"), at("Left", "a"), at("Right", "b"), F.coalesce(right, F.lit(-1)).alias("answer"))
        self.once = materialize(named.groupBy("judge_id", "c", "a", "b", "answer").agg(F.count("*").alias("k")), "different_trials")
        self.total, self.most = self.once.groupBy("judge_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()

    def cells(self, once: DataFrame, clusters: DataFrame | None = None, whole: bool = False) -> DataFrame:
        """(judges, models): each tile of trials meets each tile of models in a cell of its own, to which both are sent.

        Where a judge has more than TILE_TRIALS different trials, judges are dealt to several tiles unless they are to stay whole.
        """
        tasks = 2 * once.sparkSession.sparkContext.defaultParallelism
        groups = max(1, -(-self.models // max(1, min(TILE_MODELS, TILE_BYTES // (8 * self.dims * max(1, self.items))))))
        parts = max(1, -(-self.total // TILE_TRIALS), min(self.total // 1024, -(-tasks // groups)))
        chunk = F.when(F.lit(self.most > TILE_TRIALS and not whole), F.pmod(F.xxhash64("c", "a", "b"), F.lit(-(-self.most // TILE_TRIALS)))).otherwise(F.lit(0))  # spreads a judge with very many
        tile = F.pmod(F.xxhash64("judge_id", "chunk"), F.lit(parts)).cast("int").alias("t")
        judge = F.struct("judge_id", *[F.col(f"x.{c}").alias(c) for c in ("c", "a", "b", "answer", "k")]).alias("judge")
        judges = once.withColumn("chunk", chunk).groupBy("judge_id", "chunk").agg(F.collect_list(F.struct("c", "a", "b", "answer", "k")).alias("x")).select(tile, judge).groupBy("t").agg(F.collect_list("judge").alias("judges"))
        points = self.embeddings.join(self.codes, "item").groupBy("worker_id").agg(F.collect_list(F.struct("code", "coords")).alias("p"))
        points = points.join(clusters, "worker_id") if clusters is not None else points.withColumn("cluster", F.lit(None).cast("int"))
        model = F.struct(F.col("worker_id").alias("id"), "cluster", F.col("p.code").alias("codes"), F.flatten("p.coords").alias("coords"))
        tiles = points.select(F.pmod(F.xxhash64("worker_id"), F.lit(groups)).cast("int").alias("m"), model.alias("model")).groupBy("m").agg(F.collect_list("model").alias("models"))
        # numbers of their own: the few tiles would else be coalesced into one task. Neither side is small, whatever its estimate says
        sent = lambda df, to, many: df.withColumn(to, F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).repartition(max(2 * tasks, parts * groups // 2), "t", "m")
        return sent(judges, "m", groups).hint("merge").join(sent(tiles, "t", parts), ["t", "m"]).select("judges", "models")

    def pairs(self, once: DataFrame) -> DataFrame:
        """(judge_id, model_id, n, right, unknown): whole numbers, so a judge who is dealt to several tiles has their sum."""
        found = self.cells(once).mapInArrow(_pairs(self.items, self.dims), CELL)
        return found if self.most <= TILE_TRIALS else found.groupBy("judge_id", "model_id").agg(*[F.sum(c).alias(c) for c in ("n", "right", "unknown")])


def prediction_matrix(embeddings: DataFrame, trials: DataFrame, trialtype: str = "test", dims: int | None = None) -> DataFrame:
    """(judge_id, model_id, acc, n): accuracy of every model on every judge's trials of one sampleSet.

    Every model meets every judge, which the result asks for; prediction_moments gives what a judge's row comes to without it.
    """
    study = Study(embeddings, trials, trialtype, dims)
    return study.pairs(study.once).select("judge_id", "model_id", F.when(F.col("unknown") == 0, F.col("right") / F.col("n")).alias("acc"), "n")


def prediction_moments(embeddings: DataFrame, trials: DataFrame, clusters: DataFrame | None = None, trialtype: str = "test", dims: int | None = None) -> DataFrame:
    """(judge_id, cluster, n, models, total, squares, own): sums over each row of the prediction matrix, by cluster of the models.

    models is the number of known accuracies of others' models, total and squares are the sums of their hits out of n and of the hits'
    squares, own the hits of the judge's own model, null if unknown or elsewhere. clusters: one row a worker; models without one are left
    out, and without clusters there is one, null. Whole numbers throughout. No row of the matrix is made but for judges with more than
    TILE_TRIALS different trials, who are as few as their trials allow.
    """
    study = Study(embeddings, trials, trialtype, dims)
    once, own = study.once, None if clusters is None else clusters.select("worker_id", F.col("cluster").cast("int").alias("cluster"))
    keys, parts = ["judge_id", "cluster"], []
    if study.most > TILE_TRIALS:
        many = held(once.groupBy("judge_id").agg(F.count("*").alias("_n")).where(F.col("_n") > TILE_TRIALS).select("judge_id"))
        pairs = study.pairs(once.join(many, "judge_id", "left_semi"))
        pairs = pairs.join(own.withColumnRenamed("worker_id", "model_id"), "model_id") if own is not None else pairs.withColumn("cluster", F.lit(None).cast("int"))
        known = (F.col("unknown") == 0) & (F.col("judge_id") != F.col("model_id"))
        parts.append(pairs.groupBy(*keys).agg(F.max("n").alias("n"), F.count_if(known).alias("models"), *[F.coalesce(F.sum(F.when(known, x)), F.lit(0)).alias(c) for c, x in (("total", F.col("right")), ("squares", F.col("right") * F.col("right")))],
                                              F.max(F.when((F.col("unknown") == 0) & (F.col("judge_id") == F.col("model_id")), F.col("right"))).alias("own")).select(*(c.split()[0] for c in MOMENTS.split(", "))))
        once = once.join(many, "judge_id", "left_anti")
    parts.append(study.cells(once, own, whole=True).mapInArrow(_sums(study.items, study.dims), MOMENTS))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in ("models", "total", "squares")], F.max("own").alias("own"))


def prediction_matrix_wide(pred: DataFrame) -> DataFrame:
    """Rows by judge, a column for each model."""
    return pred.groupBy("judge_id").pivot("model_id").agg(F.first("acc"))
