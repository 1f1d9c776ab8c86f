"""Nearest neighbours by pivots, Procrustes distances by ranges of items, and principal axes by moments, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivium.operators import geometry

POINTS = "item string, coords array<double>"
EMBEDDINGS = "worker_ix long, worker_id string, item_ix long, item string, coords array<double>"


def brute(points, k):
    out = []
    for a, x in points:
        ranked = sorted((float(np.sqrt(((np.array(y) - np.array(x)) ** 2).sum())), b) for b, y in points)
        out += [(a, b, d, r) for r, (d, b) in enumerate(ranked[: k + 1]) if r]
    return sorted(out)


def found(df):
    return sorted((r.item_a, r.item_b, r.dist, r.rank) for r in df.collect())


@pytest.mark.parametrize(("n", "k", "block", "pivots", "queries"), [(120, 5, 16, 8, 10), (120, 5, 1024, 1024, 4096), (90, 3, 4, 64, 7), (7, 10, 2, 3, 2), (1, 2, 4, 4, 4), (40, 0, 8, 8, 8)])
def test_nearest_with_ties(spark, n, k, block, pivots, queries):
    rnd = random.Random(n + k)
    points = [(f"i{j:03d}", [float(rnd.randint(0, 3)) for _ in range(3)]) for j in range(n)]  # many ties and equal points
    got = geometry.nearest_k_blocks(spark.createDataFrame(points, POINTS).repartition(3), k, block, pivots, queries)
    assert found(got) == brute(points, k)


def test_nearest_of_nothing(spark):
    assert geometry.nearest_k_blocks(spark.createDataFrame([], POINTS), 3).count() == 0


def test_clusters_leave_most_blocks_unvisited(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 100, (20, 16))
    points = [(f"i{j:04d}", (centres[j % 20] + rnd.normal(0, 1, 16)).tolist()) for j in range(1000)]
    e = spark.createDataFrame(points, POINTS)
    blocks, index = geometry.nearest_index(e, 16, 64)
    visits = geometry.nearest_visits(blocks, index, 5)
    total = visits.select(F.sum(F.aggregate(F.transform("visits", lambda v: F.get(F.array(*[F.lit(int(x)) for x in index.parts]), v)), F.lit(0), lambda a, x: a + x))).first()[0]
    assert total < 0.15 * 1000 * blocks.count()
    got = geometry.nearest_k_blocks(e, 5, 16, 64)
    assert [(a, b, r) for a, b, _, r in found(got)] == [(a, b, r) for a, b, _, r in brute(points, 5)]
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def study(workers=5, items=40, dims=3, seed=2):
    rnd = np.random.default_rng(seed)
    return [(w, f"w{w}", i, f"i{i:02d}", rnd.normal(w, 1 + w, dims).tolist()) for w in range(workers) for i in range(items)]


@pytest.mark.parametrize(("dims", "items", "workers"), [(3, 7, 2), (2, 1024, 32), (1, 5, 1)])
@pytest.mark.parametrize("rootflag", [True, False])
def test_procrustes_by_ranges_equals_packed(spark, dims, items, workers, rootflag):
    e = spark.createDataFrame(study(dims=dims), EMBEDDINGS)
    key = lambda df: {(r.worker_a, r.worker_b): r.dist for r in df.collect()}
    a, b = key(geometry.rep_dist_ranges(e, rootflag, items=items, workers=workers)), key(geometry.rep_dist(e, rootflag))
    assert a.keys() == b.keys() and len(a) == 25 and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    with pytest.raises(ValueError, match="same items"):
        geometry.rep_dist_ranges(e.where("not (worker_id = 'w1' and item_ix = 3)"))


def test_axes_by_moments_of_groups_over_many_tasks(spark):
    rnd = np.random.default_rng(8)
    mean = [(c, i, f"i{i}", (rnd.normal(0, [5, 1, 3, 0.5], 4)).tolist()) for c, n in ((1, 500), (2, 30), (3, 2)) for i in range(n)]
    df = spark.createDataFrame(mean, "cluster int, item_ix long, item string, coords array<double>").repartition(9)
    assert df.rdd.getNumPartitions() == 9
    got = {(r.cluster, r.item_ix): r.coords for r in geometry.rotated(df, 4).collect()}
    for c in (1, 2, 3):
        u, d, _ = np.linalg.svd(np.array([x[3] for x in mean if x[0] == c]), full_matrices=False)
        want = u * d
        want = want * np.where(want[np.abs(want).round(12).argmax(0), np.arange(want.shape[1])] < 0, -1, 1)
        own = [got[(c, i)] for i in range(len(want))]
        assert np.allclose(own, want, atol=1e-9)
    assert "FlatMapGroupsInPandas" not in geometry.rotated(df, 4)._jdf.queryExecution().executedPlan().toString()


def test_items_are_sent_once_a_cell_of_groups(spark, monkeypatch):
    """Without clusters every item visits every block; it is sent for each group of blocks only."""
    e = spark.range(512).select(F.concat(F.lit("i"), "id").alias("item"), F.transform(F.sequence(F.lit(1), F.lit(24)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(1000)).cast("double")).alias("coords"))
    sent = []
    monkeypatch.setattr(type(e), "repartition", lambda self, *a, _f=type(e).repartition: (sent.append(self.count()) if "j" in a else None) or _f(self, *a))
    got = geometry.nearest_k_blocks(e, 3, 16, 64, 256)
    assert got.count() == 3 * 512 and sent[0] <= 512 * 4
