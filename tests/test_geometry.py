import math

import numpy as np
import pytest

from tests import plain_cluster
from trivium.functions import stats
from trivium.operators import cluster, geometry, layout
from trivium.plans.catalog import QUERIES

SCHEMA = "worker_ix long, worker_id string, item_ix long, item string, coords array<double>"


def frame(spark, *matrices):
    rows = [(w, f"w{w}", i, f"i{i:02d}", [float(v) for v in x]) for w, m in enumerate(matrices) for i, x in enumerate(m)]
    return spark.createDataFrame(rows, SCHEMA)


def coords(d, worker, key="worker_id"):
    return np.array([r.coords for r in d.where(f"{key} = '{worker}'").orderBy("item_ix").collect()])


def procrustes(x, y, scale=True):
    norm = lambda m: (m - m.mean(0)) / np.linalg.norm(m - m.mean(0))
    x, y = norm(np.array(x, float)), norm(np.array(y, float))
    u, s, vt = np.linalg.svd(x.T @ y)
    return y @ (u @ vt).T * (s.sum() if scale else 1), s.sum()


def test_rep_dist_golden(spark):
    s1 = [(i, i) for i in range(1, 6)]
    s2 = [(1.1 * i + 0.1, 1.1 * i + 0.1) for i in range(1, 6)]
    s3 = [(1, 2), (3, 4), (4, 3), (2, 1), (5, 2)]
    got = {(r.worker_a, r.worker_b): r.dist for r in geometry.rep_dist(frame(spark, s1, s2, s3)).collect()}
    assert got[("w0", "w1")] == pytest.approx(0, abs=1e-12) and got[("w0", "w2")] == pytest.approx(0.382279, abs=1e-6)
    assert len(got) == 9 and got[("w1", "w1")] == 0 and got[("w2", "w0")] == got[("w0", "w2")]
    ss = {(r.worker_a, r.worker_b): r.dist for r in geometry.rep_dist(frame(spark, s1, s2, s3), rootflag=False).collect()}
    assert ss[("w0", "w2")] == pytest.approx(1 - (1 - 0.382279) ** 2, abs=1e-5)
    assert [r.dist for r in geometry.rep_dist(frame(spark, s1)).collect()] == [0.0]


@pytest.mark.parametrize("dims", [1, 2, 3, 5])
def test_procrustes_against_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    ms = [rng.normal(size=(8, dims)) for _ in range(4)]
    ms[3] = -2 * ms[0] + 4
    e = frame(spark, *ms)
    dist = {(r.worker_a, r.worker_b): r.dist for r in geometry.rep_dist(e).collect()}
    for scale in (True, False):
        made = geometry.align_embeddings(e, scale)
        for w, m in enumerate(ms):
            y, t = procrustes(ms[0], m, scale)
            assert coords(made, f"w{w}") == pytest.approx(y, abs=1e-9)
            if w:
                assert dist[("w0", f"w{w}")] == pytest.approx(1 - t, abs=1e-9)
    assert coords(geometry.align_embeddings(e, base="w1"), "w2") == pytest.approx(procrustes(ms[1], ms[2])[0], abs=1e-9)


def test_align_golden(spark):
    s1 = np.random.default_rng(0).random((10, 2))
    s2 = 2 * s1 + 4
    s2[:, 0] *= -1
    made = geometry.align_embeddings(frame(spark, s1, s2))
    assert coords(made, "w0").round(2).tolist() == coords(made, "w1").round(2).tolist()


def test_other_items_raise(spark):
    with pytest.raises(ValueError):
        geometry.rep_dist(frame(spark, [(1, 2), (3, 4)], [(1, 2), (3, 4), (5, 6)]))
    with pytest.raises(ValueError):
        geometry.align_embeddings(frame(spark, [(1, 2), (3, 4)]), base="none")


def test_group_means(spark):
    rng = np.random.default_rng(4)
    ms = [rng.normal(size=(7, 2)) for _ in range(5)]
    groups = [1, 2, 1, 2, 1]
    cl = spark.createDataFrame([(f"w{i}", g) for i, g in enumerate(groups)], "worker_id string, cluster int")
    got = geometry.group_list_mean(frame(spark, *ms), cl)
    for g in (1, 2):
        own = [m for m, x in zip(ms, groups, strict=True) if x == g]
        mean = np.mean([procrustes(own[0], m)[0] for m in own], axis=0)
        u, s, _ = np.linalg.svd(mean, full_matrices=False)
        y = coords(got, f"group-{g}", "group")
        assert np.abs(y) == pytest.approx(np.abs(u * s), abs=1e-9)
        assert all(y[np.argmax(np.abs(y[:, k])), k] > 0 for k in range(2))


def test_nearest(spark):
    d = geometry.pairwise_dist(frame(spark, [(0, 0), (1, 0), (0, 2), (0, 0)])).drop("worker_id")
    near = geometry.nearest_to(d, "i00", 2).orderBy("rank").collect()
    assert [(r.item_b, r.dist) for r in near] == [("i03", 0.0), ("i01", 1.0)]
    assert [r.item_b for r in geometry.nearest_to(d, "i03", 2).orderBy("rank").collect()] == ["i03", "i01"]
    assert geometry.nearest_to(d, "i01", 50).count() == 3
    with pytest.raises(ValueError):
        geometry.nearest_to(d, "zz")


TREE = np.array([1, 0.5, 1, 0, 0, 0, 0.1, 1, 1, 0, 0, 0, 1, 1, 0.8, 0, 0, 0, 0, 0, 0, 1.1, 1, 1, 0, 0, 0, 1, 0.5, 1, 0, 0, 0, 1, 1, 0.2]).reshape(6, 6).T


def test_tips_golden(spark):
    d = np.linalg.norm(TREE[:, None] - TREE[None], axis=2)
    rows = [(f"{i + 1}", f"{j + 1}", float(d[i, j])) for i in range(6) for j in range(6)]
    tips = cluster.tip_coords(spark.createDataFrame(rows, "item_a string, item_b string, dist double")).collect()
    assert [r.item for r in sorted(tips, key=lambda r: r.y)] == ["6", "4", "5", "1", "2", "3"]
    assert next(r.y for r in tips if r.item == "1") == 4


def slow_merges(d, method):
    """By definition: the sum rule of Lance and Williams, on a dictionary of groups."""
    groups = {(i,): i for i in range(len(d))}
    dist = {(a, b): d[a[0], b[0]] for a in groups for b in groups if a < b}
    heights = []
    while len(groups) > 1:
        (a, b), h = min(dist.items(), key=lambda x: x[1])
        heights.append(h)
        new = tuple(sorted(a + b))
        get = lambda x, y, dist=dist: dist[min(x, y), max(x, y)]
        for c in groups:
            if c not in (a, b):
                na, nb, nc = len(a), len(b), len(c)
                v = max(get(a, c), get(b, c)) if method == "complete" else ((na + nc) * get(a, c) + (nb + nc) * get(b, c) - nc * h) / (na + nb + nc)
                dist[min(new, c), max(new, c)] = v
        dist = {k: v for k, v in dist.items() if a not in k and b not in k}
        groups = {g: 0 for g in groups if g not in (a, b)} | {new: 0}
        yield set(groups), h


@pytest.mark.parametrize("method", ["ward.D", "complete"])
def test_clustering_by_definition(method):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(14, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    steps = plain_cluster.merges(d, method)
    for n, (groups, h) in enumerate(slow_merges(d, method), 1):
        assert steps[n - 1][2] == pytest.approx(h)
        labels = plain_cluster.cut(steps, 14 - n)
        assert {tuple(i for i in range(14) if labels[i] == g) for g in set(labels)} == groups
        assert [labels.index(g) for g in sorted(set(labels))] == sorted(labels.index(g) for g in set(labels))
    with pytest.raises(ValueError):
        plain_cluster.cut(steps, 15)


def test_cut_of_rep_dist(spark):
    rows = [("a", "b", 0.1), ("a", "c", 0.9), ("b", "c", 0.8), ("c", "d", 0.05), ("a", "d", 0.9), ("b", "d", 0.8)]
    both = rows + [(b, a, d) for a, b, d in rows]
    d = spark.createDataFrame(both, "worker_a string, worker_b string, dist double")
    assert {r.worker_id: r.cluster for r in cluster.hclust_cut(d, 2).collect()} == {"a": 1, "b": 1, "c": 2, "d": 2}
    assert cluster.hclust(d).count() == 3


def test_t_quantiles():
    for df, q in ((1, 12.706204736), (2, 4.30265273), (5, 2.570581836), (30, 2.042272456), (149, 1.976013178), (1000, 1.962339081)):
        assert stats.t_quantile(0.975, df) == pytest.approx(q, rel=1e-8)
    assert stats.t_quantile(0.025, 5) == pytest.approx(-2.570581836)


def test_column_cis(spark):
    d = spark.createDataFrame([(float(i), float(i + 4), 7.0) for i in range(1, 5)], "a double, b double, c double")
    got = {r.column: r for r in stats.column_cis(d, ["a", "b", "c"]).collect()}
    assert got["a"].mean == 2.5 and got["b"].mean == 6.5 and (got["c"].lower_ci, got["c"].upper_ci) == (7, 7)
    assert got["a"].upper_ci - 2.5 == pytest.approx(3.182446305 * math.sqrt(5 / 3) / 2)
    with pytest.raises(ValueError):
        stats.column_cis(d.limit(1), ["a"])
    with pytest.raises(ValueError):
        stats.column_cis(d.selectExpr("nullif(a, 1) as a"), ["a"])


def test_lines_histograms_and_ranges(spark):
    d = spark.createDataFrame([(float(x), 2.0 * x + 1, None if x == 3 else 1.0) for x in range(11)], "x double, y double, z double")
    r = stats.fit_line(d, "x", "y").first()
    assert (r.r, r.slope, r.intercept) == pytest.approx((1, 2, 1))
    assert {b.bin: b.n for b in stats.histogram(d, "x", 0, 10).collect()} == {k: 1 + (k == 10) for k in range(1, 11)}
    assert stats.fit_line(d, "x", "z").first().n == 10
    assert tuple(stats.range_of(d, "x").first()) == (0, 10) and stats.column_means(d, ["x", "z"]).first().x == 5


def test_layout(spark):
    p = spark.createDataFrame([(i, f"i{i}", [float(i), 10.0 * i]) for i in range(11)], "item_ix long, item string, coords array<double>")
    box = {r.item: r for r in layout.plot_layout(p, pc="red").collect()}
    assert (box["i2"].x0, box["i2"].x1, box["i2"].y0, box["i2"].y1) == pytest.approx((1.5, 2.5, 15, 25)) and box["i2"].color == "red"
    assert {r.item for r in layout.plot_layout(p, pr=[1, 3]).collect()} == {"i0", "i2"}
    assert layout.plot_layout(p, xlim=(0, 100)).where("item = 'i0'").first().x1 == 5
    assert layout.plot_layout(p, pc=[f"c{k}" for k in range(11)]).where("item = 'i4'").first().color == "c4"
    with pytest.raises(ValueError):
        layout.plot_layout(p, pc=["a", "b"])
    with pytest.raises(ValueError):
        layout.plot_layout(p, pictures=spark.createDataFrame([("x",)], "name string"))


def test_rep_dist_sends_packs_of_tiles_and_broadcasts_none(spark, monkeypatch):
    """Tiles of two packs meet in one cell; the result doesn't depend on how many tiles are sent together."""
    rows = [(w, f"w{w}", i, f"i{i}", [float((w * 7 + i * i) % 11), float((w * 3 + i * 5) % 13)]) for w in range(20) for i in range(5)]
    e = spark.createDataFrame(rows, "worker_ix long, worker_id string, item_ix long, item string, coords array<double>")
    one = sorted(map(tuple, geometry.rep_dist(e, dims=2, tile=1).collect()))
    monkeypatch.setattr(geometry, "SIDE", 1)
    made = geometry.rep_dist(e, dims=2, tile=1)
    assert "SortMergeJoin [i#" in made._jdf.queryExecution().executedPlan().toString()
    assert len(one) == 400 and one == sorted(map(tuple, made.collect()))


def test_rep_dist_compares_copies_once_and_gives_all_pairs(spark, monkeypatch):
    """Of 41 participants 6 have different embeddings; one can't be scaled, one has an unknown coordinate, and a row holds four at most."""
    rng, rows = np.random.default_rng(3), []
    shapes = [rng.normal(size=(5, 2)) for _ in range(4)]
    flat, unknown = np.ones((5, 2)), np.where(np.arange(10).reshape(5, 2) == 3, np.nan, shapes[0])
    own = {f"w{w:02}": shapes[0 if w < 20 else w % 4] for w in range(37)} | {"x1": flat, "x2": unknown, "x3": flat, "x4": shapes[3]}
    for w, (name, x) in enumerate(own.items()):
        rows += [(w, name, i, f"i{i}", [float(v) for v in x[i]]) for i in range(5)]
    e = spark.createDataFrame(rows, "worker_ix long, worker_id string, item_ix long, item string, coords array<double>")
    sent, tiles = [], geometry._tiles
    monkeypatch.setattr(geometry, "COPIES", 4)
    monkeypatch.setattr(geometry, "_tiles", lambda p, *x: sent.append(p.count()) or tiles(p, *x))

    def trace(a, b):
        a, b = ((x - x.mean(0)) / np.linalg.norm(x - x.mean(0)) for x in (a, b))
        return np.linalg.svd(a.T @ b, compute_uv=False).sum()

    for root in (True, False):
        for tile in (256, 2):
            found = geometry.rep_dist(e, rootflag=root, dims=2, tile=tile, digits=6).collect()
            got = {(r.worker_a, r.worker_b): r.dist for r in found}
            assert len(found) == len(got) == 41 * 41
            for (a, b), d in got.items():
                odd = a != b and {a, b} & {"x1", "x2", "x3"}
                want = np.nan if odd else 0.0 if a == b else 1 - trace(own[a], own[b]) ** (1 if root else 2)
                assert (d != d) if odd else d == pytest.approx(want, abs=1e-6) and str(d) != "-0.0"
    assert max(sent) < 30  # four shapes in rows of about four, and three alone


def test_rep_dist_rounds_where_all_differ(spark):
    rng = np.random.default_rng(4)
    rows = [(w, f"w{w}", i, f"i{i}", rng.normal(size=2).tolist()) for w in range(9) for i in range(5)]
    e = spark.createDataFrame(rows, "worker_ix long, worker_id string, item_ix long, item string, coords array<double>")
    whole = {(r.worker_a, r.worker_b): r.dist for r in geometry.rep_dist(e, dims=2).collect()}
    short = {(r.worker_a, r.worker_b): r.dist for r in geometry.rep_dist(e, dims=2, digits=3).collect()}
    assert len(whole) == 81 and short == {k: pytest.approx(round(d, 3), abs=1e-12) for k, d in whole.items()}


@pytest.mark.parametrize("query", ["rep_dist", "rep_dist_ss"])
def test_queries_send_different_embeddings_only_and_give_all_pairs(spark, tmp_path, monkeypatch, query):
    """Participants 4032 apart have the same embedding in the fixtures."""
    users = [0, 1, 2, 70, 4032, 4033, 8064]
    spark.createDataFrame([(k, u, "view", 1.0) for k, u in enumerate(users)], "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    vectors = [(v, [float((v * v * (k + 3) + 7 * k * v) % 101) for k in range(64)]) for v in range(36)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    sent, tiles = [], geometry._tiles
    monkeypatch.setattr(geometry, "_tiles", lambda p, *x: sent.append(p.count()) or tiles(p, *x))
    rows = QUERIES[query](spark, str(tmp_path)).collect()
    got = {(int(r.worker_a), int(r.worker_b)): r.dist for r in rows}
    assert sent == [4] and len(rows) == len(got) == 49
    assert all((d == 0) == (a % 4032 == b % 4032) and d == got[b, a] == got[a % 4032, b % 4032] for (a, b), d in got.items())
