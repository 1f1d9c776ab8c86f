import pytest
from pyspark.sql import functions as F

from trivium.operators import agreement, compare, predict

TRIALS = "worker_id string, trial_ix long, Center string, Left string, Right string, Answer string, sampleSet string, sampleAlg string"
ITEMS = [("cat", [1.0, 1.25]), ("dog", [1.1, 1.75]), ("car", [2.0, 1.25]), ("boat", [2.1, 1.75])]


@pytest.fixture(scope="module")
def model(spark):
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(ITEMS)], "item_ix long, item string, coords array<double>")


def trials(spark, rows, worker="w", alg="random"):
    return spark.createDataFrame([(worker, k, *r, "test", alg) for k, r in enumerate(rows)], TRIALS)


def test_model_golden(spark, model):
    d = trials(spark, [("cat", "dog", "car", None), ("car", "boat", "dog", None)])
    assert [r.ModPred for r in predict.test_model(d, model).orderBy("trial_ix").collect()] == ["dog", "boat"]


def test_hoacc_golden(spark, model):
    d = trials(spark, [("cat", "dog", "car", "dog"), ("car", "boat", "dog", "boat"), ("dog", "car", "boat", "car"), ("boat", "cat", "car", "car")])
    got = predict.hoacc(d, model).first()
    assert (got.acc, got.n) == (0.75, 4)
    assert predict.hoacc(d, model, "train").first().acc is None
    unknown = d.unionByName(trials(spark, [("cat", "dog", "car", None)]))
    assert predict.hoacc(unknown, model).first().acc is None


def test_ties_go_right_and_missing_items_are_null(spark, model):
    square = spark.createDataFrame([(0, "a", [0.0, 0.0]), (1, "b", [1.0, 0.0]), (2, "c", [0.0, 1.0])], "item_ix long, item string, coords array<double>")
    d = trials(spark, [("a", "b", "c", "b"), ("a", "c", "b", "b"), ("a", "b", "zzz", "b")])
    assert [r.ModPred for r in predict.test_model(d, square).orderBy("trial_ix").collect()] == ["c", "b", None]
    assert [r.item for r in predict.missing_items(d, square).collect()] == ["zzz"]
    same = [r.strength for r in predict.model_strength(d, square).orderBy("trial_ix").collect()]
    assert same[:2] == [0.5, 0.5] and same[2] is None


def test_distances_give_the_same(spark, model):
    from trivium.operators.geometry import pairwise_dist

    d = trials(spark, [("cat", "dog", "car", "dog"), ("boat", "cat", "car", "car"), ("dog", "dog", "cat", "dog")])
    table = pairwise_dist(model.withColumn("worker_id", F.lit("w"))).drop("worker_id")
    a = predict.test_model(d, model).orderBy("trial_ix").collect()
    assert a == predict.test_model(d, table, distances=True).select(*a[0].__fields__).orderBy("trial_ix").collect()
    s = [r.strength for r in predict.model_strength(d, table, distances=True).orderBy("trial_ix").collect()]
    assert s == pytest.approx([r.strength for r in predict.model_strength(d, model).orderBy("trial_ix").collect()])
    assert all(0.5 <= x <= 1 for x in s)


def test_strength_without_distance_is_null(spark):
    flat = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0]), (2, "c", [1.0])], "item_ix long, item string, coords array<double>")
    assert predict.model_strength(trials(spark, [("a", "b", "c", "b")]), flat).first().strength is None


def test_prediction_matrix_is_hoacc_of_each_pair(spark):
    import random

    r = random.Random(1)
    emb = [(w, f"w{w}", i, f"i{i}", [r.gauss(0, 1), r.gauss(0, 1)]) for w in range(3) for i in range(6)]
    e = spark.createDataFrame(emb, "worker_ix long, worker_id string, item_ix long, item string, coords array<double>")
    rows = []
    for w in range(3):
        for k in range(15):
            c, a, b = r.sample(range(6), 3)
            rows.append((f"w{w}", k, f"i{c}", f"i{a}", f"i{b}", f"i{r.choice((a, b))}", ("test", "train")[k % 5 == 0], "random"))
    t = spark.createDataFrame(rows, TRIALS)
    got = {(x.judge_id, x.model_id): (x.acc, x.n) for x in predict.prediction_matrix(e, t).collect()}
    for w in range(3):
        one = predict.hoacc(t, e.where(f"worker_id = 'w{w}'"), by=()).first()
        assert sum(got[(f"w{j}", f"w{w}")][0] * got[(f"w{j}", f"w{w}")][1] for j in range(3)) / 36 == pytest.approx(one.acc)
    holes = predict.prediction_matrix(e.where("not (worker_id = 'w1' and item = 'i3')"), t).where("model_id = 'w1'").collect()
    assert any(x.acc is None for x in holes)
    wide = predict.prediction_matrix_wide(predict.prediction_matrix(e, t)).orderBy("judge_id").first()
    assert wide["w1"] == got[("w0", "w1")][0]


def random_study(seed, workers=5, items=7, trials_each=60, dims=3):
    """(embeddings, trials) with missing items, unknown and foreign answers, repeated trials, equal options and one participant with most trials."""
    import random

    r = random.Random(seed)
    emb = [(w, f"w{w}", i, f"i{i}", [float(r.randint(0, 3)) for _ in range(dims)]) for w in range(workers) for i in range(items) if not (w == 1 and i == 2)]
    rows = []
    for w in range(workers + 1):
        for k in range(trials_each * (8 if w == 0 else 1)):
            c, a, b = (f"i{r.randint(0, items)}" for _ in range(3))
            rows.append((f"w{w}" if w < workers else None, k, c, a, b, r.choice([a, a, b, b, "other", None] if w != 3 else [a, b]), "test", "random"))
    return emb, rows


EMBEDDINGS = "worker_ix long, worker_id string, item_ix long, item string, coords array<double>"


def by_hand(emb, rows):
    """{(judge, model): (right, n, unknown)} by definition."""
    points, out = {(e[1], e[3]): e[4] for e in emb}, {}
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q, strict=True))
    for judge, _, c, a, b, answer, *_ in rows:
        for model in {e[1] for e in emb}:
            p = [points.get((model, x)) for x in (c, a, b)]
            cell = out.setdefault((judge, model), [0, 0, 0])
            cell[1] += 1
            if None in p or answer is None:
                cell[2] += 1
            else:
                cell[0] += answer == (a if far(p[0], p[1]) < far(p[0], p[2]) else b)
    return out


@pytest.mark.parametrize("tile", [(4096, 1 << 22), (16, 400)])
def test_prediction_matrix_by_hand(spark, monkeypatch, tile):
    monkeypatch.setattr(predict, "TILE_TRIALS", tile[0]), monkeypatch.setattr(predict, "TILE_BYTES", tile[1])
    emb, rows = random_study(4)
    for clean in (False, True):  # without what makes a cell unknown
        used = [x for x in rows if not clean or (x[5] is not None and not {"i2", "i7"} & {*x[2:5]})]
        got = {(x.judge_id, x.model_id): (x.acc, x.n) for x in predict.prediction_matrix(spark.createDataFrame(emb, EMBEDDINGS), spark.createDataFrame(used, TRIALS)).collect()}
        want = {k: (None if u else right / n, n) for k, (right, n, u) in by_hand(emb, used).items()}
        assert got == want and len(got) == 30 and (not clean or all(a is not None for a, _ in got.values()))
    with pytest.raises(ValueError, match="dimensions"):
        predict.prediction_matrix(spark.createDataFrame([*emb, (9, "w9", 0, "i0", [1.0])], EMBEDDINGS), spark.createDataFrame(rows, TRIALS))
    assert predict.prediction_matrix(spark.createDataFrame(emb, EMBEDDINGS), spark.createDataFrame([], TRIALS)).count() == 0
    assert predict.prediction_matrix(spark.createDataFrame([], EMBEDDINGS), spark.createDataFrame(rows, TRIALS)).count() == 0


@pytest.mark.parametrize("distances", [False, True])
def test_packed_lookup_equals_joins_and_moves_trials_once(spark, monkeypatch, distances):
    from trivium.operators.geometry import pairwise_dist

    emb, rows = random_study(6)
    e, t = spark.createDataFrame(emb, EMBEDDINGS), spark.createDataFrame(rows, TRIALS).withColumn("row", F.monotonically_increasing_id())
    model = pairwise_dist(e) if distances else e
    key = lambda df: sorted(map(repr, df.select("row", df.columns[-1]).collect()))
    packed = predict.test_model(t, model, ("worker_id",), distances), predict.model_strength(t, model, ("worker_id",), distances)
    monkeypatch.setattr(predict, "LOOKUP", 0)
    joined = predict.test_model(t, model, ("worker_id",), distances), predict.model_strength(t, model, ("worker_id",), distances)
    assert [key(x) for x in packed] == [key(x) for x in joined] and packed[0].count() == len(rows)
    plan = packed[0].hint("merge")._jdf.queryExecution().executedPlan().toString()
    moved = plan.count("Exchange hashpartitioning(worker_id")
    assert moved <= 2 + distances and "item" not in "".join(x for x in plan.split("\n") if "Join" in x)


def test_points_of_different_dimensions_and_clashing_names(spark):
    e = spark.createDataFrame([(0, "w", i, f"i{i}", [float(i)] * (1 + (i > 5))) for i in range(8)], EMBEDDINGS)
    d = trials(spark, [("i0", "i1", "i2", "i1"), ("i6", "i7", "i7", "i7")]).withColumn("names", F.lit(1)).withColumn("coords", F.lit(2))
    got = predict.test_model(d, e, ("worker_id",)).orderBy("trial_ix").collect()
    assert [(r.ModPred, r.names, r.coords) for r in got] == [("i1", 1, 2), ("i7", 1, 2)]


MATRIX = [(0.9, 0.2, 0.25, 0.3), (0.15, 0.95, 0.2, 0.25), (0.3, 0.25, 0.85, 0.1), (0.22, 0.22, 0.25, 0.8)]


def test_z_golden(spark):
    pred = spark.createDataFrame([(f"{i}", f"{j}", v) for i, row in enumerate(MATRIX) for j, v in enumerate(row)], "judge_id string, model_id string, acc double")
    assert round(compare.z_pred_mat(pred, check_square=True).orderBy("judge_id").first().z, 2) == 13.0
    assert compare.z_pred_mat(pred.where("judge_id < '2' and model_id < '2'")).where("z is not null").isEmpty()
    with pytest.raises(ValueError):
        compare.z_pred_mat(pred.where("judge_id <> '1'"), check_square=True)
    d = compare.diag_offdiag(pred).first()
    assert d.diag == pytest.approx(0.875) and d.share_above == 1


def test_clusters(spark):
    pred = spark.createDataFrame([(f"{i}", f"{j}", v) for i, row in enumerate(MATRIX) for j, v in enumerate(row)], "judge_id string, model_id string, acc double")
    cl = spark.createDataFrame([("0", 1), ("1", 1), ("2", 2), ("3", 1)], "worker_id string, cluster int")
    got = {r.judge_id: r for r in compare.pacc_samediff(pred, cl).collect()}
    assert got["0"].self == 0.9 and got["0"].same == pytest.approx(0.25) and got["0"].other == pytest.approx(0.25)
    assert got["2"].same is None and got["2"].other == pytest.approx((0.3 + 0.25 + 0.1) / 3)
    per = {(r.judge_id, r.cluster): r.acc for r in compare.pacc_by_cluster(pred, cl).collect()}
    assert per[("0", 1)] == pytest.approx(0.25) and per[("2", 2)] is None and per[("3", 2)] == 0.25
    with pytest.raises(ValueError):
        compare.pacc_samediff(pred, cl.where("worker_id <> '2'"))


def test_triplet_names(spark):
    d = trials(spark, [("c x", "b", "a ", None), (None, "b", "a", None), ("c", None, "a", None), ("c", None, None, None)])
    assert [r.triplet for r in agreement.make_tripnames(d).orderBy("trial_ix").collect()] == ["cx_a_b", "NA_a_b", "c_a_a", None]


def test_majority(spark):
    def answers(w, *pairs):
        return [(w, k, c, "a", "b", a, None, "validation") for k, (c, a) in enumerate(pairs)]

    rows = answers("w1", ("x", "a"), ("x", "b"), ("y", "a")) + answers("w2", ("x", "b"), ("y", "b")) + answers("w3", ("x", "a"), ("z", None)) + [("w4", 1, "x", "a", "b", "a", None, "random")]
    d = spark.createDataFrame(rows, TRIALS)
    best, grid = agreement.make_vmat(d)
    got = {r.triplet: (r.majority, r.pmaj) for r in best.collect()}
    assert got["x_a_b"][0] == "b" and got["x_a_b"][1] == pytest.approx(2 / 3)
    assert got["y_a_b"] == ("a", 0.5) and got["z_a_b"] == (None, None)
    cells = {(r.worker_id, r.triplet): r.agree for r in grid.collect()}
    assert len(cells) == 12 and cells[("w1", "x_a_b")] == 1 and cells[("w2", "y_a_b")] == 0 and cells[("w4", "x_a_b")] is None
    assert {r.worker_id: r.agreement for r in agreement.worker_agreement(d).collect()} == {"w1": 1.0, "w2": 0.5, "w3": 0.0}
    last_null = spark.createDataFrame(answers("w", ("x", "a"), ("x", None)), TRIALS)
    assert agreement.majority(last_null).first().majority is None
    with pytest.raises(ValueError):
        agreement.make_vmat(d.where("sampleAlg = 'random'"))


@pytest.mark.parametrize("tile", [(1 << 17, 1 << 22), (30, 400)])
def test_moments_are_sums_of_the_matrix(spark, monkeypatch, tile):
    monkeypatch.setattr(predict, "TILE_TRIALS", tile[0]), monkeypatch.setattr(predict, "TILE_BYTES", tile[1])
    emb, rows = random_study(5)
    e, t = spark.createDataFrame(emb, EMBEDDINGS), spark.createDataFrame([x for x in rows if x[0] == "w2" or x[5] is not None and "i7" not in x[2:5] and ("i2" not in x[2:5] or x[0] in ("w0", "w3"))], TRIALS)
    names = sorted({x[1] for x in emb} | {x[0] for x in rows} - {None})
    cl = spark.createDataFrame([(w, (1, 2, None)[k % 3]) for k, w in enumerate(names[:-1])], "worker_id string, cluster int")
    pred, plain, grouped = (x.localCheckpoint() for x in (predict.prediction_matrix(e, t), predict.prediction_moments(e, t), predict.prediction_moments(e, t, cl)))
    key = lambda df: sorted((tuple(None if x is None else x if isinstance(x, (str, int)) else round(x, 9) for x in r) for r in df.collect()), key=repr)
    for old, new in ((compare.z_pred_mat(pred), compare.z_of_moments(plain)), (compare.diag_offdiag(pred), compare.diag_offdiag_of_moments(plain)),
                     (compare.pacc_samediff(pred, cl, False), compare.samediff_of_moments(grouped, cl, False)), (compare.pacc_by_cluster(pred, cl, False), compare.by_cluster_of_moments(grouped, cl, False))):
        assert key(old) == key(new) and old.columns == new.columns
    with pytest.raises(ValueError):
        compare.samediff_of_moments(grouped, cl.where("worker_id <> 'w1'"))


def test_no_query_on_judges_makes_or_broadcasts_the_matrix(spark):
    """Neither the rows of the matrix nor a tile that is sent to many cells, whose estimate is far too low."""
    emb, rows = random_study(4)
    e, t = spark.createDataFrame(emb, EMBEDDINGS), spark.createDataFrame(rows, TRIALS)
    for made in (predict.prediction_moments(e, t), predict.prediction_matrix(e, t)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [t#" in plan
    assert "model_id" not in predict.prediction_moments(e, t)._jdf.queryExecution().executedPlan().toString()
