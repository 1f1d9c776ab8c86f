import pytest
from pyspark.sql import functions as F

from trivium.operators import predict, quality
from trivium.sources import tables
from trivium.sources import trials as io

TRIALS = "worker_id string, trial_ix long, rt double, head long, winner long, loser long, Center string, Left string, Right string, Answer string, sampleAlg string, sampleSet string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond it
    rows = [(f"w{k % 7}", k, float(100 + 50 * (k % 7)), 0, 1, 2, "a", "b", "c", "b", "random", "test") for k in range(200)]
    names = tables.write_bucketed(spark.createDataFrame(rows, TRIALS), 4, order=("trial_ix",)), tables.write_bucketed(
        spark.createDataFrame([(f"w{w}", i, x, [float(w * i), 1.0]) for w in range(7) for i, x in enumerate("abc")], "worker_id string, item_ix long, item string, coords array<double>"), 4)
    yield [tables.read_bucketed(spark, n) for n in names]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_work_by_participant_needs_no_exchange(stored):
    trials, model = stored
    kept = quality.filter_incomplete(trials, 29)
    fast = quality.filter_fast_responders(trials, 200)
    right = quality.filter_failed_catch(trials)
    summary = quality.participant_summary(kept, mintrial=10)
    tested = predict.test_model(trials, model, ("worker_id",))
    scored = predict.hoacc(trials, model, "test", ("worker_id",))
    for df in (kept, summary, tested, scored):  # the other two filters meet by a null-safe key
        assert "Exchange" not in plan(df), plan(df)
    assert kept.count() == 4 * 29 and fast.count() == 200 - 29 * 2 and right.count() == 200 and summary.count() == 4 and tested.where("ModPred is not null").count() == 200 and scored.count() == 7


def test_a_bucket_is_one_sorted_file(spark, stored):
    files = stored[0].select(F.input_file_name().alias("f"), "worker_id", "trial_ix").collect()
    by_file = {}
    for r in files:
        by_file.setdefault(r.f, []).append((r.worker_id, r.trial_ix))
    assert len(by_file) <= 4 and all(x == sorted(x) for x in by_file.values())


def test_levels_by_collation(spark):
    names = ["b", "a", "B", "A", "ä", "é", "e", "z", "Z", "É"]
    d = spark.createDataFrame([(n,) for n in names] + [(None,)], "x string")
    got = lambda c: [r.item for r in io.item_levels(d, "x", collation=c).orderBy("item_ix").collect()]
    assert got(None) == sorted(names)
    assert got("UNICODE_CI_AI") == ["A", "a", "ä", "B", "b", "e", "É", "é", "Z", "z"]
    assert got("UNICODE") == ["a", "A", "ä", "b", "B", "e", "é", "É", "z", "Z"]
    assert got("sv") == ["a", "A", "b", "B", "e", "é", "É", "z", "Z", "ä"]
    with pytest.raises(Exception, match="COLLATION"):
        got("no_such_collation")


def test_collation_reaches_the_readers(spark, tmp_path):
    (tmp_path / "old.csv").write_text("sessionID,Center,Left,Right,Answer\np,b,A,ä,A\n", encoding="utf-8")
    for collation, order in ((None, ["A", "b", "ä"]), ("UNICODE", ["A", "ä", "b"])):
        trials, levels = io.read_legacy(spark, f"{tmp_path}/old.csv", collation=collation)
        assert [r.stimulus for r in levels.orderBy("numeric_value").collect()] == order
        assert trials.first()["head"] == order.index("b") and trials.first()["winner"] == order.index("A")
