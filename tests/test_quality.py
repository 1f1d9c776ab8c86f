import math

import pytest

from trivium.operators import quality
from trivium.schema import require

COLUMNS = "worker_id string, head string, winner string, loser string"


def ids(d):
    return sorted({r.worker_id or "-" for r in d.collect()})


def test_incomplete(spark):
    d = spark.createDataFrame([("p1",)] * 600 + [("p2",)] * 100 + [(None,)] * 700, "worker_id string")
    assert ids(quality.filter_incomplete(d)) == ["p1"]
    assert quality.filter_incomplete(d, 510).count() == 600
    assert ids(quality.filter_incomplete(d, 0)) == ["p1", "p2"]


def test_fast_responders(spark):
    rows = [("slow", "3000"), ("slow", "null"), ("edge", "1000"), ("edge", "1000"), ("fast", "10"), ("none", "x"), ("none", None), (None, "5000"), ("neg", "-5")]
    d = spark.createDataFrame(rows, "worker_id string, rt string")
    assert ids(quality.filter_fast_responders(d)) == ["-", "edge", "slow"]
    assert ids(quality.filter_fast_responders(d, 0)) == ["-", "edge", "fast", "slow"]


def test_failed_catch(spark):
    p1 = [("p1", "a", "a", "b"), ("p1", "a", "b", "a"), ("p1", "c", "d", "c"), ("p1", "c", "c", "d"), ("p1", "x", "y", "z")]
    p2 = [("p2", "a", "b", "a")] * 3 + [("p2", "a", "a", "b")] * 2
    rest = [("none", "x", "y", "z"), ("unknown", "a", "b", "a"), ("unknown", None, "b", "a"), (None, "a", "b", "a")]
    d = spark.createDataFrame(p1 + p2 + rest, COLUMNS)
    assert ids(quality.filter_failed_catch(d, 0.4)) == ["none", "unknown"]
    assert ids(quality.filter_failed_catch(d, 0.5)) == ["none", "p1", "unknown"]
    assert ids(quality.filter_failed_catch(d, 1.0)) == ["-", "none", "p1", "p2", "unknown"]


def test_sample_alg(spark):
    rows = [("cat", "cat", "dog", False), ("dog", "fish", "frog", False), ("bird", "eagle", "sparrow", True), (None, "a", "b", None), ("a", None, "a", True), ("a", None, "b", True)]
    d = spark.createDataFrame(rows, "head string, winner string, loser string, validation boolean")
    assert [r.sampleAlg for r in quality.assign_sample_alg(d).collect()] == ["check", "random", "validation", "random", "check", "validation"]


def test_sample_sets(spark):
    rows = [(f"w{k % 20}", k, ("random", "check", "validation", None)[k % 4]) for k in range(8000)]
    d = spark.createDataFrame(rows, "worker_id string, trial_ix long, sampleAlg string")
    got = quality.assign_sample_sets(d, 0.2, 42)
    by = {(r.sampleAlg, r.sampleSet): r["count"] for r in got.groupBy("sampleAlg", "sampleSet").count().collect()}
    assert by[("check", None)] == 2000 and by[("validation", "train")] == 2000 and by[(None, "train")] == 2000
    assert 330 < by[("random", "test")] < 470
    again = quality.assign_sample_sets(d.repartition(7), 0.2, 42)
    assert got.exceptAll(again).isEmpty() and not quality.assign_sample_sets(d, 0.2, 43).exceptAll(got).isEmpty()
    assert quality.assign_sample_sets(d, 1.0).where("sampleAlg = 'random' and sampleSet = 'train'").isEmpty()


def test_participant_summary(spark):
    def rows(w, rts, checks, extra=()):
        return [(w, k, rt, "random", "a", "b") for k, rt in enumerate(rts)] + [(w, 100 + k, 2000.0, "check", "a", a) for k, a in enumerate(checks)] + list(extra)

    data = rows("ok", [math.e * 1000] * 3, "aa") + rows("zero", [0.0, 1000.0], "aa") + rows("neg", [-5.0, 1000.0, None], "aa")
    data += rows("one", [3000.0], "a") + rows("edge", [3000.0] * 5, "aaaab") + rows("null", [3000.0], ["a", None]) + rows("short1", [], "a")
    data += rows("nolabel", [3000.0], "aa", [("nolabel", 9, 3000.0, None, "a", "b")])
    d = spark.createDataFrame(data, "worker_id string, trial_ix long, rt double, sampleAlg string, Center string, Answer string")
    got = {r.worker_id: r for r in quality.participant_summary(d, mintrial=2, accthresh=0.8).collect()}
    assert got["ok"].ndat == 5 and got["ok"].cacc == 1 and got["ok"].keep is True
    assert got["ok"].lrt == pytest.approx((3 + 2 * math.log(2)) / 5)
    assert got["zero"].lrt == -math.inf and got["zero"].keep is False
    assert got["neg"].lrt == pytest.approx(2 * math.log(2) / 3)
    assert got["one"].cacc is None and got["one"].keep is None
    assert got["edge"].cacc == 0.8 and got["edge"].keep is False
    assert got["null"].cacc is None and got["nolabel"].cacc is None
    assert got["short1"].keep is False and got["short1"].cacc is None
    part = {r.worker_id: r.ndat for r in quality.participant_summary(d, trial_range=(2, 3), mintrial=1).collect()}
    assert part["ok"] == 2 and part["one"] == 1 and "short1" not in part


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="rt"):
        quality.filter_fast_responders(spark.createDataFrame([("a",)], "worker_id string"))
    assert require(spark.range(1), "id").count() == 1
