import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trivium import scratch
from trivium.operators import quality
from trivium.plans.catalog import ORACLES, QUERIES
from trivium.schema import held
from trivium.sources import trials as io

DATA = "/root/testdata/sf0.001"
NEW = ["read_raw_folder", "read_legacy_file", "legacy_without_ids", "get_combined_trials", "get_combined_embeddings", "picture_rasters", "picture_recolour",
       "hclust_merges", "hclust_ward_cut", "tip_coords", "group_mean_rotated", "rep_dist_64d", "nearest_k_64d", "participant_range"]


def _norm(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(_norm(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(_norm, r)) for r in result.fetchall())


def test_rows_are_numbered_over_several_tasks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = sorted((r.k, r.place) for r in io.numbered(df, "k", "place", bounds=7).collect())
    assert [p for _, p in got] == list(range(1, 1001))
    words = spark.createDataFrame([(x,) for x in ["b", None, "a", "c", "a", None]], "w string")
    assert sorted(r.n for r in io.numbered(words, "w", "n").collect()) == [1, 2, 3, 4, 5, 6]
    assert {r.n for r in io.numbered(words, "w", "n").where("w is null").collect()} == {1, 2}
    assert io.numbered(words.limit(0), "w", "n").count() == 0


def test_one_pass_excludes_what_the_three_rules_do(spark):
    rows = [(f"w{k % 7}" if k % 11 else None, "x" if k % 5 == 0 else str(900 + 40 * (k % 7)), "a" if k % 3 == 0 else "h", "a" if k % 2 else "b", "b" if k % 2 else "a") for k in range(400)]
    rows += [("lone", "5000", "h", None, "b")] * 60
    d = spark.createDataFrame(rows, "worker_id string, rt string, head string, winner string, loser string")
    for n, ms, share in ((0, 0, 1.0), (52, 950, 0.5), (50, 1000, 0.45), (61, 0, 1.0)):
        steps = quality.filter_failed_catch(quality.filter_fast_responders(quality.filter_incomplete(d, n), ms), share)
        assert sorted(map(str, quality.exclude(d, n, ms, share).collect())) == sorted(map(str, steps.collect()))


def test_lookup_tables_beyond_the_bound_are_stored(spark):
    df = spark.range(50).withColumn("s", F.lit("é"))
    for bound in (10, 100):
        assert sorted(r.id for r in held(df, bound).collect()) == list(range(50)) and held(df, bound).dtypes == df.dtypes
    assert held(df.limit(0)).count() == 0


def test_files_with_different_headers_are_one_table(spark, tmp_path):
    for k, text in enumerate(["a,b\n1,2\n", "a,b\n", 'b,"a x"\n3,4\n', ""]):
        (tmp_path / f"{k}.csv").write_text(text)
    made = io.read_csv(spark, io.data_files(spark, str(tmp_path)))
    assert sorted((r.a or "", r.b, r["a x"] or "") for r in made.collect()) == [("", "3", "4"), ("1", "2", "")]


def test_workers_are_numbered_by_file_and_row(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "a.csv").write_text("worker_id,x\n" + "w9,1\nw2,1\n")
    (folder / "b.csv").write_text("worker_id,x\n" + "w2,1\nw1,1\n" * 200)
    (folder / "c.csv").write_text("worker_id,x\nw0,1\n,2\n")
    got = {(r.worker_id, r.worker_ix) for r in io.get_combined(spark, str(folder)).collect()}
    assert got == {("w9", 0), ("w2", 1), ("w1", 2), ("w0", 3)}


def test_legacy_files_are_named_after_the_input(spark, tmp_path):
    (tmp_path / "old.study.csv").write_text("sessionID,Target,Option1,Option2,primary\ns,cat,dog,car,dog\n")
    path = f"{tmp_path}/old.study.csv"
    out = io.write_legacy(*io.read_legacy(spark, path), path)
    assert out == (f"{tmp_path}/old.study_v2025.csv", f"{tmp_path}/old.study_2025_levels.csv") and all(map(os.path.isdir, out))
    assert [r.stimulus for r in spark.read.csv(out[1], header=True).orderBy("numeric_value").collect()] == ["car", "cat", "dog"]


def test_scratch_folders_are_released_between_marks(spark):
    start = scratch.mark(spark)
    a = scratch.materialize(spark.range(3), "a").inputFiles()[0].removeprefix("file://")
    stop = scratch.mark(spark)
    b = scratch.materialize(spark.range(4), "b")
    assert scratch.release(spark, start, stop) == 1 and b.count() == 4 and scratch.release(spark, start, stop) == 0
    assert not os.path.exists(a)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "none"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
