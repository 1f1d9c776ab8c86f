import csv as plain
import random

import pytest
from pyspark.sql import functions as F

from trivium.sources import csv
from trivium.sources import trials as io


@pytest.fixture
def split(spark):
    """Ranges of a few hundred bytes, so that small files are read by many tasks."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300"), spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def fields(rnd):
    return [
        rnd.choice(["a", "", "NA", "x y", "é日"]), str(rnd.randint(0, 999)),
        rnd.choice(["plain", 'he said "no"', "line\nbreak", "crlf\r\nhere", '"\n"', "a,b", "\n" * 5, '""', "long " * 30, ("deep\n" * 150), 'q"\n' * 20]),
    ]


def write(path, rows, ending):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = plain.writer(f, lineterminator=ending)
        w.writerow(["id", "n", "text"])
        for r in rows:
            w.writerow(r)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_file_is_read_by_many_tasks(spark, split, tmp_path, ending):
    rnd = random.Random(len(ending))
    rows = [fields(rnd) for _ in range(300)]
    path = f"{tmp_path}/one.csv"
    write(path, rows, ending)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 20
    got = csv.read_csv(spark, [path], ordered=True).orderBy("_row").collect()
    with open(path, newline="", encoding="utf-8") as f:
        want = list(plain.reader(f))[1:]
    assert [r._row for r in got] == list(range(1, len(rows) + 1)) and {r._file for r in got} == {0}
    none = lambda v: None if v in ("", "NA") else v  # noqa: E731  an unquoted empty field is null, and csv.writer quotes none
    assert [(r.id, r.n, r.text) for r in got] == [(none(a), n, t) for a, n, t in want]


def test_equal_to_the_reader_in_one_task(spark, split, tmp_path):
    rnd = random.Random(9)
    for k in range(3):
        write(f"{tmp_path}/{k}.csv", [fields(rnd) for _ in range(60)], "\n")
    with open(f"{tmp_path}/1.csv", "a", encoding="utf-8") as f:
        f.write('\n\nlast,,""')
    mine = csv.read_csv(spark, csv.data_files(spark, str(tmp_path)))
    theirs = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"', nullValue="NA")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(mine) == key(theirs) and mine.count() == 181


def test_headers_that_differ_and_names(spark, split, tmp_path):
    (tmp_path / "a.csv").write_text('id,"two\nlines"\n1,x\n')
    (tmp_path / "b.csv").write_text("﻿other,id,\n9,2,z\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    made = csv.read_csv(spark, csv.data_files(spark, str(tmp_path), ".csv"))
    assert sorted(made.columns) == ["_c2", "id", "other", "two\nlines"]
    assert sorted((r.id, r.other, r["_c2"]) for r in made.collect()) == [("1", None, None), ("2", "9", "z")]
    assert csv.column_names("a,b,a,") == ["a0", "b", "a2", "_c3"]


def test_odd_quotes_and_missing_files_raise(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('id\n"open\n')
    with pytest.raises(ValueError, match="odd number of quotes in .*bad.csv"):
        csv.read_csv(spark, [f"{tmp_path}/bad.csv"])
    with pytest.raises(ValueError, match="no CSV files"):
        csv.data_files(spark, str(tmp_path / ".."), ".csv") if not list((tmp_path / "..").glob("*.csv")) else csv.data_files(spark, str(tmp_path), ".nothing.csv")


def test_get_combined_keeps_the_order_over_tasks(spark, split, tmp_path):
    for part in range(3):
        with open(f"{tmp_path}/part-{part}.csv", "w", newline="") as f:
            w = plain.writer(f)
            w.writerow(["worker_id", "Center", "note"])
            for k in range(80):
                w.writerow([f"w{(part * 80 + k) % 7}", f"c{part}_{k}", "two\nlines " * (k % 4)])
    got = io.get_combined(spark, str(tmp_path)).orderBy("trial_ix").select("Center", "worker_ix", "worker_id").collect()
    assert [r.Center for r in got] == [f"c{p}_{k}" for p in range(3) for k in range(80)]
    assert {(r.worker_id, r.worker_ix) for r in got} == {(f"w{k}", k) for k in range(7)}
    assert io.get_combined(spark, str(tmp_path)).where(F.col("note").contains("\n")).count() == 180
