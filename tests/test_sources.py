import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain_png
from trivium.sources import pictures
from trivium.sources import trials as io
from trivium.streaming import monitor


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_choices(spark):
    assert one(spark, '["assets/stimuli/cat.png","assets/stimuli/dog.png"]', io.process_choices) == "cat,dog"
    assert one(spark, '["resources/apple.png","resources/banana.png"]', io.process_choices) == "apple,banana"
    assert one(spark, "[a.png.png]", io.process_choices) == "a" and one(spark, None, io.process_choices) is None
    assert one(spark, 'assets/stimuli/["x"].png', io.clean_stimulus) == '["x"]'


def test_splits(spark):
    split = lambda s, p=",": one(spark, s, lambda c: io.strsplit1(c, p))
    assert split("a,b,c") == ["a", "b", "c"] and split("a,,b,") == ["a", "", "b"] and split(",a") == ["", "a"]
    assert split("") == [] and split("a1b22c", "[0-9]+") == ["a", "b", "c"] and split("abc", "") == ["a", "b", "c"] and split(None) is None
    first = spark.createDataFrame([("a,b,c",), ("a",), ("",), (None,)], "x string").select(*[c.alias(n) for c, n in zip(io.split_first("x"), "ab", strict=True)])
    assert [tuple(r) for r in first.collect()] == [("a", "b,c"), ("a", ""), ("", ""), (None, None)]


def test_header_aliases():
    assert io.find_column(("sessionID", "pid"), ["PID", "session id", "x"]) == "session id"
    assert io.find_column(("Alg.Label",), ["alg_label"]) == "alg_label" and io.find_column(("zz",), ["a"]) is None


def raw(folder, name, header, rows):
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


def test_read_raw(spark, tmp_path):
    head = "worker_id,trial_index,rt,stimulus,choices,response,trial_category"
    row = lambda w, k, rt, s, a, b, r, c: f'{w},{k},{rt},assets/stimuli/{s}.png,"[""resources/{a}.png"",""resources/{b}.png""]",{r},{c}'
    raw(tmp_path, "a.csv", head, [row("w1", k, 3000, "cat", "dog", "car", k % 2, "random") for k in range(6)] + [row("w1", 9, "null", "cat", "cat", "car", 0, "check"), row("w1", 10, 5, "x", "y", "z", 0, "intro")])
    raw(tmp_path, "b.csv", head + ",extra", [row("w2", k, 10, "cat", "dog", "boat", "NA", "validation") + ",1" for k in range(2)] + [row("w3", 1, 3000, "cat", "dog", "cat", 0, "check") + ",2"])
    (tmp_path / "note.txt").write_text("no")
    trials, levels = io.read_raw_data(spark, str(tmp_path))
    got = {(r.worker_id, r.trial_ix): r for r in trials.collect()}
    assert len(got) == 10 and [r.item for r in levels.orderBy("item_ix").collect()] == ["car", "cat", "dog"]
    assert got[("w1", 0)].Answer == "dog" and got[("w1", 1)].Answer == "car" and got[("w1", 1)].winner == 0 and got[("w1", 1)].loser == 2
    assert got[("w1", 9)].rt is None and got[("w1", 9)].sampleSet is None and got[("w2", 0)].Answer is None and got[("w2", 0)].Right == "boat"
    kept, _ = io.read_raw_data(spark, str(tmp_path), output_df=str(tmp_path / "out"), output_levels=str(tmp_path / "lev"), min_trials=2, min_mean_rt_ms=100)
    assert {r.worker_id for r in kept.collect()} == {"w1"} and spark.read.csv(str(tmp_path / "out"), header=True).count() == 7
    strict, _ = io.read_raw_data(spark, str(tmp_path), max_prop_wrong=0.5)
    assert {r.worker_id for r in strict.collect()} == {"w1", "w2"}
    with pytest.raises(ValueError):
        io.read_raw_data(spark, str(_empty(tmp_path)))


def _empty(folder):
    (folder / "empty").mkdir()
    return folder / "empty"


def test_read_legacy(spark, tmp_path):
    raw(tmp_path, "l.csv", "Participant.ID,Target,Option 1,option2,primary,AlgSample,RT", ["p,a,b,c,b,Random,5", "p,a,b,c,c,TEST,NA", "q,b,a,z,zz,odd,7", "q,NA,a,z,a,check,7"])
    trials, levels = io.read_legacy(spark, str(tmp_path / "l.csv"))
    assert [tuple(r) for r in levels.orderBy("numeric_value").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "z")]
    got = trials.collect()
    by = {(r.p_id, r.Answer): r for r in got}
    assert (by[("p", "b")].winner, by[("p", "b")].loser, by[("p", "b")].RT, by[("p", "b")].sampleAlg) == (1, 2, 5.0, "random")
    assert by[("p", "c")].sampleAlg == "validation" and by[("p", "c")].RT is None
    assert by[("q", "zz")].winner is None and by[("q", "zz")].loser is None and by[("q", "zz")].sampleAlg is None and by[("q", "a")].head is None
    assert {r.sampleSet for r in got} <= {"train", "test"}
    plain = spark.createDataFrame([("a", "b", "c", "odd")] * 3, "Center string, Left string, Right string, TrnTest string")
    t, _ = io.standardise_legacy(plain)
    assert sorted(r.p_id for r in t.collect()) == ["P1", "P2", "P3"] and {r.sampleSet for r in t.collect()} == {"odd"} and t.first().Answer is None


def test_combined(spark, tmp_path):
    raw(tmp_path, "e.csv", "worker_id,file,dim_0,dim_1", ["zed,i1,1,2", "zed,i0,3,4", "abe,i1,5,6", "NA,i1,7,8"])
    e = io.get_combined(spark, str(tmp_path / "e.csv"), embeddings=True).orderBy("worker_ix", "item_ix").collect()
    assert [(r.worker_ix, r.worker_id, r.item_ix, r.item, r.coords) for r in e] == [(0, "zed", 0, "i1", [1, 2]), (0, "zed", 1, "i0", [3, 4]), (1, "abe", 0, "i1", [5, 6])]
    raw(tmp_path, "g.csv", "item,dim_0", ["a,1", "b,2"])
    assert {r.worker_id for r in io.get_combined(spark, str(tmp_path / "g.csv"), embeddings=True).collect()} == {"group"}
    raw(tmp_path, "t.csv", "worker_id,rt", ["b,1", "a,2", "b,3"])
    assert [(r.worker_id, r.worker_ix) for r in io.get_combined(spark, str(tmp_path / "t.csv")).orderBy("trial_ix").collect()] == [("b", 0), ("a", 1), ("b", 0)]
    raw(tmp_path, "h.csv", "item,dim_0", ["a,NA"])
    with pytest.raises(Exception, match="missing coordinate"):
        io.get_combined(spark, str(tmp_path / "h.csv"), embeddings=True).collect()
    with pytest.raises(ValueError):
        io.combined_embeddings(spark.createDataFrame([("a",)], "worker_id string"))


def png(pixels, colour=2, filters=(0, 1, 2, 3, 4)):
    h, w, n = pixels.shape
    lines, above = b"", np.zeros(w * n, int)
    for y in range(h):
        row, f = pixels[y].reshape(-1).astype(int), filters[y % len(filters)]
        left = np.concatenate([np.zeros(n, int), row[:-n]])
        corner = np.concatenate([np.zeros(n, int), above[:-n]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines += bytes([f]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][f]) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_pictures(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (12, 9, 3))
    pixels[3, 4] = 255
    assert (plain_png.decode_png(png(pixels)) * 255).round().astype(int).tolist() == pixels.tolist()
    grey = np.array([[[255], [0]], [[7], [255]]])
    (tmp_path / "cat.png").write_bytes(png(grey, colour=0))
    (tmp_path / "note.txt").write_text("x")
    got = pictures.rasters(pictures.read_pictures(spark, str(tmp_path))).collect()
    assert [(r.name, r.raster) for r in got] == [("cat", [[pictures.CLEAR, pictures.OPAQUE], [pictures.OPAQUE, pictures.CLEAR]])]
    red = pictures.recolour(pictures.rasters(pictures.read_pictures(spark, str(tmp_path))), "red").first().raster
    assert red == [[pictures.CLEAR, "red"], ["red", pictures.CLEAR]]


def test_pictures_of_all_kinds_equal_their_definition(spark, tmp_path):
    rnd = np.random.default_rng(5)
    kinds = {"grey": (0, 1), "colour": (2, 3), "alpha": (6, 4)}
    for name, (colour, channels) in kinds.items():
        pixels = np.where(rnd.random((7, 5, channels)) < 0.4, 255, rnd.integers(0, 256, (7, 5, channels)))
        (tmp_path / f"{name} picture.png").write_bytes(png(pixels, colour=colour))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = {r.name: r.raster for r in pictures.rasters(pictures.read_pictures(spark, str(tmp_path)), "#010203FF").collect()}
    assert got.pop("broken") is None and set(got) == {f"{k} picture" for k in kinds}
    for name, raster in got.items():
        first = plain_png.decode_png((tmp_path / f"{name}.png").read_bytes())[:, :, 0]
        assert raster == np.where(first == 1, pictures.CLEAR, "#010203FF").tolist()


def test_stream(spark, tmp_path):
    schema = "trial_ix long, worker_id string, rt double, Center string, Left string, Right string, Answer string, head long, winner long, loser long, sampleAlg string, sampleSet string"
    rows = [(k, f"w{k % 2}", 10.0 * k, "a", "a", "b", "a" if k % 3 else "b", 0, 0, 1, "check", None) for k in range(12)]
    folder = str(tmp_path / "in")
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
    q = monitor.running_summary(monitor.stream_trials(spark, folder, max_files=1)).writeStream.outputMode("complete").format("memory").queryName("summary").start()
    q.processAllAvailable()
    q.stop()
    got = {r.worker_id: r for r in spark.table("summary").collect()}
    batch = {r.worker_id: r for r in monitor.running_summary(spark.read.schema(schema).parquet(folder)).collect()}
    assert got == batch and got["w0"].ndat == 6
