"""Painting against a loop over pixels; missing items and participants by place."""

import math
import random

import pytest

from trivium.operators import canvas, predict
from trivium.sources import trials as io

BOXES = "item string, place long, x0 double, y0 double, x1 double, y1 double"


def by_hand(boxes, pictures, width, height, tile, background):
    low_x, low_y, high_x, high_y = min(b[2] for b in boxes), min(b[3] for b in boxes), max(b[4] for b in boxes), max(b[5] for b in boxes)
    out = {}
    for item, _, x0, y0, x1, y1 in sorted(boxes, key=lambda b: (b[1], b[0])):
        picture = pictures.get(item)
        for y in range(height) if picture and x1 > x0 and y1 > y0 else ():
            for x in range(width):
                u = math.floor((low_x + (x + 0.5) / width * (high_x - low_x) - x0) / (x1 - x0) * len(picture[0]))
                v = math.floor((y1 - (high_y - (y + 0.5) / height * (high_y - low_y))) / (y1 - y0) * len(picture))
                if 0 <= v < len(picture) and 0 <= u < len(picture[0]) and picture[v][u] is not None:
                    *own, a = (int(picture[v][u][k : k + 2], 16) for k in (1, 3, 5, 7))
                    if a:
                        below = out.get((y, x), background)
                        out[y, x] = tuple((o * a + b * (255 - a)) // 255 for o, b in zip(own, below, strict=True))
    return {(y // tile * -(-width // tile) + x // tile, y, x, "#%02X%02X%02X" % c) for (y, x), c in out.items()}


@pytest.mark.parametrize(("width", "height", "tile"), [(60, 40, 16), (33, 50, 64)])
def test_equal_to_a_loop_over_pixels(spark, width, height, tile):
    rnd = random.Random(width)
    boxes, pictures = [("all", 0, 0.0, 0.0, 10.0, 10.0)], {"all": [["#10203040"] * 2]}
    for k in range(14):
        x, y = rnd.uniform(0, 8), rnd.uniform(0, 8)
        boxes.append((f"p{k}", rnd.randint(1, 4), x, y, x + rnd.uniform(0.05, 5), y + rnd.uniform(0.05, 5)))
        pictures[f"p{k}"] = [[rnd.choice(["#00000000", "#FF0000FF", "#00FF0080", "#0000FF01", "#123456FE", None]) for _ in range(3)] for _ in range(2)]
    boxes += [("flat", 9, 1.0, 1.0, 1.0, 2.0), ("bare", 9, 0.0, 0.0, 9.0, 9.0), ("void", 9, 0.0, 0.0, 9.0, 9.0)]
    pictures["void"] = []
    got = canvas.paint(spark.createDataFrame(boxes, BOXES), spark.createDataFrame(list(pictures.items()), "name string, raster array<array<string>>"), width, height, tile, (250, 240, 230))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == by_hand(boxes, pictures, width, height, tile, (250, 240, 230)) and len(rows) == len(set(rows)) > 1000


def test_nothing_to_paint(spark):
    none = spark.createDataFrame([], "name string, raster array<array<string>>")
    assert canvas.paint(spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0)], BOXES), none, 8, 8).count() == 0
    assert canvas.paint(spark.createDataFrame([], BOXES), none, 8, 8).count() == 0


def test_missing_items_by_participant(spark):
    d = spark.createDataFrame([("a", "x", "y", "z"), ("b", "x", None, "z"), (None, "x", "q", "z")], "worker_id string, Center string, Left string, Right string")
    model = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), (None, "x")], "worker_id string, item string")
    got = {tuple(r) for r in predict.missing_items(d, model, ("worker_id",)).collect()}
    assert got == {("a", "z"), ("b", "x"), ("b", "z"), (None, "x"), (None, "q"), (None, "z")}


def test_participants_by_place(spark):
    d = spark.createDataFrame([(k, f"w{k}") for k in range(6)], "worker_ix long, worker_id string")
    assert {r.worker_ix for r in io.at_places(d, range(2, 4)).collect()} == {1, 2}
    assert {r.worker_ix for r in io.at_places(d, [1, 6, 9]).collect()} == {0, 5}
