import random

import numpy as np
from pyspark.sql import functions as F
from tests.llm import brute

from trivium.llm import embedding, lines, simhash
from trivium.llm.components import components
from trivium.llm.text import prefix_sums


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 5000), (6000, None)]
    edges += [(7000, 7001 + k) for k in range(200)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == brute.least({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sums(spark):
    for n in (0, 1, 2, 7, 100):
        values = [k * k % 13 for k in range(n)]
        got = spark.createDataFrame([(values,)], "v array<bigint>").select(prefix_sums(F.col("v"))).first()[0]
        assert got == [sum(values[:k]) for k in range(n)]


def test_golay_code():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    checks, errors = simhash.golay()
    index = simhash.nearest(words)
    code = (index << 11) | checks[index]
    assert max(int(x).bit_count() for x in words ^ code) <= 3
    assert sorted({int(e).bit_count() for e in errors}) == [0, 1, 2, 3] and len(set(errors.tolist())) == 2048


def test_prints_two_bits_apart_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (2, 1000)).astype(np.uint64)
    b = a ^ flips[0] ^ flips[1]
    keys = []
    for x in (a, b):
        at, k = simhash.keys_of(x)
        held = [set() for _ in x]
        for i, key in zip(at.tolist(), k.tolist(), strict=True):
            held[i].add(key)
        keys.append(held)
    assert all(x & y for x, y in zip(*keys, strict=True))


def _prints(seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(5)]
    dense = [centres[0] ^ sum(1 << b for b in r.sample(range(8), r.randrange(4))) for _ in range(400)]
    near = [c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for c in centres for _ in range(12)]
    return sorted({*dense, *near, *(r.getrandbits(64) for _ in range(60)), 0, 2**64 - 1})


def test_links_are_all_pairs_also_in_crowded_keys(spark):
    signed = [x - (1 << 64) if x >> 63 else x for x in _prints(4)]
    df = spark.createDataFrame([(x,) for x in signed], "print long")
    for bits in (1, 2):
        got = [(x.a, x.b) for x in simhash.links(df, bits).collect()]
        real = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]
        assert sorted(got) == sorted(real)


TEXTS = [
    None, "", " \n ", "one", "one two", "ONE two", "one two three four", "É é ñ ONE", "w " * 4000, "w " * 4001, "a b c d e f g h", "a b c d e f g h",
    "a b c d e f g i", " ".join(f"x{k % 97}" for k in range(900)), " ".join(f"x{k % 97}" for k in range(899)), "x\x0by\x0cz\x1cq", "same text here", "same text here",
]


def test_simhash_groups(spark):
    rows = [(k * 5 % 19, t, 0) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print int")
    real = brute.simhash_groups([(i, t) for i, t, _ in rows])
    got = {r.doc_id: (r.print % (1 << 64), r.component_id) for r in simhash.groups(docs).collect()}
    assert got == real
    twice = docs.unionByName(docs.where("doc_id in (0, 5, 15)")).unionByName(spark.createDataFrame([(None, "one", 1)], docs.schema))
    assert simhash.groups(twice).count() == twice.count()
    assert simhash.groups(docs.limit(0)).count() == 0


LINES = [
    (5, "A repeated line\nonly here, once\n\n  A REPEATED line\t\nshort\nshort"), (2, "a repeated line"), (9, None), (7, ""), (3, "short\nÀ repeated line\nx"),
    (11, "a repeated line\nwithin one doc, twice\nwithin one doc, twice"), (4, "\n\n"), (8, "tail line of some length\n"), (1, "tail line of some length"), (None, "a repeated line"),
    (6, "a repeated line\n" * 300), (12, "\x1ca repeated line"),
]


def test_line_dedup(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in LINES], "doc_id long, text string, n_lines string")
    for least in (2, 3):
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs, min_docs=least).collect()}
        assert got == {i: (t, n, d) for i, t, n, d in brute.line_dedup(LINES, least)}
    twice = docs.union(docs.where("doc_id = 5")).union(spark.createDataFrame([(5, "a repeated line\nanother text", "s")], docs.schema))
    assert sorted(r.text for r in lines.dedup_lines(twice).where("doc_id = 5").collect()) == sorted(
        ["only here, once\n\nshort\nshort"] * 2 + ["another text"])
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        for c in rng.normal(size=(6, 24)):
            rows += [(label, (c + rng.normal(scale=0.25, size=24)).tolist()) for _ in range(25)]
    rows += [(0, None), (0, []), (0, [0.0] * 24), (1, [float("nan")] * 24), (1, [float("inf")] + [1.0] * 23), (1, [1.0] * 23 + [None]), (0, [1.0, 2.0]), (0, [2.0, 4.0])]
    rows += [(1, [1e300] * 24), (1, [1e-300] * 24)] + [(0, rows[0][1])] * 30
    rows = [(k * 7 % 1009, *r, "x") for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, kept string").repartition(3)
    for tile, block in ((1024, 16), (32, 2)):
        monkeypatch.setattr(embedding, "TILE", tile)
        monkeypatch.setattr(embedding, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(df).collect()}
        assert got == brute.embedding_links([r[:3] for r in rows])
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in embedding.near_duplicates(odd).collect()) == [(-1, 0, False), (1, 1, True), (1, 1, True)]


def test_rows_that_share_a_vec_id_but_not_the_vector(spark):
    rows = [(1, 1, [1.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0]), (2, 1, [1.0, 0.01, 0.0]), (5, 1, [0.0, 1.0, 0.0]), (9, 1, [0.0, 0.0, 1.0]), (7, 2, [0.0, 1.0, 0.0]), (9, 2, [0.0, 1.0, 0.01])]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    # two rows hold vec 1: one links with 2, one with 5; vec 9's vector of label 1 links with nothing, that of label 2 with 7
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (5, 1, 1), (7, 1, 7), (9, 0, 7), (9, 1, 7)]
    alone = embedding.near_duplicates(spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0]), (2, 1, [1.0, 0.01, 0.0])], "vec_id long, label int, embedding array<float>"))
    assert sorted((r.vec_id, r.n_links) for r in alone.collect()) == [(1, 0), (1, 1), (2, 1)]


def test_summaries_rule_out_tiles_but_lose_none_with_links(spark, monkeypatch):
    monkeypatch.setattr(embedding, "TILE", 32)
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(scale=0.02, size=(64, 16)) for c in rng.normal(size=(12, 16))])
    rows = [(k, k, 1, v.tolist(), 1) for k, v in enumerate(x)]
    classes = spark.createDataFrame(rows, "id long, node long, label long, v array<double>, weight long").repartition(3)
    cut = embedding.tiles(classes, spark.sparkContext.broadcast(embedding.principal_axes(classes))).cache()
    where = {i: (r.part, r.seq) for r in cut.collect() for i in r.ids}
    open_ = {(tuple(r.ta), tuple(r.tb)) for r in embedding.open_pairs(cut, 0.93).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = {tuple(sorted((where[i], where[j]))) for i, j in zip(*np.nonzero(u @ u.T >= 0.93), strict=True)}
    n = cut.count()
    assert linked <= open_ and len(open_) < n * (n + 1) // 2 / 3


def test_axes_are_those_of_the_second_moments(spark):
    x = np.random.default_rng(9).normal(size=(50, 6)) * [5, 4, 3, 2, 1, 0.5]
    axes = embedding.principal_axes(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(4), slots=2, chunk=5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    moments = axes[6].T @ (u.T @ u) @ axes[6]
    assert np.allclose(moments, np.diag(np.diag(moments)), atol=1e-9) and (np.diff(np.diag(moments)) < 0).all()


def test_pruning_loses_no_pair():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 64))
    x = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0.1, 0.3, 0.4)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embedding.reachable(u, u, 0.93)
    assert set(zip(*np.nonzero(u @ u.T >= 0.93), strict=True)) <= set(zip(i, j, strict=True))


def test_a_cells_pairs_do_not_ride_on_its_tiles(spark, monkeypatch):
    """What meets the tiles is a cell's key and a tile's; beyond BROADCAST_ROWS of these they are exchanged whatever their file's size."""
    for name, value in (("TILE", 32), ("BLOCK", 2)):
        monkeypatch.setattr(embedding, name, value)
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(600, 24)), rng.normal(size=24) + rng.normal(scale=0.2, size=(100, 24))])
    rows = [(k, 1, v.tolist()) for k, v in enumerate(x)]
    sent, within = [], embedding.within
    monkeypatch.setattr(embedding, "within", lambda keys: sent.append(keys) or within(keys))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(df).collect()}
    assert got == brute.embedding_links([(k, 1, np.float32(v).astype(float).tolist()) for k, _, v in rows])
    assert sent[0].columns == ["dim", "i", "j", "part", "seq"] and sent[0].count() > 40
    assert "ResolvedHint (strategy=merge)" in embedding.within(spark.range(300_000).toDF("part"))._jdf.queryExecution().analyzed().toString()


def test_cells_grow_with_the_number_of_tiles():
    assert [embedding.sides(n, 250 * n, 64) for n in (0, 1, 128, 300, 5000)] == [16, 16, 16, 37, 128]
    assert [embedding.sides(5000, 5000 * 1024, d) for d in (64, 128, 1024)] == [64, 32, 16]
