import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_shingles import _groups as alike_groups

from trivium.llm import quality, queries


def _documents():
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 7)))
    texts = ["\n".join(" ".join(word() for _ in range(30)) for _ in range(r.randrange(2, 6))) for _ in range(60)]
    texts[10] = texts[3]
    texts[11] = texts[3] + " "
    near = texts[3].split(" ")
    near[7] = "changed"
    texts[12] = " ".join(near)
    texts[20] = texts[21].split("\n")[0] + "\n" + texts[20]
    texts[30], texts[31], texts[32] = None, "", "BUY!! NOW!! " * 50
    return [(k, t, "en", f"s{k % 3}" if k % 10 else None, len(t or "")) for k, t in enumerate(texts)]


def test_each_stage_and_the_whole(spark, tmp_path):
    rows = _documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, n_lines string, _row int"
    rows = [(*r, f"k{r[0]}", r[0], f"n{r[0]}", -r[0]) for r in rows]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 60, 4)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs
        if name != "bpe":
            assert docs.where("kept <> concat('k', doc_id) or size <> doc_id or n_lines <> concat('n', doc_id) or _row <> -doc_id").isEmpty()
            assert docs.dtypes == spark.createDataFrame([], schema).dtypes
    judged = brute.quality([r[:2] for r in rows], {k for k, *_ in labels if not brute.held_out(k)}, quality.BUCKETS, quality.THRESHOLD)
    good = [r for r, (_, _, kept) in zip(rows, judged, strict=True) if kept]
    assert sorted(r.doc_id for r in seen["quality_rules"].collect()) == [r[0] for r in good]
    cut = {i: t for i, t, _, _ in brute.line_dedup([r[:2] for r in good])}
    assert {r.doc_id: (r.text, r.n_chars) for r in seen["line_dedup"].collect()} == {i: (t, len(t)) for i, t in cut.items()}
    groups = alike_groups(list(cut.values()))
    left = [(r[0], r[3], cut[r[0]]) for k, r in enumerate(good) if groups[k] == k]
    assert sorted(r.doc_id for r in seen["simhash_near_dedup"].collect()) == [i for i, _, _ in left]
    mixed = sorted(i for i, *_, copies in brute.mix(left) for _ in range(copies))
    assert sorted(r.doc_id for r in seen["mix_sources"].collect()) == mixed
    tokens = brute.Tokenizer(queries.tokenizer("word_bpe_49k.json"))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids) for r in final) == [(i, tokens.encode(cut[i])) for i in mixed]


def test_rows_without_or_with_the_same_doc_id(spark, tmp_path):
    """One doc_id with two texts, one of them a copy; null doc_ids; a very long text; columns with dots: reruns are equal."""
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    a, b, c, long = text(80), text(80), text(80), text(150_000)
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c), (7, long), (8, long + " end")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, `dot.ted` int")
    for _ in range(2):
        kept = corpus_pipeline.near_dedup(spark, df.repartition(3), str(tmp_path)).collect()
        assert sorted((x.doc_id or 0, len(x.text), x["dot.ted"]) for x in kept if x.doc_id) == [(1, len(a), 0), (5, len(b), 2), (7, len(long), 5)]
        assert [x.text for x in kept if x.doc_id is None] == [c]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    once, twice = (sorted((str(x.doc_id), tuple(x.ids)) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) for _ in range(2))
    assert once == twice and {i for i, _ in once} == {"1", "5", "7", "None"}


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
