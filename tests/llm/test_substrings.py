import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trivium.llm import substrings


def reference(rows, window=20):
    """rows: (id, text) of different ids; (id, words, removed, sha of the kept words) by definition."""
    seen, out = set(), []
    for i, text in sorted(((substrings.LEAST if i is None else i), t or "") for i, t in rows):
        words, gone = brute.WORD.findall(text), set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out.append((i, len(words), len(gone), brute.sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return out


def rows():
    rnd = random.Random(5)
    base = [[rnd.choice(["a", "bé", "日", "c", "d"]) + rnd.choice(["", "x", "yy"]) for _ in range(60)] for _ in range(4)]
    out = []
    for i in range(150):
        words = []
        for _ in range(rnd.randint(0, 6)):
            passage, at = rnd.choice(base), rnd.randint(0, 40)
            words += passage[at : at + rnd.randint(1, 40)] + [f"u{rnd.randint(0, 9999)}"] * (rnd.random() < 0.3)
        out.append((i, rnd.choice([" ", "\n", "  ", "\t "]).join(words)))
    return out + [(500, "a " * 300), (501, "a " * 50), (502, None), (503, ""), (504, "x"), (505, "a b " * 100), (None, "a b " * 30), (506, "　 a" * 40)]


def digest(done):
    return sorted(tuple(r) for r in done.select(F.coalesce("doc_id", F.lit(substrings.LEAST)), "n_words", "n_removed", F.sha2("text", 256)).collect())


@pytest.mark.parametrize(("shard", "stream"), [(substrings.SHARD, substrings.STREAM), (40, 30)])
def test_equal_to_the_definition(spark, monkeypatch, shard, stream):
    for name, value in (("SHARD", shard), ("STREAM", stream), ("CELL", substrings.CELL if shard > 40 else 25)):
        monkeypatch.setattr(substrings, name, value)
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    want = reference(rows())
    assert digest(substrings.dedup(docs)) == want and sum(r[2] for r in want) > 5000


def test_other_columns_stay_and_equal_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "w " * 25 + "end"), (1, "w " * 25 + "end"), (2, "x " + "w " * 22)], "doc_id long, text string").withColumns(
        {"_carried": F.lit(1), "gone": F.lit(2), "th": F.lit(3), "a.b": F.lit(4), "n_words": F.lit(5)})
    done = substrings.dedup(docs).orderBy("doc_id").collect()
    assert done[0].asDict().keys() == {"doc_id", "text", "_carried", "gone", "th", "a.b", "n_words", "n_removed"}
    assert done[0] == done[1] and (done[0]["_carried"], done[0]["gone"], done[0]["th"], done[0]["a.b"]) == (1, 2, 3, 4)
    assert [r.n_words for r in done] == [26, 26, 23] and [r.n_removed for r in done] == [24, 24, 22] and done[2].text == "x"


def test_empty_table_and_small_windows(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="8 words"):
        substrings.dedup(spark.createDataFrame([], "doc_id long, text string"), window=8)


def test_very_long_text(spark):
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(400_000))
    docs = [(1, long), (2, "start " + long[1_000_000:1_000_500] + " end"), (3, "y" * 3_000_000 + " " + long[:400])]
    assert digest(substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == reference(docs)
