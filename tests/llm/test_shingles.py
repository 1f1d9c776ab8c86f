import random

import corpus_pipeline
from tests.llm import brute

from trivium.llm import shingles


def _sets(text):
    words = brute.WORD.findall((text or "").translate(brute.LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _groups(texts):
    sets = [_sets(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    return brute.least(range(len(sets)), [(a, b) for a, b in pairs if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])


def _texts(seed):
    """Families of edited copies on both sides of the threshold, one crowded, some with a common passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    passage = [word() for _ in range(20)]
    out = [None, "", " \n", "one", "ONE ", "one two", "a b c d e", "a b c d e f"]
    for size in (60, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3):
        base = [word() for _ in range(r.randrange(60, 160))] + (passage if size % 2 else [])
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randrange(5)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [" ".join([word() for _ in range(50)] + passage) for _ in range(40)]
    r.shuffle(out)
    return out


def test_the_stage_links_what_is_alike_and_nothing_else(spark, monkeypatch):
    texts = _texts(1)
    docs = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    real = sorted(set(_groups(texts).values()))
    prints = brute.simhash_groups(list(enumerate(texts)))
    assert real != sorted({c for _, c in prints.values()})
    for sample, common in ((16, 6), (1, 4)):
        monkeypatch.setattr(shingles, "SAMPLE", sample)
        monkeypatch.setattr(shingles, "COMMON", common)
        got = corpus_pipeline.near_dedup(spark, docs, "")
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == real


def test_rows_are_told_apart_by_themselves(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, "x y"), (None, "x  y"), (4, "z"), (4, "w")]
    got = shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, " ".join(r.text.split())) for r in got) == sorted([(1, a), (2, b), (3, c), (0, "x y"), (4, "z"), (4, "w")])
    assert shingles.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
