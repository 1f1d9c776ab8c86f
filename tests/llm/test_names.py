"""Columns of the input that bear the operators' own inner names come back with their values."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trivium.llm import bpe, lines, mixing, quality, shingles, substrings

NAMES = ["_row", "_doc", "_gone", "_mix_source", "_mix_copy", "_q_x", "_q_words", "_q_key", "_q_ratio", "_whole", "_whole_", "_trivium_row", "_trivium_once", "_carried", "_", "a.b"]
LINE = "the same line in both documents "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LINE * 3 + "\nown words of one\n" + LINE, "s"), (2, "something else here\n" + LINE, "s"), (3, LINE * 3 + "\nown words of one\n" + LINE, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in NAMES})


def stages(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    return {
        "base_counts": quality.base_counts(docs), "judge": quality.judge(docs, labels, threshold=0.0), "fitted": quality.judge(docs, labels), "lines": lines.dedup_lines(docs),
        "mix": mixing.mix(docs), "emit": mixing.emit(mixing.mix(docs)), "near": shingles.keep_one(docs), "bpe": bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True),
        "substrings": substrings.dedup(docs),
    }


def test_all_come_back(spark, docs):
    for stage, done in stages(spark, docs).items():
        assert set(NAMES) <= set(done.columns), stage
        got = done.select("doc_id", *[f"`{n}`" for n in NAMES]).collect()
        assert got and all(r[1:] == tuple(f"{n}:{r.doc_id}" for n in NAMES) for r in got), stage
        assert len(got) >= (1 if stage == "emit" else 2 if stage == "near" else 3), stage


def test_vocabularies_beyond_the_packed_pairs_raise():
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][-1]["id"] = spec["model"]["vocab"][spec["added_tokens"][-1]["content"]] = 1 << 20
    with pytest.raises(ValueError, match="2\\*\\*20"):
        bpe.BPE(json.dumps(spec))
