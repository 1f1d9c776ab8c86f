import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute
from tokenizers import Tokenizer

from trivium.llm import bpe, queries, token_file
from trivium.llm.store import new_path

WORDS, BYTES = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n", "Hello  world's\tTEST", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "<|endoftext", "ΣΑΣ Σ", "İstanbul ﬁne", "é café",
    " nbsp em　wide", "\x1c\x1d control \x85 nel", "日本語 テスト 12345 ½ ²³", "😀😃 👩‍👩‍👧", "a" * 5000, "it's I'LL we've 'tis", "!!??..,,--__", "​ zero ﻿ bom", "x\ry\r\nz",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)


LIBRARY = Tokenizer.from_file(WORDS)
OURS, FAST = bpe.BPE(open(WORDS, encoding="utf-8").read()), token_file.Encoder(open(BYTES, encoding="utf-8").read())


def encoded(texts):
    """The ids of each text by our two encoders."""
    column = pa.array(texts, pa.string())
    offsets, ids = FAST.encode(column)
    return OURS.encode(column).to_pylist(), [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def by_library(texts):
    return [[e.ids for e in t.encode_batch(texts, add_special_tokens=False)] for t in (LIBRARY, FAST.library)]


def test_bpe_matches_the_library():
    texts = [*ODD, "a b " * 900, " " * 900 + "x", "x  y   z \n\n \t w", "don't  we'RE  \u00a0 \u3000end ", *ODD, " ", "", " a"]
    assert list(encoded(texts)) == by_library(texts)
    ids = pa.array(encoded(texts)[0])
    assert OURS.decode(ids).to_pylist() == LIBRARY.decode_batch(ids.to_pylist(), skip_special_tokens=False)


def test_decode_leaves_out_unknown_ids():
    lists = [[1, 60_000, 2, -1], None, [], [70_000]]
    assert OURS.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode([1, 2], skip_special_tokens=False), "", "", ""]


def test_every_code_point_matches_the_library():
    """Each of the 1.1 million code points: between letters, before a number, alone, and under a combining mark."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 40_000):
        texts = ["a{0}1 {0} b{0}\u0301".format(chr(c)) for c in points[k : k + 40_000]]
        for ours, theirs in zip(encoded(texts), by_library(texts), strict=True):
            assert ours == theirs, [t for t, x, y in zip(texts, ours, theirs, strict=True) if x != y][:5]


def test_marks_are_ordered_as_by_the_library():
    marks = [chr(c) for c in range(0x300, 0x2000) if unicodedata.combining(chr(c))] + [chr(c) for c in range(0x1DC0, 0x1E00)]
    rng = random.Random(1)
    texts = ["".join([*rng.choices(["", "a", "é", " "]), *rng.choices(marks, k=3), rng.choice(" x\t")]) for _ in range(20_000)]
    assert list(encoded(texts)) == by_library(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\u00a0\u3000\x1c'sA1.é<|"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_any_text_matches_the_library(texts):
    assert list(encoded(texts)) == by_library(texts)


def test_files_with_tokens_across_spaces_are_refused():
    for cls, path in ((bpe.BPE, BYTES), (token_file.Encoder, WORDS)):
        with pytest.raises(ValueError, match="space|white"):
            cls(open(path, encoding="utf-8").read())


def test_queue_gives_the_greedy_merges():
    plain = brute.Tokenizer(WORDS)
    text = " ".join("".join(random.Random(k).choices("etaoinshrdlu", k=k % 17 + 1)) for k in range(300))
    assert OURS.encode(pa.array([text])).to_pylist() == [plain.encode(text)]


def test_encode_rows(spark, library):
    rows = [(k, t, "kept") for k, t in enumerate([*ODD, None, "same", "same"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = {r.doc_id: r for r in bpe.encode(docs, WORDS, decoded=True).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        ids = library[0].encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].decoded == library[0].decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(docs, WORDS), WORDS).collect()
    assert {r.doc_id: r.decoded for r in again} == {k: r.decoded for k, r in got.items()}
    assert bpe.encode(docs.limit(0), WORDS).count() == 0


def test_contract_digests(spark, library, tmp_path):
    docs = spark.createDataFrame([(1, "Some words, some WORDS."), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_bpe(spark, str(tmp_path)).collect()}
    ids = library[0].encode("Some words, some WORDS.", add_special_tokens=False).ids
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == brute.sha(" ".join(map(str, ids)))
    assert got[1].decoded_sha256 == brute.sha(library[0].decode(ids, skip_special_tokens=False))
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packing_round_trip(values):
    control, data = token_file.pack(np.array(values, np.uint32))
    assert token_file.unpack(control, data, len(values)).tolist() == values


def test_token_file(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 40)
    rows = [(7 * k % 101, t, "x") for k, t in enumerate([*ODD, None, "tie", "tie"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    path = new_path(spark, "t")
    token_file.write(docs, BYTES, path)
    got = {r.doc_id: r for r in token_file.index(spark, path).collect()}
    start = 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*library[1].encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    ties = spark.createDataFrame([(None, f"t {k}") for k in range(50)], "doc_id long, text string")
    several = new_path(spark, "n")
    token_file.write(ties.unionByName(docs.select("doc_id", "text")), BYTES, several)
    assert [r.doc_id for r in token_file.index(spark, several).orderBy("start").limit(51).collect()] == [None] * 50 + [0]
    lists = {r.doc_id: r.ids for r in token_file.read_ids(spark, path).collect()}
    assert sum(map(len, lists.values())) == start
    empty = new_path(spark, "e")
    token_file.write(docs.limit(0), BYTES, empty)
    assert token_file.index(spark, empty).count() == 0
