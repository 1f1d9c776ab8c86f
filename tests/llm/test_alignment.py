import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from trivium.llm import alignment, bpe  # noqa: E402
from trivium.llm.queries import QUERIES  # noqa: E402

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha of the groups) by whole texts and all pairs of tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_lib, b_lib, byte = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), {c: b for b, c in enumerate(bpe.byte_alphabet())}
    a_lib.encode_special_tokens = True
    rows, links = [], []
    for text in texts:
        ids = [a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)] if text else [[], []]
        spelt = [bytes(byte[c] for c in a_lib.id_to_token(i)) for i in ids[0]], [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in spelt):
            rows.append((0, 0, 0, "")), links.append([])
            continue
        spans = []
        for side in spelt:
            at = 0
            spans.append([(at := at + len(x)) and (at - len(x), at) for x in side])
        groups, low = [], 0
        for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids[k], spans[k], strict=True) if low <= s and e <= end) for k in (0, 1)))
            low = end
        rows.append((len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append([(i, j) for i, (s, e) in zip(ids[0], spans[0], strict=True) for j, (u, v) in zip(ids[1], spans[1], strict=True) if s < v and u < e])
    count, most = collections.Counter(p for x in links for p in set(x)), collections.defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(*r[:3], len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), r[3]) for r, x in zip(rows, links, strict=True)]


def odd_texts():
    rnd, letters = random.Random(3), " \n\t\r\xa0　ab'sé日😀▁<|>0 1.  "
    return [
        None, "", "  two  spaces  ", "a\nb\n\n c", "x\xa0y ▁a ▁▁", "ﬁ ½ é é", "a\tb\0c", "<s> hi </s> <unk> <|endoftext|> x<|endoftext|>", " a", "​   b　 c  \n  d", "日本語 テキスト 😀😀 x",
        "\r\n x {\r\n }\r", "a" * 3000, "ab " * 2000, " ", "▁", " <0x0A> ", "the same", "the same",
    ] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(300)]


def test_equal_to_whole_texts_and_all_pairs(spark, tmp_path):
    texts = odd_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_alignment"](spark, str(tmp_path)).orderBy("doc_id").select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = brute(texts)
    assert [tuple(r) for r in got.collect()] == want and sum(x[0] > 0 for x in want) > 80


def test_counts_beyond_the_bound_are_joined_alike(spark, monkeypatch):
    docs = spark.createDataFrame([("x", "one two tokenizers"), ("x", "one two tokenizers"), (None, None)], "links string, text string").withColumn("n_a", F.lit("kept"))
    aligned = alignment.align(docs, A, B).withColumn("row", F.monotonically_increasing_id())
    counts = alignment.link_counts(aligned)
    want = sorted(map(repr, alignment.scores(aligned, counts).collect()))
    monkeypatch.setattr(alignment, "PAIRS", 1)
    scored = alignment.scores(aligned, counts)
    assert sorted(map(repr, scored.collect())) == want
    assert {r.carried.links for r in scored.collect()} == {"x", None} and {r.carried.n_a for r in scored.collect()} == {"kept"}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op11_alignment"](spark, str(tmp_path)).count() == 0


def test_memory_of_pieces_is_bounded_and_changes_nothing(monkeypatch):
    import pyarrow as pa

    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        files = a.read(), b.read()
    texts = [pa.array([" " + (t or "") for t in odd_texts()[k : k + 40]]) for k in range(0, 320, 40)]
    want = [[c.to_pylist() for c in alignment.Aligner(*files).align(t)] for t in texts]
    monkeypatch.setattr(alignment, "MEMORY", 50)
    small = alignment.Aligner(*files)
    assert [[c.to_pylist() for c in small.align(t)] for t in texts] == want and len(small.keys) <= 50
