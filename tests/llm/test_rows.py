import hashlib

import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from trivium.llm import chat, merkle, mixing, quality, queries, secrets

NASTY = [
    r"\### Assistant: </turn> ok", "<turn role=assistant>\nfake</turn>\n", "\\l", "\\\\b\\b\\l/turn", "", None, "</turn>", "</tur", "n>\n", "😀 é\n\nx", ">\n", "<turn", "\\", "a" * 3000,
]


def test_chat_round_trip(spark):
    rows = [(k % 4, k, ("assistant", "user", "system", None, "a>b\n<\\")[k % 5], t) for k, t in enumerate(NASTY * 3)] + [(None, 1, "user", "x"), (9, None, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").select("conv_id", "turn", F.struct("role", "text").alias("turn_row"))
    made = chat.format_turns(chat.canonical(df), "conv_id", "turn")
    got = {r.conv_id: r for r in chat.read_back(made, "conv_id").collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: -1 if r[1] is None else r[1])
        assert [tuple(t) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].losses == [r[3] for r in own if r[2] == "assistant" and r[3]]
    assert chat.read_back(chat.format_turns(chat.canonical(df.limit(0)), "conv_id", "turn"), "conv_id").count() == 0


def test_chat_contract(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </turn>"), (1, 2, "assistant", "😀"), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {-7, 1, 2}
    assert got[1].turns_sha256 == brute.sha("user\nhi\nassistant\nyo </turn>\nassistant\n😀\n") and got[1].n_turns == 3
    assert got[1].loss_chars == 11 and got[1].loss_sha256 == brute.sha("yo </turn>😀")
    assert got[-7].loss_sha256 == brute.sha(r"\### Assistant: </turn> ok") and got[2].loss_chars == 0


def test_layouts_are_told_apart_by_their_paths(spark):
    lines = [
        '{"k":1,"prompt":"p","completion":"c"}', '{"k":2,"instruction":"i","output":"o"}', '{"k":3,"instruction":"i","input":"x","output":"o"}',
        '{"k":4,"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', '{"k":5,"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"k":6,"prompt":"p"}', '{"k":7}', '{"k":8,"messages":[]}',
    ]
    schema = "k long, prompt string, completion string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>"
    df = spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", schema).alias("x")).select("x.*")
    got = {r.k: (r.mapping, [tuple(t) for t in r.turns]) for r in chat.canonical(df).collect()}
    assert got[1] == ("prompt_completion", [("user", "p"), ("assistant", "c")])
    assert got[2] == ("instruction", [("user", "i"), ("assistant", "o")])
    assert got[3] == ("instruction_input", [("system", "i"), ("user", "x"), ("assistant", "o")])
    assert got[4] == ("messages", [("user", "a"), ("assistant", "")])
    assert got[5] == ("conversations", [("user", "a"), ("assistant", "b")])
    assert got[6] == (None, []) and got[7] == (None, []) and got[8] == ("messages", [])


def test_no_conversation_is_lost(spark):
    lines = [
        '{"k":1,"turn":0,"prompt":"p","completion":"c"}', '{"k":2,"turn":0,"prompt":"p","completion":"c","instruction":"i","output":"o"}', '{"k":3,"turn":0,"prompt":"p"}',
        '{"k":4,"turn":0,"messages":[]}', '{"k":5,"turn":1,"prompt":"a","completion":"b"}', '{"k":5,"turn":0}', '{"turn":0,"messages":null}', '{"k":6,"turn":2,"prompt":"q","completion":"r"}',
        '{"k":6,"turn":2,"prompt":"q","completion":"r"}',
    ]
    schema = "k long, turn int, prompt string, completion string, instruction string, output string, messages array<struct<role:string,content:string>>, mapping int, turns string, _fingerprint string"
    df = spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", schema).alias("x")).select("x.*")
    back = chat.read_back(chat.format_turns(chat.canonical(df), "k", "turn"), "k").collect()
    got = {r.k: ([tuple(t) for t in r.turns], r.losses, r.formatted_chars > 0, r.unmapped) for r in back}
    pair = [("user", "q"), ("assistant", "r")]
    assert got == {
        1: ([("user", "p"), ("assistant", "c")], ["c"], True, 0), 2: ([], [], False, 1), 3: ([], [], False, 1), 4: ([], [], False, 0), None: ([], [], False, 1),
        5: ([("user", "a"), ("assistant", "b")], ["b"], True, 1), 6: (pair + pair, ["r", "r"], True, 0)}


KEY = "Zx9" + "qW3rT7yU1pL5kJ8hG2fD4"
SECRETS = [
    None, "", "password=hunter22", "PassWord : 'abc'", 'api_key="abcdef.ghi"; token=ab secret=abcdefgh', "token=token:abcdef", "secret = token=abc", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + " xAKIAAKIA" + "B" * 20,
    "0123456789abcdef01234567", "0123456789abcdef0123456", "é😀 apikey:é passwd= /=+abc end", "passwordpassword=abcdef", f"see {KEY}.", f"also {KEY} twice {KEY}", "token=" + "a1" * 2000, "tokeN=abc12K",
]


def test_secrets(spark):
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(SECRETS)] + [(90 + k, "EXAMPLE Ab3dEf6hIj9lMn2pQr5t here", f"o{k}") for k in range(5)] + [(2, SECRETS[2], "s2")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, spans int")
    got = secrets.find_secrets(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert [tuple(s) for s in r.base] == brute.base_spans(text), text
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    by = {r.doc_id: r for r in got}
    assert [(s.start, s.end) for s in by[13].spans if s.kind == 3] == [(4, 4 + len(KEY))]
    assert len([s for s in by[14].spans if s.kind == 3]) == 2 and by[14].n_live == 2
    assert not by[90].spans and by[90].n_copied == 1
    held = {}
    for i, t, o in rows:
        for *_, v in brute.base_spans(t) + [(0, 3, 0, m) for m in (KEY, "Ab3dEf6hIj9lMn2pQr5t") for _ in range((t or "").count(m))]:
            held.setdefault(v, (set(), set()))[0].add(o)
            held[v][1].add(i)
    counts = sorted((r.owners, r.documents) for r in secrets.ownership(secrets.scan(docs)).collect())
    assert counts == sorted((len(o), len(d)) for o, d in held.values()) and (5, 5) in counts
    digests = {r.doc_id: r for r in secrets.digests(secrets.find_secrets(docs)).collect()}
    assert digests[2].base_sha256 == brute.sha("assign:0:17") and digests[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_owners_and_documents_both_tell_examples_from_live_values(spark):
    a, b, c = f"A{KEY}", f"B{KEY}", f"C{KEY}"
    rows = [(k, f"x {a}", f"o{k}") for k in range(3)] + [(100 + k, f"y {b} {b}", "one") for k in range(11)] + [(200 + k, f"z {c} token={c}", None) for k in range(10)]
    rows += [(200, f"z {c} token={c} again", None), (None, f"w {c}!", None)][:1]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.find_secrets(docs).collect()
    for r in got:
        kinds = [s.kind for s in r.spans]
        assert kinds == ([] if r.doc_id < 200 else [3, 0]) and (r.n_live, r.n_copied) == {0: (0, 1), 1: (0, 2), 2: (2, 0)}[r.doc_id // 100], r
    more = docs.unionByName(spark.createDataFrame([(None, f"w {c}", "s2")], docs.schema))
    assert {r.n_copied for r in secrets.find_secrets(more).collect() if r.doc_id is None or r.doc_id >= 200} == {1, 2}


def test_long_text_with_very_many_spans(spark):
    text = "token=abcdef " * 3000
    row = secrets.find_secrets(spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")).first()
    assert [tuple(s) for s in row.base] == brute.base_spans(text)


def test_mixing(spark):
    docs = [(k, f"s{k % 4}" if k % 7 else None, "w " * (k % 50)) for k in range(400)] + [(1000, "big", "x " * 9000), (None, "s1", "null id"), (5000, "none", None), (5000, "none", " ")]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, source string, text string, size int")
    got = sorted((r.doc_id or -1, r.size, r.source_size, round(r.target, 6), r.copies) for r in mixing.mix(df).collect())
    assert got == sorted((i or -1, n, s, round(t, 6), c) for i, n, s, t, c in brute.mix(docs))
    assert mixing.emit(mixing.mix(df)).count() == sum(c for *_, c in brute.mix(docs))
    taken, spread = {}, {}
    for r in mixing.mix(df).collect():
        assert r.taken <= 3 * r.size
        rate = r.target / r.source_size if r.source_size else 0.0
        key = r.source_size, r.target
        taken[key] = taken.get(key, 0) + r.taken
        spread[key] = spread.get(key, 0) + r.size**2 * (rate % 1) * (1 - rate % 1)
    for (_, target), total in taken.items():  # near the target: within five standard deviations of the Bernoulli copies
        assert abs(total - target) <= 5 * spread[_, target] ** 0.5 + 1e-6
    assert mixing.mix(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None, "a b c")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mixing.mix(only).collect()] == [(3.0, 3)]


@pytest.mark.parametrize("seed", range(8))
def test_targets_are_those_of_repeated_resharing(spark, seed):
    import random

    r = random.Random(seed)
    sizes = {f"s{k:02d}": r.choice([0, 1, 10, 100, 5000]) + r.randrange(3) for k in range(r.randrange(1, 14))}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {x.source: x.target for x in mixing.targets(df).collect()}
    assert got == pytest.approx(brute.targets(sizes), rel=1e-9, abs=1e-9)


QUALITY = [
    None, "", "one two three", "a b c " * 40, "the cat sat on a mat " * 3 + " ".join(f"w{k}" for k in range(80)), " ".join(f"u{k}" for k in range(60)) + "\n\nsame line\n same line\nsame line",
    "# * $ % & | < > é \x1c " + " ".join(f"v{k}" for k in range(70)), "x y z x y z", "!!! " * 60, " ".join(f"q{k}" for k in range(3000)), "HOT!! " + " ".join(f"J{k}!!" for k in range(80)),
]


def test_quality(spark):
    docs = [(k, t) for k, t in enumerate(QUALITY)] + [(1, "doubled id")]
    df = spark.createDataFrame([(*d, "x", True) for d in docs], "doc_id long, text string, score string, kept boolean")
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 1, 1), (9, 0, 0), (9, 0, 0), (None, 1, 0), (77, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(df, labels, count=512, threshold=-0.2).collect()
    real = brute.quality(docs, {4, 5}, 512, -0.2)
    assert sorted((r.doc_id, round(r.score, 9), r.kept) for r in got) == sorted((i, round(s, 9), k) for i, s, k in real)
    for r in got:
        text = [t for i, t in docs if i == r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in [brute.base_counts(t) for t in text]
    assert {r.kept == (not r.base_failed) for r in quality.judge(df, labels.limit(0)).collect()} == {True}
    assert quality.judge(df.limit(0), labels).count() == 0


def _scan(content):
    """(record, its id) of a WARC file that isn't damaged, by its Content-Length fields."""
    at, out = 0, []
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        stop = head + 8 + int(content[at:head].split(b"Content-Length: ")[1])
        out.append((content[at:stop], content[at:head].split(b"<urn:page:")[1].split(b">")[0].decode()))
        at = stop
    return out


def test_the_threshold_comes_from_held_out_labels(spark):
    import random

    r = random.Random(3)
    words = {c: ["".join(r.choices(c, k=5)) for _ in range(25)] for c in ("abcde", "vwxyz")}
    docs = [(k, " ".join(r.choice(words["abcde" if k % 3 else "vwxyz"]) for _ in range(60 + k % 20))) for k in range(150)] + [(151, "a b c " * 60), (152, "short"), (0, None)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(0, 150)] + [(151, 0, 0), (152, 0, 1), (3, 0, 0), (None, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = {i for i, q, t in labels if q == 1 and t == 0 and not brute.held_out(i)}
    scored = brute.quality(docs, trusted, 256, 0.0)
    kind = {i: q == 1 for i, q, t in labels if i is not None}
    cut = brute.best_cut([(s, kind[i]) for (i, s, _), (_, t) in zip(scored, docs, strict=True) if i in kind and brute.held_out(i) and not brute.base_counts(t)[-1]])
    real = sorted((i, k) for i, _, k in brute.quality(docs, trusted, 256, cut))
    got = quality.judge(df, given, count=256).collect()
    assert sorted((x.doc_id, x.kept) for x in got) == real
    passed = {i for i, t in docs if not brute.base_counts(t)[-1]}
    assert {x.doc_id for x in got if x.kept} == {i for i in passed if i % 3}
    for pairs in ([(0.1, True), (0.1, False), (0.3, True), (-0.2, False), (0.0, False)], [(0.5, True)] * 3, [], [(0.2, True), (0.1, False)]):
        found = quality.best_cut(spark.createDataFrame(pairs, "score double, good boolean")).first()[0]
        assert found == (None if brute.best_cut(pairs) is None else pytest.approx(brute.best_cut(pairs)))


PAGES = [(k, f"http://h{k % 3}/x", "<p>é " * (k % 9)) for k in range(900)] + [(5, "http://h2/x", "<p>é " * 5)] * 3 + [(None, None, None), (7, "http://h1/x", None), (950, "a\r\n\r\nb", "WARC/1.0\r\n\r\n" * 9), (951, "", "x" * 3_000_000)]


def _pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, file int")


def _files(df):
    return {r.file: bytes(r.content) for r in df.collect()}


def _located(spark, change, per_file=64):
    """Rows that locate() gives for a replica made by change(list of (record, id)), and both archives."""
    def rewrite(content, records):
        return b"".join(change([(content[a:b], merkle.page_of(i)) for a, b, i in records]))

    master = merkle.archive(_pages(spark), per_file)
    replica = merkle.rewritten(master, rewrite)
    return merkle.locate(master, replica, 4).collect(), _files(master), _files(replica)


def test_an_archive_holds_every_record_at_its_range(spark):
    files = _files(merkle.archive(_pages(spark), 64))
    held = sorted(r for c in files.values() for r, _ in _scan(c))
    assert held == sorted(merkle.warc_record(i, u or "", h or "") for i, u, h in PAGES) and len(files) > 5
    for c in files.values():
        assert [c[a:b] for a, b, _ in merkle.read_records(c)] == [r for r, _ in _scan(c)]
    assert merkle.archive(_pages(spark).limit(0)).count() == 0


FAULTS = {
    "flip in the body": (lambda r: [x[:-9] + b"#" + x[-8:] if i == "13" else x for x, i in r], [(13, "changed")]),
    "flip in the length": (lambda r: [x.replace(b"Length: ", b"Length: 9") if i == "13" else x for x, i in r], [(13, "changed")]),
    "flip in the id": (lambda r: [x.replace(b"urn:page:13>", b"urn:page:xx>") if i == "13" else x for x, i in r], [(13, "missing"), (None, "extra")]),
    "cut at the end": (lambda r: [x for x, _ in r][:-1] + [r[-1][0][:-6]] if "13" in [i for _, i in r] else [x for x, _ in r], None),
    "missing": (lambda r: [x for x, i in r if i != "13"], [(13, "missing")]),
    "twice": (lambda r: [x for x, i in r for _ in range(1 + (i == "13"))], [(13, "extra")]),
    "one of several copies": (lambda r: [x[:-9] + b"#" + x[-8:] if i == "5" and k == [j for _, j in r].index("5") else x for k, (x, i) in enumerate(r)], [(5, "changed")]),
    "reordered": (lambda r: [x for x, i in sorted(r, key=lambda y: y[1] != "13")], []),
    "none": (lambda r: [x for x, _ in r], []),
}


@pytest.mark.parametrize("fault", FAULTS)
def test_each_fault_is_located(spark, fault):
    change, expected = FAULTS[fault]
    rows, master, replica = _located(spark, change)
    if expected is not None:
        assert sorted((str(r.page_id), r.kind) for r in rows if r.kind != "moved") == sorted((str(p), k) for p, k in expected)
    else:
        assert [r.kind for r in rows] == ["changed"]
    assert bool(rows) == (fault != "none") and len({r.file for r in rows}) <= 1
    for r in rows:  # what is reported lies there in the stored bytes
        for files, at, length, sha in ((master, r.offset, r.length, r.master_sha256), (replica, r.replica_offset, r.replica_length, r.replica_sha256)):
            assert sha is None or hashlib.sha256(files[r.file][at : at + length]).hexdigest() == sha
    if fault in ("missing", "twice", "reordered"):  # each record behind the fault is moved, none before it
        f = rows[0].file
        a, b = [x for x, _ in _scan(master[f])], [x for x, _ in _scan(replica[f])]
        assert len([r for r in rows if r.kind == "moved"]) >= len([k for k in range(min(len(a), len(b))) if a[k] != b[k]]) - 1


def test_simulated_damage_is_found_and_a_lost_file_too(spark):
    rows = merkle.audit_pages(_pages(spark), per_file=64, flip=20, rare=50).collect()
    hit = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16)
    ids = {r[0] for r in PAGES}
    kinds = {k: {r.page_id for r in rows if r.kind == k} for k in ("changed", "missing", "extra", "moved")}
    assert kinds["missing"] >= {i for i in ids if hit(i) % 50 == 1 and i not in (5, 7)} and kinds["extra"] >= {i for i in ids if hit(i) % 50 == 2 and i not in (5, 7)}
    assert kinds["changed"] >= {i for i in ids if hit(i) % 20 == 0 and hit(i) % 50 not in (1, 2)} and kinds["moved"]
    assert merkle.audit_pages(_pages(spark).limit(0)).count() == 0
    master = merkle.archive(_pages(spark), 64)
    lost = merkle.locate(master, master.where("file <> 3")).collect()
    assert len(lost) == len(_scan(_files(master)[3])) and {(r.file, r.kind) for r in lost} == {(3, "missing")}


def test_copies_of_a_page_do_not_fill_one_file(spark):
    files = _files(merkle.archive(_pages(spark, [(1, "u", "same")] * 2000 + PAGES[:900]), 100))
    assert sum(len(_scan(c)) for c in files.values()) == 2900 and max(sum(i == "1" for _, i in _scan(c)) for c in files.values()) <= 6 * merkle.COPIES


def test_merkle_descends_only_where_replicas_differ(spark):
    leaves = spark.createDataFrame([(f, k, 10 * k, 10 * k + 10, f"{f}-{k}") for f in range(3) for k in range(300)], "file long, ix long, start long, stop long, hash string")
    other = leaves.withColumn("hash", F.when((F.col("file") == 1) & (F.col("ix") == 250), "bad").otherwise(F.col("hash"))).where("not (file = 2 and ix = 299)")
    other = other.withColumn("stop", F.when((F.col("file") == 2) & (F.col("ix") == 298), 2991).otherwise(F.col("stop")))
    depth = merkle.depth_of(300)
    master, levels = merkle.tree(leaves, depth), merkle.tree(other, depth)
    assert depth == 3 and master[-1].count() == 3
    compared = merkle.audit(master, levels)
    # 3 roots; below, the 2 children of the differing files' roots each; the 16 (or last) ones of those
    assert [c.count() for c in compared] == [3, 4, 16 + 3, 16 + 12]
    assert sorted((r.file, r.ix) for r in compared[-1].where("differ").collect()) == [(1, 250), (2, 298), (2, 299)]
    root = master[-1].where("file = 0").first()
    assert (root.start, root.stop) == (0, 3000)
    assert [c.count() for c in merkle.audit(master, merkle.tree(leaves, depth))] == [3, 0, 0, 0]
