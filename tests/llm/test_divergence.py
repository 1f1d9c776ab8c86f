import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from trivium.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def reference(rows, least=3, top=200):
    """rows: (text, lang, source); the audit in Python's whole numbers."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang or "", source or "", TERM.findall((text or "").translate(low))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in found}:
        docs = collections.Counter(t for x in found if x[0] == lang for t in set(x[2]))
        kept = {t for t, n in docs.items() if n >= least}
        counts = {s: collections.Counter(t for x in found if x[:2] == (lang, s) for t in x[2] if t in kept) for s in {x[1] for x in found if x[0] == lang}}
        every = sum(counts.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in counts[s] if p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(items)]
    return sorted(out)


def rows(sources):
    rnd = random.Random(7)
    words = [f"{a}{b}" for a in "abcdeé日Ω" for b in ("x", "Y", "zz", "q", "")]
    out = [(None, None, None), ("", "en", ""), ("1 2 3", "en", "src1"), ("alone once", "xx", "s"), ("B1b_b é\x00É", "en", "src2")]
    for _ in range(250):
        own = rnd.randrange(sources)
        text = " ".join(rnd.choice(words[own % 20 :] + [f"only{chr(97 + own % 26)}{chr(97 + own // 26)}"]) for _ in range(rnd.randint(0, 30)))
        out.append((text, rnd.choice(["en", "de", None]), rnd.choice([f"src{own}", "hot", None])))
    return out


@pytest.mark.parametrize(("sources", "block", "tile", "most"), [(4, 64, 4096, 1000), (40, 64, 4096, 1000), (40, 5, 7, 2)])
def test_equal_to_the_definition(spark, monkeypatch, sources, block, tile, most):
    for name, value in (("BLOCK", block), ("TILE", tile), ("MOST", most)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(rows(sources), "text string, lang string, source string").repartition(3).withColumns({"g": F.lit(1), "term": F.lit(2)})
    for top in (200, 3):
        got = divergence.audit(docs, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in got.collect()) == reference(rows(sources), top=top)


def test_language_without_kept_terms_and_empty_table(spark):
    few = [("a b", "en", "x"), ("c", "en", "y"), (None, "en", "z")]
    got = divergence.audit(spark.createDataFrame(few, "text string, lang string, source string")).collect()
    assert sorted(tuple(r) for r in got) == reference(few) and {r.value for r in got} == {0} and len(got) == 6
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_long_text_is_counted_in_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 10)
    text = "Überall élan x1y " * 50 + "end"
    assert [t for part in divergence.terms(text) for t in part] == [t.lower().replace("Ü".lower(), "Ü").encode() for t in TERM.findall(text)]


def test_shares_beyond_a_long_product():
    import numpy as np

    for n, size in ((10**13, 3 * 10**14 + 1), (0, 7), (5, 6), (10**12 - 1, 10**12)):
        assert divergence.shares(np.array([n]), size)[0] == 1 + 10**9 * (n + 1) // size
