"""Secret scans with corpus-wide ownership frequency (operator 3), with DataFrame functions only.

Three fixed kinds (assign, access, hex) are found in every whole text. Beside them, long tokens
that mix letters and digits are candidates. The values of both are hashed and counted over the
corpus: distinct owners (sources) and distinct documents. A value that at most MAX_OWNERS owners and at most MAX_DOCUMENTS
documents hold is live; any other is a widely copied example, be it by many owners or many times by one. Live candidates
are reported as spans of kind owned, copied ones aren't; the spans of the fixed kinds always stay.

Spans are 0-based code points, the end exclusive. Spark has no function for the positions of all
matches, so the lengths of the matches and of the gaps between them are summed up.

Defined results: a null or empty text has no spans; repeated rows each give a row, and count once for
ownership within a document; rows that share a doc_id are one document, rows without one are told apart by their text;
rows with a null source belong to one unnamed owner; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.llm.store import materialize
from trivium.llm.text import hash128, prefix_sums, whole

#: The three kinds of the contract, in their order: fixed values. {24,} and {16,} give what + and a length test would.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A candidate of the method: a long token; it must also hold a digit, both cases and few repeats.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
MAX_OWNERS, MAX_DOCUMENTS = 2, 10


def _spans(text: str, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, value) of the leftmost matches that don't overlap."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(value_group)) if value_group else found
    # gap, match, gap, match ...: split keeps every gap with the limit -1
    steps = F.zip_with(
        F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g).cast("long")),
        F.transform(found, lambda m: F.length(m).cast("long")), lambda g, m: F.coalesce(g, F.lit(0)) + F.coalesce(m, F.lit(0)),
    )
    size = F.size(found)
    before = prefix_sums(F.slice(steps, 1, size))
    gaps = F.split(F.col(text), pattern, -1)
    spans = F.transform(F.arrays_zip(before.alias("b"), F.slice(gaps, 1, size).alias("g"), found.alias("m"), value.alias("v")), lambda x: F.struct(
        (x["b"] + F.length(x["g"])).alias("start"), F.lit(kind).alias("kind"),
        (x["b"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["v"].alias("value")))
    spans = F.filter(spans, lambda s: F.length(s["value"]) >= least) if least else spans
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return F.when(F.col(text).rlike(pattern), spans).otherwise(none)


def _looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & (distinct >= 10)


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, owner, row, base, candidates): the spans of each row; row tells rows of one doc_id apart."""
    texts = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), whole("text").alias("text"))
    kinds = texts.select(
        "doc_id", "owner", F.xxhash64("text").alias("row"),
        _spans("text", ASSIGN, 0, value_group=2, least=6).alias("assign"), _spans("text", ACCESS, 1).alias("access"),
        _spans("text", HEX, 2).alias("hex"), _spans("text", CANDIDATE, 3).alias("more"),
    )
    based = kinds.select("doc_id", "owner", "row", F.sort_array(F.concat("assign", "access", "hex")).alias("base"), "more")
    apart = F.filter("more", lambda c: _looks_live(c["value"]) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return based.select("doc_id", "owner", "row", "base", apart.alias("candidates"))


def ownership(scanned: DataFrame) -> DataFrame:
    """(h1, h2, owners, documents): distinct owners and documents of every value in base or candidates of scan().

    Spark counts distinct values in two exchanges, by value and holder first, so a value that everyone holds is no hot key.
    """
    values = F.array_distinct(F.transform(F.concat("base", "candidates"), lambda s: s["value"]))
    document = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(5), "row")).otherwise(F.xxhash64("doc_id"))
    each = scanned.select(F.xxhash64("owner").alias("owner"), document.alias("document"), F.explode(values).alias("value"))
    h1, h2 = hash128(F.col("value"))
    return each.groupBy(h1.alias("h1"), h2.alias("h2")).agg(F.count_distinct("owner").alias("owners"), F.count_distinct("document").alias("documents"))


def find_secrets(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(doc_id, base, spans, n_live, n_copied): base spans, all spans, and the numbers of spans whose values are live and copied."""
    scanned = materialize(scan(docs, owner), "scanned_secrets")
    found = ownership(scanned)
    each = scanned.select("doc_id", "row", F.explode(F.array_distinct(F.concat("base", "candidates"))).alias("span"))
    h1, h2 = hash128(F.col("span.value"))
    live = (F.col("owners") <= max_owners) & (F.col("documents") <= max_documents)
    owned = (
        each.withColumns({"h1": h1, "h2": h2}).join(materialize(found, "ownership"), ["h1", "h2"])
        .groupBy("doc_id", "row").agg(
            F.collect_set(F.when((F.col("span.kind") == 3) & live, F.col("span"))).alias("owned"),
            F.collect_set(F.when(live, F.struct("span.start", "span.kind"))).alias("live"),
            F.collect_set(F.when(~live, F.struct("span.start", "span.kind"))).alias("copied"),
        ).withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    )
    both = scanned.drop("owner", "candidates").join(owned, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return both.select(
        "doc_id", "base", F.sort_array(F.concat("base", F.coalesce("owned", F.slice("base", 1, 0)))).alias("spans"),
        count("live").alias("n_live"), count("copied").alias("n_copied"),
    )


def digests(found: DataFrame) -> DataFrame:
    kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", kind(0), kind(1), kind(2), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )
