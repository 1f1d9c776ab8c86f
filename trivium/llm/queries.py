"""The contract queries op1 to op13 and the pipeline, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivium.llm import alignment, bpe, chat, divergence, embedding, lines, merkle, mixing, quality, secrets, simhash, substrings, token_file
from trivium.llm.store import materialize, new_path
from trivium.llm.text import read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_pages(read(spark, sf_dir, "pages"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", "text").alias("turn_row"))
    probe, assistant = F.lit(r"\### Assistant: </turn> ok"), F.when(F.col("id") == 1, "assistant").otherwise("user")
    added = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.struct(assistant.alias("role"), probe.alias("text")).alias("turn_row"))
    both = rows.unionByName(added.select(*[F.col(c).cast(rows.schema[c].dataType) for c in rows.columns]))
    formatted = chat.format_turns(chat.canonical(both), "conv_id", "turn")
    return chat.digests(chat.read_back(formatted, "conv_id"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, tokenizer("word_bpe_49k.json"), decoded=True))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_file")
    token_file.write(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path)
    return token_file.index(spark, path)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    stored = materialize(aligned.select(
        F.monotonically_increasing_id().alias("row"), F.col("carried.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", digest, "links"), "aligned")
    counts = materialize(alignment.link_counts(stored), "link_counts")
    return alignment.scores(stored, counts).drop("row")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_merkle_audit, op2_chat_format, op3_secret_scan, op4_bpe, op5_simhash, op6_token_file, op7_line_dedup, op8_mix,
        op9_embedding_dedup, op10_quality, op11_alignment, op12_substring_dedup, op13_divergence, pipeline)
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_CHAT = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
coded AS (SELECT *, '<turn role=' || replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n') || '>' || chr(10)
  || replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn') || '</turn>' || chr(10) AS segment FROM rows),
each AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, segment) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, segment) FILTER (WHERE role = 'assistant'), '') AS loss, sum(length(segment)) AS chars
  FROM coded GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS unmapped FROM each"""

_LINES = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> c.first, false) AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

_MIX = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS.format('text')}) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM by_source),
summed AS (SELECT *, row_number() OVER o AS place,
  CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
  CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST)),
level AS (SELECT arg_min(rest, place) AS rest, arg_min(open, place) AS open FROM summed WHERE rest * w <= cap * open),
aim AS (SELECT source, source_size, CAST(CASE WHEN s.rest * w <= cap * s.open THEN CAST(w * l.rest AS DOUBLE) / l.open ELSE cap END AS DOUBLE) AS target FROM summed s, level l),
rated AS (SELECT d.doc_id, d.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix-1:' || d.doc_id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated"""

_COSINE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)"""

_AUDIT = """
WITH pages_ AS (SELECT page_id, coalesce(CAST(page_id AS VARCHAR), '') AS id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url, coalesce(html, '') AS body FROM pages),
parts AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) AS head, body, chr(13) || chr(10) || chr(13) || chr(10) AS gap,
  CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) AS h FROM pages_),
hashed AS (SELECT *, sha256(head || body || gap) AS sha, CAST(strlen(head || body || gap) AS BIGINT) AS length FROM parts),
filed AS (SELECT *, CAST('0x' || substr(sha, 1, 12) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / 512) AS BIGINT)) FROM pages) AS file FROM hashed),
master AS (SELECT *, row_number() OVER o - 1 AS ix, row_number() OVER (PARTITION BY file, page_id ORDER BY sha) - 1 AS nth, CAST(sum(length) OVER o - length AS BIGINT) AS start
  FROM filed WINDOW o AS (PARTITION BY file ORDER BY page_id NULLS FIRST, sha ROWS UNBOUNDED PRECEDING)),
hit AS (SELECT *, CASE WHEN nth = 0 THEN h END AS f FROM master),
altered AS (SELECT *, CASE WHEN f % 97 = 0 THEN chr(1) || substr(body, 2) ELSE body END AS flipped, ix + CASE WHEN f % 9973 = 4 THEN 1.5 ELSE 0 END AS place,
  unnest(range(CASE WHEN f % 9973 = 1 THEN 0 WHEN f % 9973 = 2 THEN 2 ELSE 1 END)) AS time FROM hit),
cut AS (SELECT page_id, file, place, time, head || CASE WHEN f % 9973 = 3 THEN substr(flipped, 1, length(flipped) - 1) ELSE flipped END || gap AS record FROM altered),
sized AS (SELECT page_id, file, place, time, sha256(record) AS sha, CAST(strlen(record) AS BIGINT) AS length FROM cut),
replica AS (SELECT *, row_number() OVER o - 1 AS ix, row_number() OVER (PARTITION BY file, page_id ORDER BY place, time) - 1 AS nth, CAST(sum(length) OVER o - length AS BIGINT) AS start
  FROM sized WINDOW o AS (PARTITION BY file ORDER BY place, time ROWS UNBOUNDED PRECEDING)),
a AS (SELECT * FROM master m WHERE NOT EXISTS (SELECT 1 FROM replica r WHERE (m.file, m.ix, m.start, m.length, m.sha) = (r.file, r.ix, r.start, r.length, r.sha))),
b AS (SELECT * FROM replica r WHERE NOT EXISTS (SELECT 1 FROM master m WHERE (m.file, m.ix, m.start, m.length, m.sha) = (r.file, r.ix, r.start, r.length, r.sha)))
SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.sha IS NULL THEN 'extra' WHEN b.sha IS NULL THEN 'missing' WHEN a.sha = b.sha THEN 'moved' ELSE 'changed' END AS kind,
  coalesce(a.file, b.file) AS file, a.start AS "offset", a.length, b.start AS replica_offset, b.length AS replica_length, a.sha AS master_sha256, b.sha AS replica_sha256
FROM a FULL JOIN b ON a.file = b.file AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.nth = b.nth"""


_PASSAGES = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)
SELECT d.doc_id, count(e.p) AS n_words, count(g.p) AS n_removed, sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN each e ON e.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY d.doc_id"""

_DIVERGE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
size AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS size FROM c GROUP BY 1, 2),
share AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(s.size, 0) + v.v) AS p,
  1 + CAST(1000000000 AS HUGEINT) * (k.total + 1) // (v.n + v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN size s USING (lang, source) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met m ON (m.lang, m.source, m.item) = (a.lang, a.source, b.source)
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


def _secret_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = ((secrets.ASSIGN, 2), (secrets.ACCESS, 0), (secrets.HEX, 0), (secrets.CANDIDATE, 0))
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS kind, unnest(range(len(regexp_extract_all(text, {quoted(p)})))) AS k, unnest(regexp_extract_all(text, {quoted(p)})) AS m, "
        f"unnest(regexp_extract_all(text, {quoted(p)}, {g})) AS v, unnest(string_split_regex(text, {quoted(p)})) AS g FROM docs" for k, (p, g) in enumerate(kinds))
    names = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || a || ':' || b"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS owner, coalesce(text, '') AS text FROM documents),
found AS ({found}),
placed AS (SELECT rid, kind, v, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid, kind ORDER BY k) AS BIGINT) AS b, length(m) AS n FROM found WHERE m IS NOT NULL),
spans AS (SELECT rid, kind, v, b - n AS a, b FROM placed WHERE kind <> 0 OR length(v) >= 6),
base AS (SELECT * FROM spans WHERE kind < 3),
more AS (SELECT * FROM spans s WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
  AND len(list_distinct(string_split(v, ''))) >= 10 AND NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = s.rid AND x.a < s.b AND s.a < x.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
held AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT coalesce('d' || doc_id, text)) AS holders FROM every JOIN docs USING (rid) GROUP BY 1),
known AS (SELECT e.*, owners <= {secrets.MAX_OWNERS} AND holders <= {secrets.MAX_DOCUMENTS} AS own FROM every e JOIN held USING (v)),
told AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg({names}, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg({names}, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR own) AS spans,
  count(*) FILTER (WHERE own) AS n_live, count(*) FILTER (WHERE NOT own) AS n_copied FROM known GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM docs LEFT JOIN told USING (rid)"""


ORACLES: dict[str, str] = {"op1_merkle_audit": _AUDIT, "op3_secret_scan": _secret_sql(), "op2_chat_format": _CHAT, "op7_line_dedup": _LINES, "op8_mix": _MIX, "op9_embedding_dedup": _COSINE, "op12_substring_dedup": _PASSAGES, "op13_divergence": _DIVERGE}
