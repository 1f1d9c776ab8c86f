"""Quality rules (operator 10), with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word windows in each whole text. The
verdict beyond them is a log-likelihood ratio: texts are cut in words and runs of punctuation, their
one- and two-token n-grams hashed into buckets, and two multinomials fitted: one over the corpus (all
documents) and one over trusted target documents. A document's score is the mean over its n-grams of
log(target / corpus); it is kept if the score is at least a threshold.

Only the target and the threshold are fitted on bounded samples: the at most TRUSTED doc_ids each, least by hash, of labels with
quality 1 and not toxic, and of labels with quality 0. A fifth of both, by hash, is held out; the others that are good make the
target. The threshold is where the held-out documents that pass the base rules are told apart best: the share of
poor ones below it less that of good ones below it is greatest, in the middle of the widest gap of scores where that is so; without
documents of both kinds it is THRESHOLD. Corpus counts cover every document. The model is one row of BUCKETS doubles
(bounded), broadcast.

Defined results: a null or empty text has no words and fails the base rules; without trusted documents the
ratio is 0 for every n-gram, so all documents that pass the base rules are kept; repeated rows are
each counted and returned; an empty table gives an empty table; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.llm.store import materialize
from trivium.llm.text import WHITE, WORD, let, once, unused, whole

BUCKETS, TRUSTED, THRESHOLD = 1 << 14, 50_000, -0.35
SYMBOL = r"[#*$%&|<>]"
#: Words, and runs of other visible characters.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"
OWN = {"word_chars", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"}


def repeated_words(hashes: Column) -> Column:
    """Words within three-word windows that occur twice or more, from the array of the words' hashes."""
    windows = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def again(ordered: Column) -> Column:
        """Positions of windows whose neighbour in the sorted order is equal."""
        found = F.transform(ordered, lambda w, k: F.when((w["h"] == F.get(ordered, k - 1)["h"]) | (w["h"] == F.get(ordered, k + 1)["h"]), w["i"]))
        return F.sort_array(F.array_compact(found))

    def covered(w: Column) -> Column:
        return F.aggregate(
            let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), again),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    # without two equal windows, as in most texts, the sort is spared
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts and base_failed."""
    body = whole(text)
    words = F.transform(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    name = unused(docs, "_q_words")
    counted = once(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OWN]), **{
        name: let(words, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).alias("n_repeat_words"))),
        "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }).select("*", f"{name}.*").drop(name)
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def buckets(text: Column, count: int = BUCKETS) -> Column:
    """Buckets of the one- and two-token n-grams of a text."""

    def grams(h: Column) -> Column:
        one = F.transform(h, lambda x: F.pmod(x, F.lit(count)).cast("int"))
        two = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(count)).cast("int"))
        return F.concat(one, two)

    return let(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)), grams)


def sample(labels: DataFrame, condition: str, most: int) -> DataFrame:
    """(doc_id): at most so many, least by hash, of the labels that meet a condition."""
    return labels.where(condition).where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def held_out(doc_id: Column) -> Column:
    """Whether a labelled document is one of the fifth that the target isn't fitted on."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("held:"), doc_id.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(5)) == 0


GOOD, POOR = "quality = 1 and toxic = 0", "quality = 0"


def score_of(text: Column, ratio: Column, count: int = BUCKETS) -> Column:
    """Mean of log(target / corpus) over a text's n-grams; 0 without any."""
    return let(buckets(text, count), lambda grams: F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(ratio, g)) / F.greatest(F.size(grams), F.lit(1)))


def fit(docs: DataFrame, trusted: DataFrame, text: str = "text", count: int = BUCKETS) -> DataFrame:
    """One row: key 0 and ratio, array of log(target / corpus) by bucket, each smoothed by adding one. trusted(doc_id): a bounded sample."""
    good = trusted.select(F.col("doc_id").alias("_good"))
    texts = docs.select("doc_id", whole(text).alias("_t")).join(F.broadcast(good), F.col("doc_id") == F.col("_good"), "left")
    each = texts.select(F.col("_good").isNotNull().alias("good"), F.explode(buckets(F.col("_t"), count)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("all"), F.count_if("good").alias("target"))
    slots = docs.sparkSession.range(count).select(F.col("id").cast("int").alias("bucket"))
    full = slots.join(counts, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("all", "target")])
    row = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "all", "target"))).alias("c"), F.sum("all").alias("a"), F.sum("target").alias("t"))
    ratio = F.transform("c", lambda x: F.when(F.col("t") > 0, F.ln((x["target"] + 1) / (F.col("t") + count)) - F.ln((x["all"] + 1) / (F.col("a") + count))).otherwise(0.0))
    return materialize(row.select(F.lit(0).cast("long").alias("key"), ratio.alias("ratio")), "quality_model")


def best_cut(scores: DataFrame) -> DataFrame:
    """One row (threshold) of scores(score, good) of held-out documents, a bounded sample: null without both kinds."""
    order, every = Window.orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    share = lambda c: F.count_if(c).over(order) / F.nullif(F.count_if(c).over(every), F.lit(0))
    told = scores.select("score", (share(~F.col("good")) - share(F.col("good"))).alias("told")).distinct()
    cuts = told.withColumn("next", F.lead("score").over(Window.orderBy("score"))).where("told is not null and next is not null")
    return cuts.agg(F.max_by((F.col("score") + F.col("next")) / 2, F.struct(F.round("told", 12).alias("told"), F.col("next") - F.col("score"))).alias("threshold"))


def fit_threshold(docs: DataFrame, model: DataFrame, good: DataFrame, poor: DataFrame, text: str = "text", count: int = BUCKETS) -> float:
    """The threshold that tells the held-out documents of good(doc_id) and poor(doc_id) apart; a single number reaches the driver."""
    kinds = good.select(F.col("doc_id").alias("_held"), F.lit(True).alias("_kind")).unionByName(poor.select(F.col("doc_id").alias("_held"), F.lit(False).alias("_kind")))
    texts = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(kinds), F.col("doc_id") == F.col("_held")).select("doc_id", "_kind", "text")
    passed = base_counts(texts).where(~F.col("base_failed")).select("doc_id", "_kind", "text", F.pmod("n_words", F.lit(1)).alias("_q_key"))
    met = passed.join(F.broadcast(model.select(F.col("key").alias("_q_key"), F.col("ratio").alias("_q_ratio"))), "_q_key")
    scores = met.groupBy("doc_id", F.col("_kind").alias("good")).agg(F.avg(score_of(whole("text"), F.col("_q_ratio"), count)).alias("score"))
    found = best_cut(materialize(scores, "held_out_scores")).first()[0]
    return THRESHOLD if found is None else found


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float | None = None, count: int = BUCKETS, trusted: int = TRUSTED) -> DataFrame:
    """docs with the base counts, base_failed, score and kept. threshold: fitted on held-out labels unless it is given."""
    good = materialize(sample(labels, GOOD, trusted), "good_labels")
    target = good.where(~held_out(F.col("doc_id"))) if threshold is None else good
    fitted = fit(docs, target, text, count)
    if threshold is None:
        apart = held_out(F.col("doc_id"))
        threshold = fit_threshold(docs, fitted, good.where(apart), sample(labels, POOR, trusted).where(apart), text, count)
    key, ratio = unused(docs, "_q_key"), unused(docs, "_q_ratio")
    model = fitted.select(F.col("key").alias(key), F.col("ratio").alias(ratio))
    met = base_counts(docs, text).withColumn(key, F.pmod("n_words", F.lit(1))).join(F.broadcast(model), key, "left")  # one row of a fixed size
    scored = once(met, score=score_of(whole(text), F.col(ratio), count)).drop(key, ratio)
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True)))
