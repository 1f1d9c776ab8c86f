"""Reading and writing trials and embeddings: raw exports, legacy files, combined files, levels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivium.operators.quality import assign_sample_sets, exclude
from trivium.schema import hash_uniform, held, require, small
from trivium.scratch import materialize
from trivium.sources.csv import data_files, read_csv

#: Columns of a raw export that are used, and trial categories that are kept: fixed values.
RAW_COLUMNS = ("worker_id", "trial_index", "rt", "stimulus", "choices", "response", "trial_category")
CATEGORIES = ("random", "check", "validation")
#: Names that legacy files use, by meaning, in the order in which they are tried: fixed values.
ALIASES = {
    "p_id": ("sessionID", "session_ID", "puid", "Participant.ID", "worker_id", "sub_id", "pid"),
    "Center": ("Center", "Target"),
    "Left": ("Left", "Option1"),
    "Right": ("Right", "Option2"),
    "winner": ("winner", "primary"),
    "loser": ("loser", "alternate"),
    "sampleSet": ("sampleSet", "Alg.Label", "TrnTest"),
    "sampleAlg": ("sampleAlg", "AlgSample"),
}


def process_choices(choices: Column | str, extension: str = ".png") -> Column:
    """The option list without brackets, folders, quotes and every occurrence of the extension."""
    c = F.regexp_replace(choices, r"[\[\]]", "")
    for part in ("assets/stimuli/", "resources/", '"', extension):
        c = F.replace(c, F.lit(part), F.lit("")) if part else c
    return c


def clean_stimulus(stimulus: Column | str, extension: str = ".png") -> Column:
    c = F.col(stimulus) if isinstance(stimulus, str) else stimulus
    for part in ("assets/stimuli/", "resources/", extension):
        c = F.replace(c, F.lit(part), F.lit("")) if part else c
    return c


def split_first(choices: Column | str) -> tuple[Column, Column]:
    """Both sides of the first comma; a missing side is empty, of a null text both are null."""
    c = F.col(choices) if isinstance(choices, str) else choices
    parts = F.split(c, ",", 2)
    return F.get(parts, 0), F.when(c.isNotNull(), F.coalesce(F.get(parts, 1), F.lit("")))


def strsplit1(text: Column | str, pattern: str) -> Column:
    """Array of the parts between matches; one trailing empty part is left out, an empty text has none.

    An empty pattern splits in characters.
    """
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(c, pattern, -1)
    size = F.size(parts)
    trimmed = F.when(F.get(parts, size - 1) == "", F.slice(parts, 1, size - 1)).otherwise(parts)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(trimmed)


def find_column(names: tuple[str, ...], columns: list[str]) -> str | None:
    """The first column that matches the earliest of names, apart from case and punctuation."""
    plain = lambda x: re.sub(r"[^0-9a-z]", "", x.lower())
    for name in names:
        for c in columns:
            if plain(c) == plain(name):
                return c
    return None


def item_levels(d: DataFrame, *columns: str, collation: str | None = None) -> DataFrame:
    """(item_ix, item): the distinct values of the columns, in binary order, numbered from 0.

    collation: a collation of Spark to order them by, such as UNICODE, UNICODE_CI_AI or de; items that it takes for equal stay
    apart, in binary order. The window runs over the distinct items, not over the trials.
    """
    items = d.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("item")).where("item is not null").distinct()
    order = [F.collate("item", collation), F.col("item")] if collation else [F.col("item")]
    return items.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("item_ix"), "item")


def encode(d: DataFrame, levels: DataFrame, **columns: str) -> DataFrame:
    """d with a code for each out=label column; unknown labels give null. levels are broadcast if they are few."""
    table = small(levels)
    for out, label in columns.items():
        key = f"_{out}"
        d = d.join(table.select(F.col("item").alias(key), F.col("item_ix").alias(out)), F.col(label) == F.col(key), "left").drop(key)
    return d


def standardise_raw(
    raw: DataFrame, min_trials: int = 0, min_mean_rt_ms: float = 0, max_prop_wrong: float = 1.0, test_prop: float = 0.1,
    seed: int = 42, stimuli_extension: str = ".png", collation: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trials, levels) of a raw export's rows, after exclusions of workers by number, time and catch trials; levels by collation (item_levels)."""
    f = require(raw, *RAW_COLUMNS).where(F.col("trial_category").isin(*CATEGORIES)).select(*RAW_COLUMNS)
    cleaned = f.withColumns({"choices": process_choices("choices", stimuli_extension), "head": clean_stimulus("stimulus", stimuli_extension)})
    left, right = split_first("choices")
    response = F.expr("try_cast(response as double)")
    pick = lambda a, b: F.when(response == 0, a).when(response.isNotNull(), b)
    named = cleaned.select(
        "worker_id", F.expr("try_cast(trial_index as long)").alias("trial_ix"), F.expr("try_cast(rt as double)").alias("rt"), "head",
        pick(left, right).alias("winner"), pick(right, left).alias("loser"), left.alias("Left"), right.alias("Right"), F.col("trial_category").alias("sampleAlg"))
    kept = exclude(named, min_trials, min_mean_rt_ms, max_prop_wrong)
    levels = held(item_levels(kept, "head", "winner", "loser", collation=collation))  # read four times; one row an item
    labelled = kept.select("trial_ix", "worker_id", "rt", F.col("head").alias("Center"), "Left", "Right", F.col("winner").alias("Answer"), F.col("loser").alias("_lost"), "sampleAlg")
    coded = encode(labelled, levels, head="Center", winner="Answer", loser="_lost").drop("_lost")
    trials = assign_sample_sets(coded, test_prop, seed).select("trial_ix", "head", "winner", "loser", "worker_id", "rt", "Center", "Left", "Right", "Answer", "sampleAlg", "sampleSet")
    return trials, levels.withColumn("path", F.concat(F.lit("resources/"), "item", F.lit(stimuli_extension)))


def read_raw_data(spark: SparkSession, data_dir: str = ".", output_df: str | None = None, output_levels: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(trials, levels) of a folder of raw CSV exports, whose columns may differ; optionally written."""
    trials, levels = standardise_raw(read_csv(spark, data_files(spark, data_dir, ".csv")), **options)
    if output_df:
        write_csv(trials, output_df)
    if output_levels:
        write_csv(levels, output_levels)
    return trials, levels


def numbered(d: DataFrame, order: str, name: str, bounds: int = 200, then: tuple[str, ...] = ()) -> DataFrame:
    """d with the place of each row, from 1, by a column that orders them, and others where it is equal; nulls first.

    Rows are dealt in ranges between bounds that are taken from a bounded number of values, least by hash, and numbered in each
    range behind the rows of the ranges before it; the bounds decide on tasks only.
    """
    c = F.col(f"`{order}`")
    seen = [r[0] for r in d.select(c).where(c.isNotNull()).orderBy(F.xxhash64(c), c).limit(10 * bounds).distinct().orderBy(c).collect()]
    cuts = seen[:: max(1, len(seen) // bounds)]
    place = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= c)) if cuts else F.lit(0)
    dealt = d.withColumn("_range", F.when(c.isNull(), -1).otherwise(place))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(c, *then))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def standardise_legacy(data: DataFrame, order: str | None = None, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(trials, levels) of a legacy table, whose columns are found by alias.

    Without an id column each row is a participant of its own, P1, P2, ..., by the column `order` (or
    as the rows of a file come). A missing sampleSet is dealt 9 to 1 by hash.
    """
    columns = data.columns
    at = {k: find_column(v, columns) for k, v in ALIASES.items()}
    text = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    placed = data.withColumn("_at", F.col(f"`{order}`")) if order else materialize(data.withColumn("_at", F.monotonically_increasing_id()), "placed")
    numbered_ = placed.withColumn("_row", F.col("_at")) if at["p_id"] else numbered(placed, "_at", "_row")
    alg = F.lower(text(at["sampleAlg"]))
    known = F.when(alg == "test", "validation").when(alg.isin("random", "check", "uncertainty"), alg)
    base = numbered_.select(
        "_row", (text(at["p_id"]) if at["p_id"] else F.concat(F.lit("P"), F.col("_row").cast("string"))).alias("p_id"),
        *[text(at[c]).alias(c) for c in ("Center", "Left", "Right")],
        text("Answer" if "Answer" in columns else at["winner"]).alias("Answer"),
        (F.expr("try_cast(RT as double)") if "RT" in columns else F.lit(None).cast("double")).alias("RT"),
        known.alias("sampleAlg"), text(at["sampleSet"]).alias("sampleSet"))
    if not at["sampleSet"]:
        base = base.withColumn("sampleSet", F.when(hash_uniform(2025, "p_id", "_row") < 0.9, "train").otherwise("test"))
    levels = held(item_levels(base, "Center", "Left", "Right", collation=collation))
    other = F.when(F.col("Answer") == F.col("Left"), F.col("Right")).when(F.col("Answer") == F.col("Right"), F.col("Left"))
    coded = encode(base.withColumn("_lost", other), levels, head="Center", winner="Answer", loser="_lost")
    trials = coded.select("p_id", "Center", "Left", "Right", "Answer", "head", "winner", "loser", "RT", "sampleAlg", "sampleSet")
    return trials, levels.select(F.col("item_ix").alias("numeric_value"), F.col("item").alias("stimulus"))


def read_legacy(spark: SparkSession, input_file: str, order: str | None = None, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables of a legacy CSV, or of a folder of its parts; without `order` rows come as they stand in the files."""
    d = read_csv(spark, data_files(spark, input_file), ordered=True)
    placed = d.withColumn("_place", F.shiftleft(F.col("_file").cast("long"), 40) + F.col("_row")).drop("_file", "_row")
    return standardise_legacy(placed, order or "_place", collation)


def write_legacy(trials: DataFrame, levels: DataFrame, input_file: str) -> tuple[str, str]:
    """Write both tables of read_legacy beside the input, named after it without its extension; returns their paths."""
    stem = re.sub(r"\.[^./]+$", "", input_file.rstrip("/"))
    paths = f"{stem}_v2025.csv", f"{stem}_2025_levels.csv"  # fixed values
    write_csv(trials, paths[0])
    write_csv(levels, paths[1], one_file=True)
    return paths


def _ordered(d: DataFrame) -> DataFrame:
    """d with worker_ix, workers numbered from 0 by first appearance; rows without a worker go.

    Rows that get_combined read are ordered by their file (_file) and their place there (_row), others as they come; trial_ix follows that order.
    """
    rows = d.where("worker_id is not null")
    if {"_file", "_row"} <= set(d.columns):
        rows = rows.withColumn("trial_ix", F.shiftleft(F.col("_file").cast("long"), 40) + F.col("_row") - 1).drop("_file", "_row")
    else:
        rows = materialize(rows.withColumn("trial_ix", F.monotonically_increasing_id()), "ordered")  # ids are given once
    first = rows.groupBy("worker_id").agg(F.min("trial_ix").alias("f"))
    ranked = numbered(first, "f", "place").select("worker_id", (F.col("place") - 1).cast("long").alias("worker_ix"))
    return rows.join(held(ranked), "worker_id")


def combined_trials(d: DataFrame) -> DataFrame:
    """Rows of a combined trial table with worker_ix and trial_ix."""
    return _ordered(require(d, "worker_id"))


def combined_embeddings(d: DataFrame) -> DataFrame:
    """(worker_ix, worker_id, item_ix, item, coords): every column whose name holds dim is a coordinate.

    The item is in the column item, or else file or stimulus. Raises if a coordinate is missing.
    """
    item = next((c for c in ("item", "file", "stimulus") if c in d.columns), None)
    dims = [c for c in d.columns if "dim" in c]
    if not item or not dims:
        raise ValueError("an item column and columns named dim are needed")
    coords = F.array(*[F.expr(f"try_cast(`{c}` as double)") for c in dims])
    rows = d if "worker_id" in d.columns else d.withColumn("worker_id", F.lit("group"))
    named = _ordered(rows.select(F.col("worker_id").cast("string").alias("worker_id"), F.col(item).cast("string").alias("item"), coords.alias("coords"), *[c for c in ("_file", "_row") if c in d.columns]))
    checked = named.withColumn("coords", F.when(F.exists("coords", lambda x: x.isNull()), F.raise_error(F.lit("missing coordinate")).cast("array<double>")).otherwise(F.col("coords")))
    place = F.row_number().over(Window.partitionBy("worker_id").orderBy("trial_ix")) - 1
    return checked.select("worker_ix", "worker_id", place.cast("long").alias("item_ix"), "item", "coords")


def get_combined(spark: SparkSession, path: str, embeddings: bool = False) -> DataFrame:
    """A combined CSV, or a folder of its parts, as one long table keyed by worker_id."""
    d = read_csv(spark, data_files(spark, path), ordered=True)
    return combined_embeddings(d) if embeddings else combined_trials(d)


def at_places(d: DataFrame, places: list[int] | range) -> DataFrame:
    """The participants at 1-based places of a combined table (by worker_ix), as a part of a list; a place beyond it gives nothing."""
    ix = F.col("worker_ix") + 1
    if isinstance(places, range) and places.step == 1:
        return require(d, "worker_ix").where(ix.between(places.start, places.stop - 1))
    return require(d, "worker_ix").where(ix.isin(list(places)))


def write_csv(d: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; nulls as NA. one_file gathers all rows in one task, for small results."""
    (d.coalesce(1) if one_file else d).write.mode("overwrite").csv(path, header=True, nullValue="NA", emptyValue="")


def write_table(d: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, optionally in folders by a column."""
    w = d.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)
