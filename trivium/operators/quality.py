"""Participant quality control: exclusions, trial labels, train/test split, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.schema import hash_uniform, held, require


def _null_safe(d: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return d.join(ids.select(F.col("worker_id").alias("_id")), F.col("worker_id").eqNullSafe(F.col("_id")), how)


def _mean_rt() -> Column:
    rt = F.expr("try_cast(rt as double)")
    return F.avg(F.when(~F.isnan(rt), rt))


def _fast_enough(mean: str, min_mean_rt_ms: float) -> Column:
    return (F.col(mean) >= float(min_mean_rt_ms)) & (F.col(mean) >= 0)


def _catch() -> list[Column]:
    """Wrong, right and unknown answers to catch trials."""
    wrong, right = F.col("head") == F.col("loser"), F.col("head") == F.col("winner")
    return [F.sum(wrong.cast("int")).alias("wrong"), F.sum(right.cast("int")).alias("right"), F.count_if(wrong.isNull() | right.isNull()).alias("unknown")]


def _failed(max_prop_wrong: float) -> Column:
    answers = F.col("wrong") + F.col("right")
    return (F.col("unknown") == 0) & (answers > 0) & (F.col("wrong") / F.nullif(answers, F.lit(0)) > float(max_prop_wrong))


def filter_incomplete(d: DataFrame, min_trials: int = 510) -> DataFrame:
    """Trials of workers with at least min_trials rows; rows without a worker go at any threshold."""
    enough = require(d, "worker_id").groupBy("worker_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_trials)
    return d.join(enough.select("worker_id"), "worker_id", "left_semi")


def filter_fast_responders(d: DataFrame, min_mean_rt_ms: float = 1000) -> DataFrame:
    """Trials of workers whose mean response time is at least min_mean_rt_ms.

    Times that aren't numbers are left out; a worker without any, or with a negative mean, goes. Rows
    without a worker form a group of their own.
    """
    slow = require(d, "worker_id", "rt").groupBy("worker_id").agg(_mean_rt().alias("m")).where(_fast_enough("m", min_mean_rt_ms))
    return _null_safe(d, slow, "left_semi")


def filter_failed_catch(d: DataFrame, max_prop_wrong: float = 0.2) -> DataFrame:
    """Trials of workers whose share of wrong catch answers isn't above max_prop_wrong.

    A catch trial is one whose head is an option. Workers without any, or with a null among their
    codes, stay.
    """
    by = require(d, "worker_id", "head", "winner", "loser").groupBy("worker_id").agg(*_catch())
    return _null_safe(d, by.where(_failed(max_prop_wrong)), "left_anti")


def exclude(d: DataFrame, min_trials: int, min_mean_rt_ms: float, max_prop_wrong: float) -> DataFrame:
    """Trials of the workers that filter_incomplete, filter_fast_responders and filter_failed_catch all keep.

    Each rule keeps or drops whole workers, so one aggregation by worker decides on all three. Rows without a worker go.
    """
    by = require(d, "worker_id", "rt", "head", "winner", "loser").where("worker_id is not null").groupBy("worker_id").agg(
        F.count("*").alias("n"), _mean_rt().alias("m"), *_catch())
    good = by.where((F.col("n") >= min_trials) & _fast_enough("m", min_mean_rt_ms) & ~F.coalesce(_failed(max_prop_wrong), F.lit(False)))
    return d.join(held(good.select("worker_id")), "worker_id", "left_semi")


def assign_sample_alg(d: DataFrame) -> DataFrame:
    """sampleAlg: check if the head is an option, else validation if so marked, else random."""
    require(d, "head", "winner", "loser", "validation")
    check = (F.col("head") == F.col("winner")) | (F.col("head") == F.col("loser"))
    return d.withColumn("sampleAlg", F.when(check, "check").when(F.col("validation"), "validation").otherwise("random"))


def assign_sample_sets(d: DataFrame, test_prop: float = 0.2, seed: int = 42) -> DataFrame:
    """sampleSet: null for check trials, test for about test_prop of the random ones, else train."""
    require(d, "worker_id", "trial_ix", "sampleAlg")
    test = (F.col("sampleAlg") == "random") & (hash_uniform(seed, "worker_id", "trial_ix") <= test_prop)
    return d.withColumn("sampleSet", F.when(F.col("sampleAlg") == "check", F.lit(None).cast("string")).when(test, "test").otherwise("train"))


def participant_summary(
    d: DataFrame, trial_range: tuple[int, int] | None = None, mintrial: int = 1000, accthresh: float = 0.8, rtthresh: float = 0
) -> DataFrame:
    """(tripfile, worker_id, ndat, lrt, cacc, keep) for each worker.

    lrt: mean log seconds, without negative or missing times; -Infinity if a time is 0. cacc: share
    right of at least two check trials, null where an answer or label is missing. keep is false
    at a threshold or below it, and null if only an unknown cacc decides. trial_range: first
    and last row of each worker, 1-based, by trial_ix.
    """
    require(d, "worker_id", "rt", "sampleAlg", "Answer", "Center")
    if trial_range:
        place = F.row_number().over(Window.partitionBy("worker_id").orderBy(require(d, "trial_ix")["trial_ix"]))
        d = d.withColumn("_place", place).where(F.col("_place").between(*trial_range)).drop("_place")
    rt, check = F.col("rt").cast("double"), F.col("sampleAlg") == "check"
    equal = F.col("Answer") == F.col("Center")
    by = d.groupBy("worker_id").agg(
        F.count("*").alias("ndat"), F.count_if(rt == 0).alias("zero"), F.avg(F.when(rt > 0, F.ln(rt / 1000))).alias("mean"),
        F.count_if(check).alias("checks"), F.avg(F.when(check, equal.cast("double"))).alias("acc"),
        F.count_if((check & equal.isNull()) | F.col("sampleAlg").isNull()).alias("unknown"))
    lrt = F.when(F.col("zero") > 0, F.lit(float("-inf"))).otherwise(F.col("mean"))
    cacc = F.when((F.col("checks") > 1) & (F.col("unknown") == 0), F.col("acc"))
    rows = by.select(F.col("worker_id").alias("tripfile"), "worker_id", "ndat", lrt.alias("lrt"), cacc.alias("cacc"))
    return rows.withColumn("keep", ~((F.col("cacc") <= float(accthresh)) | (F.col("lrt") <= float(rtthresh)) | (F.col("ndat") < mintrial)))
