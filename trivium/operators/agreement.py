"""Agreement on shared validation triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.schema import held, require


def triplet_key(center: str = "Center", left: str = "Left", right: str = "Right") -> Column:
    """center_first_second without spaces, the two options sorted; one missing option gives the other twice."""
    c, a, b = (F.replace(F.col(x), F.lit(" "), F.lit("")) for x in (center, left, right))
    return F.concat(F.coalesce(c, F.lit("NA")), F.lit("_"), F.least(a, b), F.lit("_"), F.greatest(a, b))


def make_tripnames(d: DataFrame) -> DataFrame:
    """d with its column triplet."""
    return require(d, "Center", "Left", "Right").withColumn("triplet", triplet_key())


def last_answers(d: DataFrame) -> DataFrame:
    """(worker_id, triplet, Answer): each worker's last answer to each validation triplet, by trial_ix."""
    require(d, "worker_id", "trial_ix", "Answer", "sampleAlg")
    shared = make_tripnames(d.where(F.col("sampleAlg") == "validation"))
    return shared.groupBy("worker_id", "triplet").agg(F.max_by("Answer", "trial_ix").alias("Answer"))


def majority(d: DataFrame, strict: bool = False) -> DataFrame:
    """(triplet, majority, pmaj): the commonest last answer, the first by name on a tie, and its share.

    A triplet without any answer has nulls. strict: raise if there are no validation trials.
    """
    answers = last_answers(d)
    if strict and answers.isEmpty():
        raise ValueError("no validation trials")
    counts = answers.groupBy("triplet", "Answer").agg(F.count("Answer").alias("n"))
    best = F.row_number().over(Window.partitionBy("triplet").orderBy(F.col("n").desc(), F.col("Answer").asc_nulls_last()))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("triplet"))
    ranked = counts.select("triplet", "Answer", F.when(F.col("n") > 0, share).alias("pmaj"), best.alias("r"))
    return ranked.where("r = 1").select("triplet", F.col("Answer").alias("majority"), "pmaj")


def by_subject(d: DataFrame) -> DataFrame:
    """(worker_id, triplet, agree): agreement of every worker with the majority, null where they have no answer.

    The grid has a row for every worker and validation triplet, as the task asks for; the triplets
    of a study are few and are broadcast after a count.
    """
    answers, best = last_answers(d), majority(d)
    grid = d.select("worker_id").where("worker_id is not null").distinct().join(held(best), F.lit(True))
    agree = (F.col("Answer") == F.col("majority")).cast("int")
    return grid.join(answers, ["worker_id", "triplet"], "left").select("worker_id", "triplet", agree.alias("agree"))


def worker_agreement(d: DataFrame) -> DataFrame:
    """(worker_id, agreement, n): mean agreement of each worker over the triplets they answered."""
    met = last_answers(d).join(held(majority(d)), "triplet").where("worker_id is not null and Answer is not null")
    return met.groupBy("worker_id").agg(F.avg((F.col("Answer") == F.col("majority")).cast("double")).alias("agreement"), F.count("*").alias("n"))


def make_vmat(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(majority, bysbj), as two long tables."""
    return majority(d, strict=True), by_subject(d)
