"""Comparing participants by their prediction matrix (judge_id, model_id, acc)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivium.schema import require, small


def _others(column: str = "acc"):
    return F.when(F.col("judge_id") != F.col("model_id"), F.col(column))


def _own(column: str = "acc"):
    return F.max(F.when(F.col("judge_id") == F.col("model_id"), F.col(column)))


def z_pred_mat(pred: DataFrame, check_square: bool = False) -> DataFrame:
    """(judge_id, z): how far a judge's own model stands out from the others on their trials, in sample deviations.

    Null for fewer than two others or a deviation of 0. check_square: raise if a judge lacks a model.
    """
    require(pred, "judge_id", "model_id", "acc")
    if check_square:
        a, b, n = pred.agg(F.countDistinct("judge_id"), F.countDistinct("model_id"), F.count("*")).first()
        if a != b or a * b != n:
            raise ValueError("the prediction matrix must be square")
    z = (_own() - F.avg(_others())) / F.nullif(F.stddev_samp(_others()), F.lit(0.0))
    return pred.groupBy("judge_id").agg(z.alias("z"))


def diag_offdiag(pred: DataFrame) -> DataFrame:
    """One row: mean accuracy of own models, of others, and the share of judges whose own is above the others' mean."""
    each = pred.groupBy("judge_id").agg(_own().alias("own"), F.avg(_others()).alias("others"))
    means = pred.agg(F.avg(F.when(F.col("judge_id") == F.col("model_id"), F.col("acc"))).alias("diag"), F.avg(_others()).alias("offdiag"))
    share = each.agg(F.avg((F.col("own") > F.col("others")).cast("double")).alias("share_above"))
    return means.join(share, F.lit(True))


def _clustered(pred: DataFrame, clusters: DataFrame, strict: bool) -> DataFrame:
    own = clusters.select("worker_id", F.col("cluster").cast("int").alias("cluster"))
    if strict and not pred.select("judge_id").distinct().join(own, F.col("judge_id") == F.col("worker_id"), "left_anti").isEmpty():
        raise ValueError("every participant needs a cluster")
    own = small(own)
    a = own.select(F.col("worker_id").alias("judge_id"), F.col("cluster").alias("judge_cluster"))
    b = own.select(F.col("worker_id").alias("model_id"), F.col("cluster").alias("model_cluster"))
    return pred.join(a, "judge_id").join(b, "model_id")


def pacc_samediff(pred: DataFrame, clusters: DataFrame, strict: bool = True) -> DataFrame:
    """(judge_id, self, same, other): accuracy of the own model, and mean accuracy of others' within and outside the cluster."""
    same = F.col("judge_cluster") == F.col("model_cluster")
    return _clustered(pred, clusters, strict).groupBy("judge_id").agg(
        _own().alias("self"), F.avg(F.when(same, _others())).alias("same"), F.avg(F.when(~same, _others())).alias("other"))


def pacc_by_cluster(pred: DataFrame, clusters: DataFrame, strict: bool = True) -> DataFrame:
    """(judge_id, cluster, self, acc): mean accuracy of the other members of each cluster; null for a cluster of the judge alone."""
    met = _clustered(pred, clusters, strict)
    per = met.groupBy("judge_id", F.col("model_cluster").alias("cluster")).agg(F.avg(_others()).alias("acc"))
    own = met.groupBy("judge_id").agg(_own().alias("self"))
    return per.join(own, "judge_id").select("judge_id", "cluster", "self", "acc")


def _mean(total, models):
    """The mean accuracy of so many models that have total hits of n trials each."""
    return total / F.nullif(F.col("n") * models, F.lit(0))


def _judges(moments: DataFrame) -> DataFrame:
    """(judge_id, n, models, total, squares, own): moments over all clusters."""
    require(moments, "judge_id", "n", "models", "total", "squares", "own")
    return moments.groupBy("judge_id").agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in ("models", "total", "squares")], F.max("own").alias("own"))


def z_of_moments(moments: DataFrame) -> DataFrame:
    """z_pred_mat from predict.prediction_moments; the deviation comes of whole numbers."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    spread = (wide("models") * wide("squares") - wide("total") * wide("total")).cast("double")  # models * (models - 1) * variance of the hits
    deviation = F.sqrt(spread / F.nullif(F.col("models") * (F.col("models") - 1), F.lit(0))) / F.col("n")
    z = (F.col("own") / F.col("n") - _mean(F.col("total"), F.col("models"))) / F.nullif(deviation, F.lit(0.0))
    return _judges(moments).select("judge_id", z.alias("z"))


def diag_offdiag_of_moments(moments: DataFrame) -> DataFrame:
    """diag_offdiag from predict.prediction_moments."""
    own, others = F.col("own") / F.col("n"), _mean(F.col("total"), F.col("models"))
    return _judges(moments).agg(F.avg(own).alias("diag"), (F.sum(F.col("total") / F.col("n")) / F.nullif(F.sum("models"), F.lit(0))).alias("offdiag"), F.avg((own > others).cast("double")).alias("share_above"))


def _of_clusters(moments: DataFrame, clusters: DataFrame, strict: bool) -> DataFrame:
    own = clusters.select(F.col("worker_id").alias("judge_id"), F.col("cluster").cast("int").alias("judge_cluster"))
    if strict and not moments.join(own, "judge_id", "left_anti").isEmpty():
        raise ValueError("every participant needs a cluster")
    return moments.join(small(own), "judge_id")


def samediff_of_moments(moments: DataFrame, clusters: DataFrame, strict: bool = True) -> DataFrame:
    """pacc_samediff from predict.prediction_moments of the same clusters."""
    same, total = F.col("judge_cluster") == F.col("cluster"), lambda is_, c: F.sum(F.when(is_, F.col(c)))
    each = _of_clusters(moments, clusters, strict).groupBy("judge_id").agg(
        F.max("n").alias("n"), F.max("own").alias("own"), *[total(is_, c).alias(f"{name}_{c}") for name, is_ in (("same", same), ("other", ~same)) for c in ("total", "models")])
    return each.select("judge_id", (F.col("own") / F.col("n")).alias("self"), *[_mean(F.col(f"{x}_total"), F.col(f"{x}_models")).alias(x) for x in ("same", "other")])


def by_cluster_of_moments(moments: DataFrame, clusters: DataFrame, strict: bool = True) -> DataFrame:
    """pacc_by_cluster from predict.prediction_moments of the same clusters."""
    met = _of_clusters(moments, clusters, strict)
    own = met.groupBy("judge_id").agg(F.max(F.col("own") / F.col("n")).alias("self"))
    return met.join(own, "judge_id").select("judge_id", "cluster", "self", _mean(F.col("total"), F.col("models")).alias("acc"))
