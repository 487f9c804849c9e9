"""Pairwise accuracy of a grouping against the truth, from counts of groups rather than of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(labels: DataFrame, found: str = "cluster_id", truth: str = "true_cluster_id") -> DataFrame:
    """(level, found, truth, n): counts by both (level 0), by found (1) and by truth (2), in one aggregate."""
    view = labels.select(F.col(found).alias("found"), F.col(truth).alias("truth"))
    return view.groupingSets([["found", "truth"], ["found"], ["truth"]], "found", "truth").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select("level", "found", "truth", "n")


def pairwise_metrics(labels: DataFrame, found: str = "cluster_id", truth: str = "true_cluster_id") -> DataFrame:
    """One row (precision, recall, f1); zeros if the table is empty or any label is unknown."""
    pairs = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("n") * (F.col("n") - 1) / 2.0)), F.lit(0.0))
    counted = contingency(labels, found, truth).agg(pairs(0).alias("both"), pairs(1).alias("found"), pairs(2).alias("truth"), F.coalesce(F.bool_and((F.col("level") != 0) | (F.col("found").isNotNull() & F.col("truth").isNotNull())), F.lit(False)).alias("whole"))
    precision = F.when(F.col("whole"), F.col("both") / F.greatest("found", F.lit(1.0))).otherwise(0.0)
    recall = F.when(F.col("whole"), F.col("both") / F.greatest("truth", F.lit(1.0))).otherwise(0.0)
    rated = counted.select(precision.alias("precision"), recall.alias("recall"))
    return rated.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))
