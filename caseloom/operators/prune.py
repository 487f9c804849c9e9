"""Pruning of ambiguous edges: an edge stays if it is among the best of both its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.config import FIELDS
from caseloom.operators.features import single


def with_tiebreak(scored: DataFrame) -> DataFrame:
    """Adds the mean of the known similarities in single precision."""
    total, known = F.lit(0.0), F.lit(0)
    for f in FIELDS:
        total = total + F.coalesce(F.col(f), F.lit(0.0))
        known = known + F.col(f).isNotNull().cast("int")
    return scored.withColumn("tiebreak", F.coalesce(single(total / F.nullif(known, F.lit(0))), F.lit(0.0)))


def prune(scored: DataFrame, threshold: float, k: int | None = 2) -> DataFrame:
    """scored (i, j, p, tiebreak, ...) with p = 0 and pruned = true on edges at or above threshold that are not among
    the k best of both ends.  Order: p, then tiebreak, both falling, then (i, j).  Nothing is pruned for no or non-positive k.

    Only edges at or above the threshold are ranked, so ranks shuffle those alone.
    """
    if not k or k <= 0:
        return scored.withColumn("pruned", F.lit(False))
    strong = scored.where(F.col("p") >= threshold).select("i", "j", "p", "tiebreak")
    ends = strong.withColumn("node", F.explode(F.array("i", "j")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("p"), F.desc("tiebreak"), "i", "j"))
    lost = ends.withColumn("rank", rank).where(F.col("rank") > k).select("i", "j").distinct().withColumn("lost", F.lit(True))
    joined = scored.join(lost, ["i", "j"], "left").withColumn("pruned", F.coalesce("lost", F.lit(False))).drop("lost")
    return joined.withColumn("p", F.when(F.col("pruned"), 0.0).otherwise(F.col("p")))


def pruned_per_report(pruned: DataFrame) -> DataFrame:
    """(idx, ambiguous_matches_pruned): pruned edges of each report that has some."""
    return pruned.where("pruned").select(F.explode(F.array("i", "j")).alias("idx")).groupBy("idx").agg(F.count("*").alias("ambiguous_matches_pruned"))
