"""Review of a run: groups, members, decisions and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.config import LABELS


def with_details(clusters: DataFrame, reports: DataFrame) -> DataFrame:
    """Clusters with the reports' fields beside."""
    from caseloom.sources.reports import display_shape

    return clusters.join(display_shape(reports), "report_id", "left")


def duplicates(clusters: DataFrame) -> DataFrame:
    return clusters.where("is_candidate_duplicate")


def group_list(clusters: DataFrame) -> DataFrame:
    """(cluster_id, n_reports, position, previous, next): the groups in order, with neighbours around the ends.

    Groups are ordered within ranges of ids; only a row for each range goes through one task.
    """
    each = duplicates(clusters).groupBy("cluster_id").agg(F.count("report_id").alias("n_reports")).withColumn("range", F.floor(F.col("cluster_id") / (1 << 20)))
    ends = each.groupBy("range").agg(F.count("*").alias("n"), F.min("cluster_id").alias("first"), F.max("cluster_id").alias("last"))
    order, whole = Window.orderBy("range"), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range",
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("left"),
        F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("right"),
    )
    inner = Window.partitionBy("range").orderBy("cluster_id")
    placed = each.withColumns({"rank": F.row_number().over(inner), "lag": F.lag("cluster_id").over(inner), "lead": F.lead("cluster_id").over(inner)})
    return placed.join(ends, "range").select("cluster_id", "n_reports", (F.col("before") + F.col("rank")).alias("position"), F.coalesce("lag", "left").alias("previous"), F.coalesce("lead", "right").alias("next"))


def members(detailed: DataFrame, cluster_id: int | Column) -> DataFrame:
    """A group's reports, the earliest first."""
    return detailed.where(F.col("cluster_id") == cluster_id).orderBy("report_day", "report_id")


def keep_earliest(detailed: DataFrame) -> DataFrame:
    """(report_id, keep) for all groups of more than one: the earliest report stays."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("report_day", "report_id"))
    return duplicates(detailed).select("report_id", (rank == 1).alias("keep"))


def keep_all(clusters: DataFrame) -> DataFrame:
    """(report_id, keep): every report stays."""
    return clusters.select("report_id", F.lit(True).alias("keep"))


def decided(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clusters with keep; reports without a decision are kept."""
    return clusters.join(decisions.select("report_id", "keep"), "report_id", "left").withColumn("keep", F.coalesce("keep", F.lit(True)))


def decision_log(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clusters with decision (Keep, Remove) and reviewer_decision (KEEP, REMOVE_DUPLICATE)."""
    both = decided(clusters, decisions)
    return both.withColumn("decision", F.when(F.col("keep"), "Keep").otherwise("Remove")).withColumn("reviewer_decision", F.when(F.col("keep"), "KEEP").otherwise("REMOVE_DUPLICATE")).drop("keep")


def cleaned(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of the reports that stay."""
    return clusters.join(decisions.where(~F.col("keep")).select("report_id").distinct(), "report_id", "left_anti")


def pairs_in_groups(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Scored pairs whose reports are in one group, with its id."""
    side = duplicates(clusters).select("report_id", "cluster_id")
    a = side.select(F.col("report_id").alias("report_id_a"), "cluster_id")
    b = side.select(F.col("report_id").alias("report_id_b"), F.col("cluster_id").alias("other"))
    return pairs.join(a, "report_id_a").join(b, "report_id_b").where("cluster_id = other").drop("other")


def labelled(pairs: DataFrame) -> DataFrame:
    """Pairs with column names for people."""
    return pairs.withColumnsRenamed({"report_id_a": "Report A", "report_id_b": "Report B", "match_probability": "Match score", **LABELS})


def summary(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: reports, groups, reports in groups, removals, largest group, reports with pruned matches."""
    return decided(clusters, decisions).agg(
        F.count("*").alias("n_reports"),
        F.count_distinct(F.when(F.col("is_candidate_duplicate"), F.col("cluster_id"))).alias("n_groups"),
        F.count_if("is_candidate_duplicate").alias("n_in_groups"),
        F.count_if(~F.col("keep")).alias("n_removed"),
        F.max("cluster_size").alias("max_cluster"),
        F.count_if(F.col("ambiguous_matches_pruned") > 0).alias("n_crowded"),
    )


def weight_scale(weights: DataFrame) -> DataFrame:
    """(field, weight, top): learned weights for display by a label each, with the end of their scale, which is 1 at least."""
    top = weights.agg(F.greatest(F.max("weight"), F.lit(1.0)).alias("top"))  # one row
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("field")), F.col("field"))
    return weights.select(label.alias("field"), F.round("weight", 2).alias("weight")).join(F.broadcast(top.select(F.round("top", 2).alias("top"))))


def shown_metrics(metrics: DataFrame) -> DataFrame:
    """Precision, recall and F1 as text: with two digits for a page, with three, right-aligned, for a table."""
    two = [F.format_string("%.2f", F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
    line = F.format_string("%9.3f %7.3f %6.3f", "precision", "recall", "f1")
    return metrics.select(*two, line.alias("line"))


def shown_groups(groups: DataFrame) -> DataFrame:
    """(cluster_id, caption) of a group list: place among all groups and size, numbers with separators."""
    n = groups.agg(F.count("*").alias("n"))  # one row
    caption = F.concat_ws(" ", F.lit("Group"), F.format_number("position", 0), F.lit("of"), F.format_number("n", 0), F.lit("with"), F.format_number("n_reports", 0), F.lit("reports"))
    return groups.join(F.broadcast(n)).select("cluster_id", caption.alias("caption"))
