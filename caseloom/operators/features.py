"""Similarities of candidate pairs; unknown is null, and sets that share nothing are exactly 0."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.config import FIELDS, Linkage
from caseloom.operators.blocking import Part
from caseloom.scratch import discard, save

#: Pairs that are compared at once, about.
PIECE = 4_000_000


def single(x: Column) -> Column:
    """Rounded to single precision, as a double."""
    return x.cast("float").cast("double")


def idf(reports: DataFrame, column: str) -> DataFrame:
    """(term, df, weight): log(1 + reports / reports with the term)."""
    n = F.lit(max(reports.count(), 1))
    terms = reports.select(F.explode(F.array_distinct(column)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("weight", F.log1p(n / F.col("df")))


def weighted(reports: DataFrame, column: str, weights: DataFrame | None = None) -> DataFrame:
    """(idx, column_terms, column_total): each report's sorted terms with weights, and their sum; weights: those of `idf`, if they are made already."""
    weights = idf(reports, column) if weights is None else weights
    each = reports.select("idx", F.explode(F.array_distinct(column)).alias("term")).join(weights.select("term", "weight"), "term")
    items = each.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias(f"{column}_terms"))
    return items.withColumn(f"{column}_total", F.aggregate(f"{column}_terms", F.lit(0.0), lambda s, x: s + x["weight"]))


def sides(reports: DataFrame, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row for each report with what comparisons need; the sums are taken before pairs multiply the rows.

    weights: those of drugs and events, for some of the reports that they were counted in.
    """
    known = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    base = reports.select("idx", "report_id", "age", known("sex").alias("sex"), known("seriousness").alias("seriousness"), "report_day")
    for column in ("drugs", "events"):
        base = base.join(weighted(reports, column, weights and weights[column]), "idx", "left")
    return base


def jaccard(a: Column, b: Column) -> Column:
    """Plain Jaccard similarity of two arrays without repeats; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (shared == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _weighted_jaccard(column: str) -> Column:
    mine, others = F.col(f"ri.{column}_terms"), F.transform(f"rj.{column}_terms", lambda x: x["term"])
    shared = F.aggregate(F.filter(mine, lambda x: F.array_contains(others, x["term"])), F.lit(0.0), lambda s, x: s + x["weight"])
    union = F.col(f"ri.{column}_total") + F.col(f"rj.{column}_total") - shared
    return F.coalesce(F.when(shared > 0, shared / union), F.lit(0.0))


def conflict(age_years: float) -> Column:
    """Both ages known and too far apart, or both sexes known and different."""
    apart = F.abs(F.col("ri.age") - F.col("rj.age")) > age_years
    return F.coalesce(apart, F.lit(False)) | F.coalesce(F.col("ri.sex") != F.col("rj.sex"), F.lit(False))


def gather(pairs: DataFrame, reports: DataFrame, side: DataFrame | None = None) -> DataFrame:
    """Pairs with both reports' rows as structs ri and rj; side: the rows of `sides`, if they are made already."""
    side = sides(reports) if side is None else side
    one = side.select(F.col("idx").alias("i_idx"), F.struct(*side.columns).alias("ri"))
    two = side.select(F.col("idx").alias("j_idx"), F.struct(*side.columns).alias("rj"))
    p = pairs.select(F.col("i").alias("i_idx"), F.col("j").alias("j_idx"))
    return p.join(one, "i_idx").join(two, "j_idx")


def compare(pairs: DataFrame, reports: DataFrame, config: Linkage = Linkage(), side: DataFrame | None = None) -> DataFrame:
    """(i, j, report_id_a, report_id_b, the six similarities, conflict) for each pair."""
    match = lambda c: F.when(F.col(f"ri.{c}").isNotNull() & F.col(f"rj.{c}").isNotNull(), (F.col(f"ri.{c}") == F.col(f"rj.{c}")).cast("double"))
    near = lambda gap, width: F.greatest(F.lit(0.0), 1.0 - gap / F.lit(float(width)))
    age = F.when(F.col("ri.age").isNotNull() & F.col("rj.age").isNotNull(), near(F.abs(F.col("ri.age") - F.col("rj.age")), config.max_age_diff))
    values = (age, match("sex"), match("seriousness"), near(F.abs(F.col("ri.report_day") - F.col("rj.report_day")), float(config.max_day_delta)), _weighted_jaccard("drugs"), _weighted_jaccard("events"))
    return gather(pairs, reports, side).select(
        F.col("i_idx").alias("i"),
        F.col("j_idx").alias("j"),
        F.col("ri.report_id").alias("report_id_a"),
        F.col("rj.report_id").alias("report_id_b"),
        *[single(v).alias(n) for n, v in zip(FIELDS, values)],
        conflict(config.age_conflict_years).alias("conflict"),
    )


def pieces(parts: Iterable[Part], reports: DataFrame, config: Linkage = Linkage()) -> Iterator[DataFrame]:
    """The comparisons of all pairs of the parts, in written pieces of about PIECE pairs; a piece goes when the next is asked for.

    A pair takes both reports' rows through a shuffle, so what is shuffled at
    once is bounded by the piece and not by the number of pairs.
    """
    side = save(sides(reports), "sides")
    for part in parts:
        k = max(1, -(-part.pairs.count() // PIECE))
        near = part.near(side, config.max_day_delta)
        near = save(near, "near") if k > 1 else near
        for at in range(k):
            mine = part.pairs if k == 1 else part.pairs.where(F.pmod(F.xxhash64("i"), F.lit(k)) == at)
            piece = save(compare(mine, reports, config, near), "compared")
            yield piece
            discard(piece)
        if k > 1:
            discard(near)
