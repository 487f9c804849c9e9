"""Reports derived from order tables, to run the engine on data without drug names.

An order is a case; some orders have copies (1, 2 or 6), which are the true
duplicates.  Only integer arithmetic on keys decides, so any engine can derive
the same reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COPY_STEP = 10_000_000


def _copies(key: str) -> Column:
    k = F.col(key)
    return F.when(k % 500 == 0, 6).when(k % 30 == 0, 2).when(k % 10 == 0, 1).otherwise(0)


def reports_from_orders(spark: SparkSession, sf_dir: str, density: str = "rare") -> DataFrame:
    """Reports; density rare, medium or dense says how many orders share a term."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    drug = {"rare": F.col("p_partkey"), "medium": F.concat("p_name", "p_brand"), "dense": F.col("p_name")}[density]
    kind = F.concat("p_type", F.col("p_size").cast("string"))
    event = {"rare": F.concat(kind, F.lit("-"), (F.col("l_suppkey") % 50).cast("string")), "medium": kind, "dense": F.col("p_brand")}[density]
    terms = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(drug)).alias("d"), F.sort_array(F.collect_set(event)).alias("e"))
    people = read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = read("orders").join(people.hint("shuffle_hash"), "o_custkey", "left").join(terms, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = orders.withColumn("k", F.explode(F.sequence(F.lit(0), _copies("o_orderkey"))))
    key, k = F.col("o_orderkey"), F.col("k")

    def shown(c: str) -> Column:
        own = F.when((k % 2 == 1) & (F.size(c) > 1), F.slice(c, 2, 100_000)).otherwise(F.col(c))
        return F.coalesce(F.sort_array(own.cast("array<string>")), F.array().cast("array<string>"))

    return rows.select(
        (key + COPY_STEP * k).cast("bigint").alias("idx"),
        (key + COPY_STEP * k).cast("string").alias("report_id"),
        F.when(~((key % 23 == 0) | ((k > 0) & (key % 70 == 0))), (18 + (F.col("o_custkey") * 7) % 67 + k % 2).cast("double")).alias("age"),
        F.when(key % 25 != 0, F.when(F.col("c_nationkey") % 2 == 0, "Male").otherwise("Female")).alias("sex"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "Serious").otherwise("Non-serious").alias("seriousness"),
        (F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) + 7 * k).cast("bigint").alias("report_day"),
        shown("d").alias("drugs"),
        shown("e").alias("events"),
        key.cast("bigint").alias("true_cluster_id"),
    )
