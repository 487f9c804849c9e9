"""Linkage of reports as they arrive: each micro-batch is compared with itself and with all stored reports.

Reports and their postings are stored as Parquet under a folder; a batch writes
its own subfolders, replaced if the batch is run again, so a restart repeats
nothing.  A batch makes postings of its own reports only, and of the stored ones
takes those under its keys; rarity weights are counted over all reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseloom.config import FIELDS, Linkage
from caseloom.operators.blocking import KEY, all_postings, block_pairs
from caseloom.operators.em import PRIORS, Model, score
from caseloom.operators.features import compare
from caseloom.plans.linkage import demographic_veto
from caseloom.scratch import save
from caseloom.sources.reports import SCHEMA

#: What a stored posting holds.
POSTING = "h1 bigint, h2 bigint, bucket bigint, idx bigint, day bigint"


def link_batch(batch: DataFrame, batch_id: int, store: str, config: Linkage = Linkage(), model: Model = PRIORS) -> DataFrame:
    """Scored pairs at or above the threshold with at least one report of the batch; the batch is added to the store."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{store}/reports/batch={batch_id}")
    everything = spark.read.schema(f"{SCHEMA}, batch bigint").parquet(f"{store}/reports").where(F.col("batch") <= batch_id)
    fresh = everything.where(F.col("batch") == batch_id).select("idx")
    reports = everything.drop("batch")
    all_postings(spark.read.schema(SCHEMA).parquet(f"{store}/reports/batch={batch_id}"), config.max_day_delta).write.mode("overwrite").parquet(f"{store}/postings/batch={batch_id}")
    posts = spark.read.schema(f"{POSTING}, batch bigint").parquet(f"{store}/postings").where(F.col("batch") <= batch_id)
    touched = posts.where(F.col("batch") == batch_id).select(*KEY).distinct()
    near = save(posts.drop("batch").join(touched, KEY, "left_semi"), "near")
    pairs = block_pairs(near, config.max_block_size, config.max_day_delta).select("i", "j").distinct()
    new = pairs.join(fresh.select(F.col("idx").alias("i"), F.lit(True).alias("a")), "i", "left").join(fresh.select(F.col("idx").alias("j"), F.lit(True).alias("b")), "j", "left")
    compared = compare(new.where("a or b").select("i", "j"), reports, config)
    found = demographic_veto(score(compared, config, model))
    return found.where(F.col("p") >= config.cut).select("report_id_a", "report_id_b", F.col("p").alias("match_probability"), *FIELDS)


def start(reports: DataFrame, store: str, sink: str, checkpoint: str, config: Linkage = Linkage(), model: Model = PRIORS) -> StreamingQuery:
    """Runs link_batch on every micro-batch of a stream of reports and writes the pairs under sink."""

    def one(batch: DataFrame, batch_id: int) -> None:
        link_batch(batch, batch_id, store, config, model).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return reports.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).start()
