"""Accuracy of the linkage on synthetic reports and on reports with injected duplicates.

python -m caseloom.plans.accuracy [--threshold T] [--csv FILE]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.config import REVIEW_WEIGHTS, Linkage
from caseloom.operators.metrics import pairwise_metrics
from caseloom.plans.linkage import link
from caseloom.scratch import save
from caseloom.sources.generate import inject_duplicates, synthetic
from caseloom.sources.reports import read_reports

#: Cases, share of cases with further reports.
COHORTS = ((300, 0.2), (1000, 0.2), (2000, 0.3))
SEEDS = (7, 8, 9)
COLUMNS = "scenario string, mode string, precision double, recall double, f1 double, max_cluster long"


def score(reports: DataFrame, mode: str, threshold: float | None = None) -> dict[str, float]:
    """precision, recall, f1 and max_cluster of one run."""
    run = link(reports, Linkage(mode=mode, threshold=threshold, weights=REVIEW_WEIGHTS if mode == "manual" else {}))
    found = pairwise_metrics(run.clusters).first().asDict()
    return found | {"max_cluster": run.clusters.agg(F.max("cluster_size")).first()[0] or 0}


def table(spark: SparkSession, threshold: float | None = None, csv: str | None = None) -> DataFrame:
    """One row for each scenario and mode."""
    scenarios = [(f"synthetic {n}, {rate:g}", synthetic(spark, n, rate)) for n, rate in COHORTS]
    if csv:
        real = save(read_reports(spark, csv), "reports")
        scenarios += [(f"injected, seed {seed}", inject_duplicates(real, seed=seed)) for seed in SEEDS]
    rows = []
    for name, reports in scenarios:
        kept = save(reports, "scenario")
        for mode in ("auto", "manual"):
            s = score(kept, mode, threshold)
            rows.append((name, mode, s["precision"], s["recall"], s["f1"], s["max_cluster"]))
    return spark.createDataFrame(rows, COLUMNS)


def main() -> None:
    from caseloom.session import session

    parser = argparse.ArgumentParser()
    parser.add_argument("--threshold", type=float)
    parser.add_argument("--csv")
    given = parser.parse_args()
    table(session(), given.threshold, given.csv).show(100, truncate=False)


if __name__ == "__main__":
    main()
