"""The whole run: reports -> groups, scored pairs, diagnostics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.config import FIELDS, Linkage
from caseloom.operators.blocking import Part, block_reports
from caseloom.operators.cluster import groups, label_groups
from caseloom.operators.em import fit_counts, patterns, score, signals
from caseloom.operators.features import pieces
from caseloom.operators.prune import prune, pruned_per_report, with_tiebreak
from caseloom.scratch import save, save_all


@dataclass(frozen=True)
class Run:
    """clusters and pairs are lazy over written tables; warnings are for people."""

    clusters: DataFrame
    pairs: DataFrame
    diagnostics: dict[str, Any]
    warnings: tuple[str, ...]


def audit(pruned: DataFrame, least: float) -> DataFrame:
    """Pairs that score at least `least` after vetoes and pruning."""
    return pruned.where(F.col("p") >= least).select("report_id_a", "report_id_b", F.col("p").alias("match_probability"), *FIELDS)


def cluster_output(reports: DataFrame, labels: DataFrame, pruned: DataFrame) -> DataFrame:
    """One row for each report with its group."""
    rows = reports.select("idx", "report_id", "true_cluster_id").join(labels, "idx").join(pruned_per_report(pruned), "idx", "left")
    return rows.select("report_id", "cluster_id", "cluster_size", (F.col("cluster_size") > 1).alias("is_candidate_duplicate"), F.coalesce("ambiguous_matches_pruned", F.lit(0)).cast("bigint").alias("ambiguous_matches_pruned"), "true_cluster_id")


def demographic_veto(scored: DataFrame) -> DataFrame:
    """p is 0 on pairs that can't be one case."""
    return scored.withColumn("p", F.when(F.col("conflict"), 0.0).otherwise(F.col("p")))


@dataclass(frozen=True)
class Compared:
    """rows: the comparisons that were asked for; counts: the agreement patterns of all with their numbers."""

    rows: DataFrame
    counts: list[tuple]
    conflicts: int


def can_match() -> Column:
    """False for pairs that vetoes give p = 0 under any model or weights."""
    return ~F.col("conflict") & ~((F.col("drug_jaccard") == 0.0) | (F.col("event_jaccard") == 0.0) | (signals() < 2))


def compare_all(parts: Iterable[Part], reports: DataFrame, config: Linkage = Linkage(), keep: Column | None = None) -> Compared:
    """Compares all pairs, a piece at a time: every pair counts, and the rows of those where `keep` holds are written."""
    counts, conflicts = Counter(), 0

    def kept() -> Iterator[DataFrame]:
        nonlocal conflicts
        for piece in pieces(parts, reports, config):
            for *agreed, n in patterns(piece, config).collect():
                counts[tuple(agreed)] += n
            conflicts += piece.where("conflict").count()
            yield piece if keep is None else piece.where(keep)

    rows = save_all(kept(), "kept")
    return Compared(rows, [(*agreed, n) for agreed, n in counts.items()], conflicts)


def link(reports: DataFrame, config: Linkage = Linkage(), whole: bool = False) -> Run:
    """Blocks, compares, fits, scores, vetoes, prunes and groups; without candidate pairs every report is a group.

    whole: all candidate pairs are taken, beyond max_pairs too.
    """
    reports = save(reports, "reports")
    blocked = block_reports(reports, config, whole)
    # a pair without a chance above 0 is in no result but the counts
    every = compare_all(blocked.parts, reports, config, can_match() if min(config.audit_min, config.cut) > 0 else None)
    compared, model = every.rows, fit_counts(every.counts, config)
    scored = with_tiebreak(demographic_veto(score(compared, config, model))) if model else with_tiebreak(compared.withColumn("p", F.lit(0.0)))
    pruned = save(prune(scored, config.cut, config.max_matches), "pruned")
    labels = label_groups(reports, groups(pruned, config.cut))
    clusters = save(cluster_output(reports, labels, pruned), "clusters").orderBy("cluster_id", "report_id")
    pairs = audit(pruned, config.audit_min).orderBy(F.desc("match_probability"), "report_id_a", "report_id_b")
    if not model:
        return Run(clusters, pairs, {"mode": config.mode, "learned_weights": {}, "blocking": blocked.stats}, blocked.warnings)
    n_pruned = pruned.where("pruned").count()
    diagnostics = {
        "mode": config.mode,
        "learned_weights": model.weights(),
        "m_probs": list(model.m),
        "u_probs": list(model.u),
        "feature_names": list(FIELDS),
        "em_iterations": model.n_iter,
        "em_converged": model.converged,
        "em_degenerate": model.fallback,
        "em_n_patterns": model.n_patterns,
        "demographic_conflicts_vetoed": every.conflicts,
        "ambiguous_matches_pruned": n_pruned,
        "probability_threshold": config.cut,
        "blocking": blocked.stats,
    }
    said = list(blocked.warnings)
    if model.fallback:
        said.append("Too few pairs to learn from; conventional values were used.")
    if config.mode == "auto" and not model.converged:
        said.append("The fit did not settle; scores may be less reliable.")
    return Run(clusters, pairs, diagnostics, tuple(said))
