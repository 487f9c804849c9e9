"""Cases and brute-force checks of the linkage operators."""

import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.config import FIELDS, REVIEW_WEIGHTS, Linkage
from caseloom.operators import blocking, cluster, em, features, prune
from caseloom.operators.components import connected_components
from caseloom.operators.metrics import pairwise_metrics
from caseloom.plans.linkage import link
from caseloom.sources import generate
from caseloom.sources.reports import SCHEMA

MANUAL = Linkage(mode="manual", weights=REVIEW_WEIGHTS)


def table(spark, rows):
    """rows: (report_id, age, sex, seriousness, day, drugs, events[, truth])."""
    full = [(i, *r[:5], sorted(r[5]), sorted(r[6]), r[7] if len(r) > 7 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def crowd(n=30):
    alike = [(f"c{i}", 55.0, "Female", "Serious", 100 + i % 5, {"atorvastatin"}, {"type 2 diabetes mellitus"}) for i in range(n)]
    rest = [(f"b{i}", 20.0 + i, "Male", "Serious", 400 + 7 * i, {f"drug{i}"}, {f"event{i}"}) for i in range(n)]
    return alike + rest


# blocking


def brute_pairs(rows, config):
    """All pairs, by what it takes for one block to hold both."""
    keys = []
    for r in rows:
        drugs, events = {d.strip().lower() for d in r[5] if d.strip()}, {e.strip().lower() for e in r[6] if e.strip()}
        sex = (r[2] or "").strip().lower() or "_na_"
        keys.append({("de", d, e) for d in drugs for e in events} | {("ds", d, sex) for d in drugs} | {("es", e, sex) for e in events})
    at = [r[4] // max(1, config.max_day_delta) for r in rows]
    size = {}
    for ks, b in zip(keys, at):
        for k in ks:
            size[k, b] = size.get((k, b), 0) + 1
    fits = lambda k, b: (k, b) in size and size[k, b] + size.get((k, b + 1), 0) <= config.max_block_size
    out = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if abs(rows[i][4] - rows[j][4]) > config.max_day_delta:
            continue
        low, high = sorted((at[i], at[j]))
        starts = [low] if high > low else [low, low - 1]
        if any(fits(k, b) for k in keys[i] & keys[j] for b in starts if high <= b + 1):
            out.add((i, j))
    return out


def random_rows(seed, n=120):
    rng = random.Random(seed)
    return [(str(i), rng.choice([None, 40.0, 43.0, 60.0]), rng.choice(["Male", "Female", None, " "]), rng.choice(["Serious", None]), rng.randrange(-250, 400), {rng.choice(["A ", "b", "c", "d"]) for _ in range(rng.randrange(3))}, {rng.choice(["x", "Y", "z"]) for _ in range(rng.randrange(3))}) for i in range(n)]


@pytest.mark.parametrize("most, days", [(300, 90), (8, 90), (15, 30), (4, 0)])
def test_candidate_pairs_match_brute_force(spark, most, days):
    for seed in (1, 2):
        rows, config = random_rows(seed), Linkage(max_block_size=most, max_day_delta=days)
        got = {(r.i, r.j) for r in blocking.candidate_pairs(table(spark, rows), config).collect()}
        assert got == brute_pairs(rows, config)


def test_partitions_do_not_matter(spark):
    rows = table(spark, random_rows(3))
    want = None
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = sorted(map(tuple, link(rows.repartition(n), MANUAL).clusters.collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cap_on_pairs_is_flagged_and_repeatable(spark):
    rows = table(spark, random_rows(4, 200))
    full = blocking.block_reports(rows)
    assert full.stats["truncated"] == 0 and not full.warnings
    capped = [blocking.block_reports(rows.repartition(k), Linkage(max_pairs=60)) for k in (1, 5)]
    a, b = ({tuple(r) for r in c.pairs.collect()} for c in capped)
    assert a == b and capped[0].stats["truncated"] == 1 and "cap" in capped[0].warnings[0]
    assert 0 < len(a) < full.stats["n_candidate_pairs"] and len(a) <= 60 + 300 * 150
    assert a <= {tuple(r) for r in full.pairs.collect()}


def test_oversized_blocks_are_counted(spark):
    found = blocking.block_reports(table(spark, crowd()), Linkage(max_block_size=10))
    assert found.stats["skipped_oversized_blocks"] == 3 and found.stats["n_candidate_pairs"] == 0


# comparison


def test_rare_terms_count_more(spark):
    rows = [(str(i), 50.0, "Male", "Serious", 10, {"statin", "rare_a" if i < 2 else "rare_b"}, {"nausea"}) for i in range(4)]
    rows += [(str(i), 50.0, "Male", "Serious", 10, {"statin"}, {"nausea"}) for i in range(4, 24)]
    got = {(r.i, r.j): r for r in features.compare(spark.createDataFrame([(0, 1), (0, 2)], "i long, j long"), table(spark, rows)).collect()}
    assert got[0, 1].drug_jaccard == 1.0 and got[0, 2].drug_jaccard < 0.2
    weight = lambda df: math.log1p(24 / df)
    assert abs(got[0, 2].drug_jaccard - weight(24) / (weight(24) + 2 * weight(2))) < 1e-6


def test_unknown_is_null_and_empty_sets_are_zero(spark):
    rows = [("a", 50.0, "Female", None, 0, {"d"}, {"e"}), ("b", None, None, "Serious", 0, {"d"}, set()), ("c", 56.0, "Male", None, 45, set(), {"e"})]
    got = {(r.i, r.j): r for r in features.compare(spark.createDataFrame([(0, 1), (0, 2)], "i long, j long"), table(spark, rows)).collect()}
    assert (got[0, 1].age_sim, got[0, 1].sex_match, got[0, 1].seriousness_match, got[0, 1].event_jaccard, got[0, 1].conflict) == (None, None, None, 0.0, False)
    assert (got[0, 2].age_sim, got[0, 2].sex_match, got[0, 2].temporal_sim, got[0, 2].drug_jaccard, got[0, 2].conflict) == (0.25, 0.0, 0.5, 0.0, True)


# model


def pair(spark, *rows):
    return spark.createDataFrame([(i, 100 + i, *r, False) for i, r in enumerate(rows)], "i long, j long, " + ", ".join(f"{f} double" for f in FIELDS) + ", conflict boolean")


def test_scores_of_both_modes(spark):
    both = pair(spark, (0.9, 1.0, 1.0, 0.9, 1.0, 1.0), (0.1, 0.0, 0.0, 0.2, 0.5, 0.0))
    model = em.fit(both)
    assert model.fallback and model.m == em.PRIORS.m
    for config in (Linkage(), Linkage(mode="manual")):
        p = [r.p for r in em.score(both, config, model).orderBy("i").collect()]
        assert p[0] > (0.5 if config.mode == "auto" else 0.8) and p[1] == 0.0
    with pytest.raises(RuntimeError):
        em.score(both, Linkage(), None)


def test_unknown_is_between_agreement_and_disagreement(spark):
    rows = pair(spark, *[(a, 1.0, 1.0, 0.9, 0.6, 0.6) for a in (0.9, None, 0.1)])
    model = em.Model((0.9,) * 6, (0.3,) * 6, 0.1)
    yes, unknown, no = [r.p for r in em.score(rows, Linkage(), model).orderBy("i").collect()]
    assert yes > unknown > no


def test_fit_is_plain_em():
    rng = random.Random(2)
    counts = {}
    for _ in range(3000):
        match = rng.random() < 0.1
        g = tuple(None if rng.random() < 0.1 else int(rng.random() < (0.95 if match else q)) for q in (0.2, 0.5, 0.5, 0.3, 0.05, 0.05))
        counts[g] = counts.get(g, 0) + 1
    rows = [(*g, n) for g, n in counts.items()]
    model = em.fit_counts(rows)
    # pair by pair, without counting patterns
    each = [g for g, n in counts.items() for _ in range(n)]
    u = [min(max(sum(g[k] == 1 for g in each) / sum(g[k] is not None for g in each), 1e-4), 1 - 1e-4) for k in range(6)]
    m, p = [max(0.9, x) for x in u], 0.05
    for step in range(1, 501):
        share = []
        for g in each:
            a = p * math.prod((m[k] if v else 1 - m[k]) for k, v in enumerate(g) if v is not None)
            b = (1 - p) * math.prod((u[k] if v else 1 - u[k]) for k, v in enumerate(g) if v is not None)
            share.append(a / (a + b))
        new = [min(max(sum(s for s, g in zip(share, each) if g[k] == 1) / sum(s for s, g in zip(share, each) if g[k] is not None), u[k]), 0.98) for k in range(6)]
        q = min(max(sum(share) / len(each), 1e-4), 0.5)
        delta, m, p = max(abs(a - b) for a, b in zip(m, new)) + abs(p - q), new, q
        if delta < 1e-6:
            break
    assert model.converged and not model.fallback and abs(model.n_iter - step) <= 1
    assert np.allclose(model.m, m, atol=1e-6) and np.allclose(model.u, u) and abs(model.p - p) < 1e-6
    assert em.fit_counts([]) is None and em.fit_counts([(1, 1, 1, 1, 1, 1, 500)]).fallback


# pruning and groups


def test_prune_matches_brute_force(spark):
    rng = random.Random(5)
    edges = {(min(a, b), max(a, b)): (rng.choice([0.2, 0.8, 0.9]), rng.choice([0.5, 0.6])) for a, b in (rng.sample(range(25), 2) for _ in range(120))}
    df = spark.createDataFrame([(a, b, p, t) for (a, b), (p, t) in edges.items()], "i long, j long, p double, tiebreak double")
    for k in (1, 2, 0, None):
        got = {(r.i, r.j): r.p for r in prune.prune(df, 0.7, k).collect()}
        strong = {e: v for e, v in edges.items() if v[0] >= 0.7}
        best = {n: sorted((e for e in strong if n in e), key=lambda e: (-strong[e][0], -strong[e][1], e))[: k or 999] for n in range(25)}
        assert got == {e: 0.0 if e in strong and not all(e in best[n] for n in e) else p for e, (p, _) in edges.items()}


def brute_linkage(n, edges, cut):
    d = {(a, b): 1.0 for a, b in itertools.combinations(range(n), 2)}
    d.update({(min(a, b), max(a, b)): max(0.0, 1 - p) for a, b, p in edges})
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        mean, a, b = min((np.mean([d[min(x, y), max(x, y)] for x in g for y in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if mean > cut:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_average_linkage_matches_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(3, 9)
        edges = [(a, b, rng.random() * 0.7 + 0.3) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        cut = rng.choice([0.3, 0.5, 0.7])
        label = cluster.average_linkage(n, edges, cut)
        got = {frozenset(i for i in range(n) if label[i] == x) for x in set(label)}
        assert got == brute_linkage(n, edges, cut)


def test_components_of_long_paths(spark):
    edges = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(edges).groupBy("component").count().collect()[0]["count"] == 3001
    assert connected_components(edges.limit(0)).count() == 0


def test_groups_are_numbered_by_their_first_report(spark):
    rows = table(spark, [(str(i), None, None, None, 0, set(), set()) for i in range(6)])
    found = spark.createDataFrame([(4, 1), (1, 1), (5, 3), (3, 3)], "idx long, head long")
    got = {r.idx: (r.cluster_id, r.cluster_size) for r in cluster.label_groups(rows, found).collect()}
    assert got == {0: (1, 1), 1: (2, 2), 4: (2, 2), 2: (3, 1), 3: (4, 2), 5: (4, 2)}


# runs


def test_demographic_veto(spark):
    rows = [("A", 40.0, "Female", "Serious", 100, {"atorvastatin"}, {"nausea"}, 1), ("B", 41.0, "Female", "Serious", 101, {"atorvastatin"}, {"nausea"}, 1), ("C", 72.0, "Female", "Serious", 101, {"atorvastatin"}, {"nausea"}, 2)]
    run = link(table(spark, rows), Linkage(threshold=0.60))
    ids = {r.report_id: r.cluster_id for r in run.clusters.collect()}
    assert ids["A"] == ids["B"] != ids["C"] and run.diagnostics["demographic_conflicts_vetoed"] >= 1


@pytest.mark.parametrize("config", [Linkage(), MANUAL])
def test_small_run(spark, config):
    rows = [("101", 45.0, "Male", "Serious", 100, {"atorvastatin", "metformin"}, {"nausea", "headache"}), ("102", 46.0, "Male", "Serious", 105, {"atorvastatin", "metformin"}, {"nausea", "headache"}), ("103", 72.0, "Female", "Non-serious", 500, {"lisinopril"}, {"cough"})]
    run = link(table(spark, rows), config)
    assert run.clusters.count() == 3 and run.diagnostics["mode"] == config.mode and len(run.diagnostics) == 13
    assert run.pairs.columns == ["report_id_a", "report_id_b", "match_probability", *FIELDS]


def test_look_alike_crowd_is_pruned(spark):
    run = link(table(spark, crowd()), MANUAL)
    assert run.clusters.agg(F.max("cluster_size")).first()[0] <= 3 and run.diagnostics["ambiguous_matches_pruned"] > 0


def test_without_pairs_or_rows(spark):
    run = link(table(spark, [("a", None, None, None, 0, {"d"}, {"e"}), ("b", None, None, None, 0, set(), set())]))
    assert sorted(r.cluster_id for r in run.clusters.collect()) == [1, 2] and run.pairs.count() == 0 and "em_iterations" not in run.diagnostics
    assert link(table(spark, crowd()).limit(0)).clusters.count() == 0


@pytest.mark.parametrize("config", [Linkage(), MANUAL])
def test_accuracy_floor_on_synthetic_reports(spark, config):
    reports = generate.synthetic(spark, 300)
    run = link(reports, config)
    assert pairwise_metrics(run.clusters).first().f1 > 0.93


def test_accuracy_floor_on_injected_duplicates(spark):
    base = generate.synthetic(spark, 500, duplicate_rate=0.0)
    run = link(generate.inject_duplicates(base), MANUAL)
    rated = pairwise_metrics(run.clusters).first()
    assert rated.precision > 0.6 and rated.recall > 0.6


def test_accuracy_table(spark, monkeypatch):
    from caseloom.plans import accuracy

    monkeypatch.setattr(accuracy, "COHORTS", ((120, 0.3),))
    rows = accuracy.table(spark).collect()
    assert [(r.scenario, r.mode) for r in rows] == [("synthetic 120, 0.3", "auto"), ("synthetic 120, 0.3", "manual")] and all(r.f1 > 0.85 and r.max_cluster >= 2 for r in rows)


def test_metrics(spark):
    rate = lambda rows: tuple(pairwise_metrics(spark.createDataFrame(rows, "cluster_id long, true_cluster_id long")).first())
    p, r, f = rate([(1, 1), (1, 1), (2, 1), (2, 2)])
    assert (p, round(r, 6), round(f, 6)) == (0.5, round(1 / 3, 6), 0.4)
    assert rate([(1, 1), (1, None)]) == (0.0, 0.0, 0.0) and rate([]) == (0.0, 0.0, 0.0)


def test_stream_links_new_reports_with_stored_ones(spark, tmp_path):
    from caseloom.streaming.incremental import start

    rows = random_rows(6, 60)
    reports = table(spark, rows)
    for part in range(3):
        reports.where(F.col("idx") % 3 == part).coalesce(1).write.parquet(f"{tmp_path}/in/part{part}")
    source = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = start(source, f"file://{tmp_path}/store", f"file://{tmp_path}/out", f"{tmp_path}/checkpoint", replace(MANUAL, threshold=0.6))
    run.processAllAvailable()
    run.stop()
    got = spark.read.parquet(f"{tmp_path}/out")
    keys = {(r.report_id_a, r.report_id_b) for r in got.collect()}
    assert len(keys) == got.count() > 0
    compared = features.compare(spark.createDataFrame(sorted(brute_pairs(rows, MANUAL)), "i long, j long"), reports)
    strong = em.score(compared.where(~F.col("conflict")), MANUAL).where("p >= 0.6")
    # term weights grow with what has arrived, so only pairs of equal sets are the same at every time
    sure = {(r.report_id_a, r.report_id_b) for r in strong.where("drug_jaccard = 1 and event_jaccard = 1").collect()}
    assert sure and sure <= keys


@pytest.mark.parametrize("most, days", [(300, 90), (8, 90), (15, 30)])
def test_passes_and_pieces_change_nothing(spark, monkeypatch, most, days):
    """Pairs are made in passes over the days, and compared in pieces; each pair comes once."""
    rows, config = random_rows(11, 150), replace(MANUAL, max_block_size=most, max_day_delta=days)
    reports = table(spark, rows)
    one = link(reports, config)
    want = sorted(map(tuple, one.clusters.collect())), sorted(map(tuple, one.pairs.collect())), one.diagnostics
    monkeypatch.setattr(blocking, "PASS", 40)
    monkeypatch.setattr(blocking, "KEYS_AT_ONCE", 200)
    monkeypatch.setattr(features, "PIECE", 300)
    assert len(blocking.ranges(reports, days)) > 2
    got = [tuple(r) for r in blocking.candidate_pairs(reports, config).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, config)
    many = link(reports, config)
    assert (sorted(map(tuple, many.clusters.collect())), sorted(map(tuple, many.pairs.collect())), many.diagnostics) == want


def test_whole_runs_take_pairs_beyond_the_cap(spark):
    rows = random_rows(4, 200)
    found = blocking.block_reports(table(spark, rows), Linkage(max_pairs=60), whole=True)
    assert found.stats["truncated"] == 0 and not found.warnings
    assert {tuple(r) for r in found.pairs.collect()} == brute_pairs(rows, Linkage()) and found.stats["n_candidate_pairs"] > 60
    assert link(table(spark, rows), replace(MANUAL, max_pairs=60), whole=True).diagnostics["blocking"]["truncated"] == 0
