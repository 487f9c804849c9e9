"""Pairs that can score enough, against all candidate pairs."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from caseloom.config import REVIEW_WEIGHTS, Linkage
from caseloom.operators import blocking, em, features, likely
from caseloom.plans.linkage import demographic_veto
from caseloom.scratch import save
from caseloom.sources.reports import SCHEMA

MANUAL = Linkage(mode="manual", weights=REVIEW_WEIGHTS)


def random_reports(n, blanks):
    r = random.Random(5)
    some = lambda words, most: sorted({r.choice(words) for _ in range(r.randint(0, most))})
    drugs, events = [f"d{i}" for i in range(12)] + ["D1", " d2"], [f"e{i}" for i in range(9)] + ["E1"]
    if blanks:
        drugs, events = [*drugs, " ", "  "], [*events, "", " "]
    pick = lambda *values: r.choice(values)
    return [(i, f"r{i}", pick(None, 30.0, 33.0, 37.0, 60.0), pick(None, "", "Male", " male", "Female"), pick(None, "Serious", "Non-serious"), r.randint(-100, 500), some(drugs, 4), some(events, 3), None) for i in range(n)]


@pytest.mark.parametrize(("most", "blanks", "weights"), [(12, True, REVIEW_WEIGHTS), (40, False, {}), (300, False, {**REVIEW_WEIGHTS, "age_sim": -1.0})])
def test_likely_pairs_are_all_that_score_enough(spark, monkeypatch, most, blanks, weights):
    monkeypatch.setattr(likely, "SHARE", 150)
    monkeypatch.setattr(likely, "ROWS", 40)
    monkeypatch.setattr(blocking, "PASS", 100)
    config = replace(MANUAL, max_block_size=most, weights=weights)
    reports = save(spark.createDataFrame(random_reports(220, blanks), SCHEMA), "reports")
    every = features.compare(blocking.candidate_pairs(reports, config), reports, config)
    found = likely.compare_likely(reports, config, 0.5)
    rows = lambda df, least: sorted(map(tuple, demographic_veto(em.score(df, config)).where(F.col("p") >= least).collect()), key=repr)
    want = rows(every, 0.5)
    assert want and rows(found, 0.5) == want
    pairs = {(r.i, r.j) for r in every.select("i", "j").collect()}
    scored = {(r.i, r.j) for r in demographic_veto(em.score(found, config)).where("p > 0").select("i", "j").collect()}
    assert scored <= pairs


def test_pairs_without_a_chance_are_not_made(spark):
    """One event common to all and a drug to each: all are candidates, and none is compared."""
    rows = [(i, f"r{i}", 30.0, "Male", "Serious", i, [f"d{i}"], ["e"], None) for i in range(40)]
    reports = save(spark.createDataFrame(rows, SCHEMA), "reports")
    assert blocking.candidate_pairs(reports, MANUAL).count() == 780
    assert likely.compare_likely(reports, MANUAL, 0.7).count() == 0
