"""The Fellegi-Sunter model over counted agreement patterns.

A pattern is six values of agree, disagree or unknown, so there are at most 729
whatever the number of pairs.  They are counted by a grouped aggregate; the fit
runs on the driver over those counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.config import AGREE, FIELDS, OTHER_AGREE, SIGNALS, Linkage

#: Fixed values of the fit.
START_M, START_P, CAP_M, LEAST, LEAST_PAIRS = 0.90, 0.05, 0.98, 1e-4, 30
PRIOR_M, PRIOR_U, PRIOR_P = 0.90, 0.10, 0.05


def agreement(name: str, config: Linkage = Linkage()) -> Column:
    """1, 0 or null of a similarity column."""
    return (F.col(name) >= {**AGREE, **config.agree}.get(name, OTHER_AGREE)).cast("int")


def patterns(compared: DataFrame, config: Linkage = Linkage()) -> DataFrame:
    """(g_age_sim, ..., n): pairs of each agreement pattern."""
    return compared.groupBy(*[agreement(f, config).alias(f"g_{f}") for f in FIELDS]).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Model:
    """Chances of agreement among matches (m) and others (u), and the share of matches (p)."""

    m: tuple[float, ...]
    u: tuple[float, ...]
    p: float
    n_iter: int = 0
    converged: bool = False
    fallback: bool = False
    n_patterns: int = 0

    def weights(self) -> dict[str, float]:
        """log2 of m over u of each field."""
        return {f: float(np.log2(max(m / (u + 1e-9), 1e-3))) for f, m, u in zip(FIELDS, self.m, self.u)}

    def posterior(self) -> Column:
        """P(match) from a row's agreement columns g_*, in log space; unknown fields tell nothing."""
        up, down = F.lit(float(np.log(self.p))), F.lit(float(np.log1p(-self.p)))
        for f, m, u in zip(FIELDS, self.m, self.u):
            g = F.col(f"g_{f}")
            part = lambda q: F.when(g == 1, float(np.log(q))).when(g == 0, float(np.log1p(-q))).otherwise(0.0)  # noqa: B023, E731
            up, down = up + part(m), down + part(u)
        high = F.greatest(up, down)
        top = F.exp(up - high)
        return top / (top + F.exp(down - high) + 1e-12)


PRIORS = Model((PRIOR_M,) * len(FIELDS), (PRIOR_U,) * len(FIELDS), PRIOR_P, fallback=True)


def fit(compared: DataFrame, config: Linkage = Linkage()) -> Model | None:
    """The model of compared pairs; none without pairs."""
    return fit_counts([tuple(r) for r in patterns(compared, config).collect()], config)


def fit_counts(rows: list[tuple], config: Linkage = Linkage()) -> Model | None:
    """rows: agreement values and the count of each pattern, in any order."""
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: tuple(-1 if v is None else v for v in r[:-1]))
    table = np.array([[np.nan if v is None else v for v in r[:-1]] for r in rows], float)
    count = np.array([r[-1] for r in rows], float)
    yes, told = np.nan_to_num(table), ~np.isnan(table)
    no = told - yes
    rate = lambda w: (w @ yes) / (w @ told + 1e-9)
    u = np.clip(rate(count), LEAST, 1 - LEAST)
    m, p, steps, done = np.maximum(START_M, u), START_P, 0, False
    while steps < config.max_iter and not done:
        odds_up = np.log(p) + yes @ np.log(m) + no @ np.log1p(-m)
        odds_down = np.log1p(-p) + yes @ np.log(u) + no @ np.log1p(-u)
        high = np.maximum(odds_up, odds_down)
        top = np.exp(odds_up - high)
        share = top / (top + np.exp(odds_down - high) + 1e-12) * count
        # the floor u comes before the cap, so m can be less than u where u is above the cap
        next_m = np.clip(np.maximum(rate(share), u), LEAST, CAP_M)
        next_p = float(np.clip(share.sum() / count.sum(), LEAST, 0.5))
        done = bool(np.abs(next_m - m).max() + abs(next_p - p) < config.tol)
        m, p, steps = next_m, next_p, steps + 1
    flat = np.allclose(m, u, atol=1e-3) or (np.abs(np.log2(np.maximum(m / (u + 1e-12), 1e-12))) < 1e-2).all()
    told_by = Model(tuple(m.tolist()), tuple(u.tolist()), p, steps, done, False, len(rows))
    if count.sum() < LEAST_PAIRS or len(rows) < 2 or flat:
        return replace(PRIORS, n_iter=steps, converged=done, n_patterns=len(rows))
    return told_by


def weighted_mean(weights: dict[str, float]) -> Column:
    """Mean of the known similarities; fields without a weight count 1; 0 if nothing is known."""
    w = {f: float(weights.get(f, 1.0)) for f in FIELDS} if weights else {f: 1.0 for f in FIELDS}
    num, den = F.lit(0.0), F.lit(0.0)
    for f in FIELDS:
        num = num + F.coalesce(F.col(f) * w[f], F.lit(0.0))
        den = den + F.when(F.col(f).isNotNull(), w[f]).otherwise(0.0)
    return F.when(den > 0, num / den).otherwise(0.0)


def signals() -> Column:
    """How many similarities are above their signal level."""
    total = F.lit(0)
    for f, level in SIGNALS.items():
        total = total + F.coalesce((F.col(f) > level).cast("int"), F.lit(0))
    return total


def vetoed(p: Column) -> Column:
    """0 without a shared drug, without a shared event, or with fewer than two signals."""
    return F.when((F.col("drug_jaccard") == 0.0) | (F.col("event_jaccard") == 0.0) | (signals() < 2), 0.0).otherwise(p)


def score(compared: DataFrame, config: Linkage = Linkage(), model: Model | None = None) -> DataFrame:
    """compared with g_* and p, before the demographic veto."""
    with_g = compared.withColumns({f"g_{f}": agreement(f, config) for f in FIELDS})
    if config.mode == "auto":
        if model is None:
            raise RuntimeError("scoring by a learnt model needs a fitted one")
        return with_g.withColumn("p", vetoed(model.posterior()))
    return with_g.withColumn("p", vetoed(weighted_mean(config.weights)))
