"""Settings of a linkage run. Defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

FIELDS = ("age_sim", "sex_match", "seriousness_match", "temporal_sim", "drug_jaccard", "event_jaccard")
#: Similarity from which a field agrees; other names use OTHER_AGREE.
AGREE = {"age_sim": 0.50, "drug_jaccard": 0.50, "event_jaccard": 0.50, "temporal_sim": 0.30}
OTHER_AGREE = 0.65
#: Similarity above which a field is a signal.
SIGNALS = {"drug_jaccard": 1e-9, "event_jaccard": 1e-9, "age_sim": 0.5, "temporal_sim": 0.5, "sex_match": 0.5, "seriousness_match": 0.5}
#: Weights for manual scoring as a review starts with.
REVIEW_WEIGHTS = {"drug_jaccard": 2.5, "event_jaccard": 2.5, "age_sim": 1.0, "temporal_sim": 1.0, "sex_match": 0.5, "seriousness_match": 0.5}
THRESHOLDS = {"auto": 0.50, "manual": 0.70}
#: Names of the fields for people.
LABELS = {"drug_jaccard": "Drugs", "event_jaccard": "Reactions", "age_sim": "Age", "temporal_sim": "Report date", "sex_match": "Sex", "seriousness_match": "Seriousness"}


@dataclass(frozen=True)
class Linkage:
    """mode auto learns; any other mode scores by weights."""

    mode: str = "auto"
    threshold: float | None = None
    weights: dict[str, float] = field(default_factory=dict)
    max_day_delta: int = 90
    max_age_diff: float = 8.0
    age_conflict_years: float = 5.0
    max_block_size: int = 300
    max_pairs: int = 5_000_000
    audit_min: float = 0.30
    max_matches: int = 2
    agree: dict[str, float] = field(default_factory=dict)
    max_iter: int = 500
    tol: float = 1e-6

    @property
    def cut(self) -> float:
        return self.threshold if self.threshold is not None else THRESHOLDS.get(self.mode, 0.70)
