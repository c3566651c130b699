"""Every tunable of the engine, as frozen values passed as arguments (never environment)."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

# The band names, in report order, and the target share of each in a draw.
TARGETS: Mapping[str, float] = MappingProxyType(
    {
        "contested": 0.45,
        "leaning_malicious": 0.15,
        "leaning_clean": 0.15,
        "consensus_malicious": 0.10,
        "consensus_clean": 0.10,
        "injected_known_good": 0.05,
    }
)
INJECTED = "injected_known_good"
BELOW_FLOOR = "below_floor"

# Names that may never be used as model inputs, because they are overwritten
# after the scoring moment, or because they describe how a row was drawn.
LATE_FIELDS = (
    "family_rollup",
    "detections",
    "tags",
    "families",
    "combined_score",
    "incumbent_score",
)
DRAW_FIELDS = ("stratum", "pi", "provenance")

# The four labels, and how a finer taxonomy folds into them.
LABELS = ("malicious", "benign", "unwanted", "undecidable")
LABEL_FOLD = {"known_good": "benign", "dual_use": "unwanted", "excluded": None}
ADJUDICATED_GRADE = 3
TIME_SEPARATED_GRADE = 1

# The rule on one scan's eligibility.
PE_MIMETYPES = (
    "application/x-dosexec",
    "application/vnd.microsoft.portable-executable",
    "application/x-msdownload",
)


@dataclass(frozen=True)
class Bands:
    """Edges on m = malicious / definite, and the fewest definite verdicts a band needs."""

    lower: float = 0.1
    upper: float = 0.4
    consensus: float = 0.5
    min_definite: int = 10


@dataclass(frozen=True)
class Skew:
    """How hot keys are found and spread, and how finely ordered work is cut.

    A key is hot above ``hot_rows`` rows and gets a salt for each ``hot_rows`` of them, at least
    ``salts``. At most ``max_hot_keys`` keys are listed, largest first, some 100 bytes each, which
    bounds what is broadcast: below ``hot_rows * max_hot_keys`` rows (10^12) that leaves none out.
    """

    hot_rows: int = 1_000_000
    max_hot_keys: int = 1_000_000
    salts: int = 2
    buckets: int = 256
    hash_digits: int = 3


@dataclass(frozen=True)
class Params:
    bands: Bands = field(default_factory=Bands)
    skew: Skew = field(default_factory=Skew)
    targets: Mapping[str, float] = TARGETS
    cohort_size: int = 10_000
    control_size: int = 10_000
    seed: int = 20260922
    horizon_days: int = 30
    horizon_max_days: int = 90
    churn_days: int = 180
    train_frac: float = 0.60
    validate_frac: float = 0.15
    label_min_definite: int = 5
    min_clusters: float = 3.0
    generic_discount: float = 0.5
    probe_max_auc: float = 0.6
    # settled-state rule
    settled_min_days: int = 365
    settled_min_scans: int = 3
    settled_last_k: int = 3
    settled_span_days: int = 90
    settled_min_definite: int = 5

    def __post_init__(self) -> None:
        total = sum(self.targets.values())
        if abs(total - 1.0) > 1e-9:
            raise ValueError(f"target shares must sum to 1, got {total}")

    @property
    def drawn(self) -> tuple[str, ...]:
        """Bands a draw takes from; the injected arm comes from elsewhere."""
        return tuple(name for name in self.targets if name != INJECTED)
