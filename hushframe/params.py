"""Anonymization parameters, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class AccessLevel(Enum):
    PUBLISH_TRUSTED = "PublishTrusted"
    PUBLISH_UNTRUSTED = "PublishUntrusted"
    DIRECT = "Direct"


@dataclass(frozen=True)
class Interval:
    lower: int = 2
    upper: int = 5


@dataclass(frozen=True)
class Suppression:
    low_threshold: int = 2
    layer_sd: float = 1.0
    low_mean_gap: float = 2.0


@dataclass(frozen=True)
class AdaptiveBuckets:
    singularity_low_threshold: int = 4
    range_low_threshold: int = 8


def _require(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(what)


@dataclass(frozen=True)
class Params:
    """``aid_columns``: for each table the columns that identify a protected entity."""

    aid_columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    salt: bytes = b""
    suppression: Suppression = Suppression()
    adaptive_buckets: AdaptiveBuckets = AdaptiveBuckets()
    access_level: AccessLevel = AccessLevel.PUBLISH_TRUSTED
    strict: bool = True
    outlier_count: Interval = Interval()
    top_count: Interval = Interval()
    layer_noise_sd: float = 1.0
    recover_outliers: bool = True
    use_adaptive_buckets: bool = False

    def __post_init__(self):
        s, o, t, strict = self.suppression, self.outlier_count, self.top_count, self.strict
        _require(s.low_threshold >= (2 if strict else 1), "low_threshold is too small")
        _require(s.layer_sd >= (1 if strict else 0), "layer_sd is too small")
        _require(s.low_mean_gap >= (2 if strict else 0), "low_mean_gap is too small")
        _require(self.layer_noise_sd >= (1 if strict else 0), "layer_noise_sd is too small")
        for name, i in (("outlier_count", o), ("top_count", t)):
            _require(i.upper >= i.lower, f"{name}: the upper bound is below the lower")
        _require(o.lower >= (1 if strict else 0), "outlier_count.lower is too small")
        _require(t.lower >= (2 if strict else 1), "top_count.lower is too small")
        if strict:
            _require(o.upper >= 2 and o.upper - o.lower >= 1, "outlier_count is too narrow")
            _require(t.upper >= 3 and t.upper - t.lower >= 1, "top_count is too narrow")

    def aids_of(self, table: str) -> tuple[str, ...]:
        return next((v for k, v in self.aid_columns.items() if k.lower() == table.lower()), ())


def noiseless(aid_columns: dict[str, tuple[str, ...]], **changes) -> Params:
    """No noise and intervals of one; results can be held against plain SQL."""
    base = {"suppression": Suppression(2, 0.0, 0.0), "outlier_count": Interval(1, 1), "top_count": Interval(1, 1), "layer_noise_sd": 0.0, "strict": False}
    return Params(aid_columns=aid_columns, **base | changes)
