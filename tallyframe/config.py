"""Settings of the matcher, the sweep and the read path, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

EXCEPTION_STATUSES = ("amount_drift", "unmatched_gateway_only", "unmatched_ledger_only")
STATUSES = ("matched", "amount_drift", "time_drift", "unmatched_gateway_only", "unmatched_ledger_only", "duplicate")
LAYERS = ("exact", "time_drift", "amount_drift", "duplicate", "unmatched_sweep")
STATS_WINDOWS = {"1h": 3_600, "24h": 86_400, "7d": 604_800}
LEDGER_BATCH_MAX = 1_000
PAGE_LIMIT, PAGE_LIMIT_MAX = 50, 500
SWEEP_BATCH = 500
MAX_SWEEP_PASSES = 20
MAX_REPORTED_REJECTS = 50


@dataclass(frozen=True)
class MatchConfig:
    """Windows in microseconds; the tolerance is the larger of a share and a floor."""

    exact_window_us: int = 2_000_000
    drift_window_us: int = 60_000_000
    amount_drift_pct: Decimal = Decimal("0.01")
    amount_drift_floor: Decimal = Decimal("10.0")
    unmatched_after_s: int = 300

    def __post_init__(self) -> None:
        if self.amount_drift_pct <= 0 or self.amount_drift_floor <= 0:
            raise ValueError("the tolerance share and floor must be above zero")
        if not 0 <= self.exact_window_us <= self.drift_window_us:
            raise ValueError("the exact window must lie within the drift window")


DEFAULT = MatchConfig()
