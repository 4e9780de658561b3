"""Parameters of setups, costs and samples, with the usual defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SetupParams:
    lengths: tuple[int, ...] = (4, 5, 6, 7, 8, 10, 12, 15, 20)
    range_max: float = 0.12
    tight_range: float = 0.08
    atr_ratio_max: float = 0.85
    tight_atr_ratio: float = 0.75
    breakout_atr_min: float = 0.25
    reversal_atr_min: float = 0.10
    rvol_min: float = 1.20
    location_long_min: float = 0.65
    location_short_max: float = 0.35
    range_expansion_min: float = 1.50
    stop_atr: float = 1.5
    buffer_atr: float = 0.25
    target_r: float = 2.0
    warmup: int = 220
    weights: dict[str, float] = field(default_factory=lambda: {"breakout": 0.20, "volume": 0.20, "base": 0.15, "trend": 0.15, "volatility": 0.10, "strength": 0.10, "regime": 0.10})


@dataclass(frozen=True)
class Cost:
    name: str
    round_trip_bps: float
    borrow_rate: float


COSTS = (Cost("Base", 10.0, 0.03), Cost("Stress", 25.0, 0.10))
HORIZONS = (1, 3, 5, 10)
EMA_SPANS = (20, 50, 200)
RANGE_LENGTHS = (4, 5, 6, 7, 8, 10, 12, 15, 20, 50)
SETUP = SetupParams()
