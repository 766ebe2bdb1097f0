"""Parameters with their defaults, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    window_size: str = "1d"
    step_size: str = "1d"
    train_fraction: float = 0.6
    validation_fraction: float = 0.2
    fan_in_senders: int = 4
    fan_out_receivers: int = 4
    layering_min_hops: int = 3
    layering_max_hops: int = 6
    layering_gap_hours: float = 24.0
    layering_tolerance: float = 0.3
    split_merge_window: str = "2d"
    cycle_length: int = 6
    cycle_days: float = 7.0
    cycle_branching: int | None = None
    hold_hours: float = 48.0
    intermediary_count: int = 3
    intermediary_days: float = 10.0
    rising_windows: int = 2
    rising_total: float = 3.0
    episode_days: float = 10.0
    episode_shared: int = 2
    episode_events: int = 2
    episode_accounts: int = 100
    ring_accounts: int = 3
    ring_events: int = 2
    formation_days: float = 10.0
    support_days: float = 10.0
    support_overlap: int = 2
    alert_threshold: float = 50.0
    top_k: tuple[int, ...] = (10, 20, 50)
    horizon: int = 2
    score_weights: dict[str, float] = field(default_factory=lambda: {"behavioural": 0.35, "network": 0.20, "fund_flow": 0.25, "persistence": 0.20})
    risk_bands: tuple[tuple[str, float, float], ...] = (("LOW", 0, 25), ("MODERATE", 25, 50), ("HIGH", 50, 75), ("CRITICAL", 75, 100))


# The detectors' names in the order in which they run, and their weights.
PATTERN_ORDER = ("fan_in", "fan_out", "layering", "split_merge", "rapid_pass_through", "repeated_intermediary", "circular_flow", "escalating_connectivity")
PATTERN_WEIGHTS = {"fan_in": 1.0, "fan_out": 1.0, "layering": 2.0, "split_merge": 2.0, "repeated_intermediary": 2.0, "circular_flow": 3.0, "rapid_pass_through": 0.5, "escalating_connectivity": 0.5}
#: Four notions of "structural" that must not be mixed up.
EPISODE_TYPES = ("fan_in", "fan_out", "layering", "repeated_intermediary")
TRAJECTORY_STRUCTURAL = ("fan_in", "fan_out", "layering", "split_merge", "circular_flow", "repeated_intermediary")
RING_STRUCTURAL = ("fan_in", "fan_out", "layering", "repeated_intermediary")
RING_SUPPORT = ("circular_flow", "split_merge", "rapid_pass_through", "escalating_connectivity")
INDICATOR_STRUCTURAL = ("fan_in", "fan_out", "layering", "split_merge")
