"""Parameter profiles.

Every duration that the rules state in "seconds" is counted in *units*: one unit
is one micro bar (``unit_us``).  On a real tape a unit is one second and a macro
bar one minute; a coarser tape only changes ``unit_us`` and ``macro_us``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

SECOND_US = 1_000_000
DAY_US = 86_400 * SECOND_US


@dataclass(frozen=True)
class Profile:
    # grid
    unit_us: int = SECOND_US
    macro_us: int = 60 * SECOND_US
    session_macros: int = 390
    gap_cap: int = 900
    # ingest
    late_grace: float = 2.0
    feed_silence: float = 3.0
    feed_latency_max: float = 3.0
    feed_alpha: float = 0.1
    backfill_gap: float = 2.0
    replay_slack: float = 5.0
    # warmup and session structure
    opening_range_macros: int = 5
    premarket_us: int = int(5.5 * 3600) * SECOND_US
    lookup_lead_us: int = 6 * 3600 * SECOND_US
    prior_cutoff_us: int = 10 * 3600 * SECOND_US
    baseline_sessions: int = 5
    midday_from: int = 30
    midday_to: int = 360
    quiet_last_us: int = 3600 * SECOND_US
    context_stale: float = 45.0
    context_clamp: float = 10.0
    context_short: int = 60
    context_long: int = 300
    # trigger gates
    ready_bps: float = 8.0
    break_min_bps: float = 3.0
    break_max_bps: float = 25.0
    break_max_open_bps: float = 40.0
    open_phase_min: float = 10.0
    vel_min_bps_s: float = 1.0
    vel15_max_bps_s: float = 2.0
    range_exp_max: float = 3.0
    accel_ratio: float = 1.10
    vol_accel_min: float = 2.0
    vol_base_min: float = 1.5
    baseline_skip_open_min: int = 2
    imb_min: float = 0.22
    imb15_min: float = 0.10
    persist_min_trades: int = 4
    persist_window_s: float = 2.5
    persist_short_s: float = 2.0
    persist_min_span_s: float = 0.6
    min_trades_2s: int = 3
    single_print_max_frac: float = 0.70
    fresh_break_veto: bool = True
    fresh_break_vol_max: float = 6.0
    comp_veto_ratio: float = 1.0
    imb15_blowoff_max: float = 0.55
    fake_start_weight: float = 0.30
    score_min: float = 0.55
    score_floor: float = 0.30
    # structure
    merge_bps: float = 2.0
    sweep_window_s: float = 90.0
    sweep_max_bps: float = 20.0
    reclaim_age_s: float = 5.0
    compression_max_ratio: float = 0.75
    compression_relax: float = 0.90
    invalidation_min_bps: float = 6.0
    open_range_floor_bps: float = 100.0
    invalidation_range_frac: float = 0.35
    invalidation_max_bps: float = 40.0
    # resolution
    confirm_min_s: float = 60.0
    confirm_min_r: float = 0.5
    observe_max_s: float = 80.0
    confirm_slope_min_bps: float = 0.0
    fail_buffer_bps: float = 2.0
    # arbitration
    cooldown_failed_s: float = 120.0
    cooldown_confirmed_s: float = 240.0
    cooldown_suppressed_s: float = 180.0
    re_arm_bps: float = 10.0
    max_alerts_symbol_day: int = 12
    max_alerts_hour_total: int = 30
    max_alerts_burst: int = 3
    burst_window_s: float = 60.0
    hour_window_s: float = 3600.0
    min_gap_same_symbol_s: float = 30.0
    # sustained trend
    trend_window_s: int = 75
    trend_min_bps: float = 25.0
    trend_dir_share_min: float = 0.60
    trend_vol_base_min: float = 1.8
    trend_extreme_min: int = 15
    trend_young_min: int = 3
    trend_max_per_day: int = 2
    # learning
    min_labels: int = 40
    prob_gate_min: float = 0.45
    prob_bypass_score: float = 0.80
    efficacy_min_labels: int = 40
    efficacy_prob_gate_min: float = 0.60
    outcome_window_s: int = 300
    pos_multiple: float = 1.5
    min_remaining_frac: float = 0.50
    bound_low: float = 0.75
    bound_high: float = 1.50
    adapt_step: float = 0.02
    revert_window: int = 30
    revert_precision_drop: float = 0.15
    ring_seconds: int = 600

    @property
    def units_per_macro(self) -> int:
        return self.macro_us // self.unit_us

    @property
    def macro_slices(self) -> float:
        """How many five-unit slices one macro bar holds (12 on a second tape)."""
        return self.macro_us / (5 * self.unit_us)

    @property
    def visibility_us(self) -> int:
        """A macro bar may be used from its start plus this long (no lookahead)."""
        return self.macro_us + self.unit_us

    def us(self, units: float) -> int:
        return int(round(units * self.unit_us))


DEFAULT = Profile()

TUNED = replace(
    DEFAULT,
    break_max_bps=20.0,
    vel_min_bps_s=2.0,
    vol_accel_min=3.0,
    vol_base_min=2.0,
    imb_min=0.30,
    score_min=0.70,
    cooldown_failed_s=300.0,
    cooldown_confirmed_s=600.0,
    re_arm_bps=20.0,
    max_alerts_symbol_day=5,
    max_alerts_hour_total=10,
    min_gap_same_symbol_s=120.0,
    prob_gate_min=0.60,
)
