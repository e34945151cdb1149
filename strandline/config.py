"""Policy numbers. They are fixed values of the quality policy, not tuning knobs of the engine."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

# Source messages that feed the aligned table, in alignment order.
SOURCES = ("PSCN", "PSCE", "PSCD", "XKF1", "XKF4", "ATT", "BAT", "RCOU", "CTUN", "GPS")

# Longest hold per source, milliseconds.
MAX_AGE_MS = {
    "PSCN": 180, "PSCE": 180, "PSCD": 180, "XKF1": 180, "XKF4": 250,
    "ATT": 180, "BAT": 180, "RCOU": 180, "CTUN": 180, "GPS": 350,
}

# Gap limits, milliseconds.
GAP_MS = {"default": 500, "GPS": 600}

# Output axis -> (message, NED suffix). z comes from the down axis.
AXES = {"x": ("PSCE", "E"), "y": ("PSCN", "N"), "z": ("PSCD", "D")}

# Audited source revision of the flight firmware.
AUDITED_REVISION = "2b5cebb933d91e92f7bab768268e41c2960b6ae4"

# Event ids that restart continuity (estimator and source resets).
RESET_EVENT_IDS = (60, 62, 85, 86, 87)

# Columns every aligned table has, in order.
REQUIRED_COLUMNS = (
    "time_s", "px", "py", "pz", "vx", "vy", "vz", "ax", "ay", "az",
    "yaw", "ax_target", "ay_target", "az_target", "dx", "dy", "dz",
    "battery_v", "battery_i", "throttle", "motor1", "motor2", "motor3", "motor4",
    "flight_id", "mode", "valid_dx", "valid_dy", "valid_dz",
)

# States and numbers among them.
STATE_COLUMNS = ("px", "py", "pz", "vx", "vy", "vz", "ax", "ay", "az", "yaw")
NUMERIC_COLUMNS = (
    "time_s", *STATE_COLUMNS, "ax_target", "ay_target", "az_target", "dx", "dy", "dz",
    "battery_v", "battery_i", "throttle", "motor1", "motor2", "motor3", "motor4",
)


# The numbers of the three policies below.
@dataclass(frozen=True)
class RatePolicy:
    gap_multiplier: float = 5.0
    absolute_gap_threshold_s: float = 0.5


@dataclass(frozen=True)
class ScreenPolicy:
    minimum_samples: int = 10
    warning_fraction: float = 0.8
    battery_instance: int = 0
    battery_voltage: tuple[float, float] = (9.0, 13.0)
    battery_min_current_a: float = 3.0
    esc_voltage: tuple[float, float] = (5.0, 60.0)
    esc_voltage_ratio: tuple[float, float] = (0.5, 1.5)
    comparison_max_age_s: float = 0.2
    zero_current_epsilon_a: float = 0.01
    rpm_active_floor: float = 1000.0
    rpm_ratio_warning: float = 3.0
    vibration_percentiles: tuple[float, ...] = (95, 99)
    minimum_paired_samples: int = 2
    minimum_candidate_duration_s: float = 0.1


@dataclass(frozen=True)
class ExtractPolicy:
    master_rate_hz: float = 10.0
    max_age_ms: dict = field(default_factory=lambda: dict(MAX_AGE_MS))
    gap_ms: dict = field(default_factory=lambda: dict(GAP_MS))
    battery_instance: int = 0
    gps_instance: int = 0
    battery_voltage: tuple[float, float] = (9.0, 12.8)
    battery_current: tuple[float, float] = (0.5, 150.0)
    velocity: tuple[float, float] = (0.0, 30.0)
    acceleration: tuple[float, float] = (-40.0, 40.0)
    motor_output: tuple[float, float] = (0.0, 2200.0)
    features: dict = field(default_factory=lambda: {
        "x": ("px", "py", "vx", "vy", "yaw"),
        "y": ("px", "py", "vx", "vy", "yaw"),
        "z": ("pz", "vz", "yaw"),
    })
    train_fraction: float = 0.7
    holdout_flight_id: int | None = None
    minimum_samples: int = 200
    minimum_train: int = 100
    minimum_test: int = 30
    maximum_yaw_rate_rad_s: float = 12.0
    constant_range_epsilon: float = 1e-3
    esc_disagreement_ratio: float = 2.0

    def __post_init__(self) -> None:
        if not (math.isfinite(self.master_rate_hz) and 0 < self.master_rate_hz <= 1000):
            raise ValueError("master_rate_hz must lie in (0, 1000]")
        if not 0 < self.train_fraction < 1:
            raise ValueError("train_fraction must lie in (0, 1)")
        for source in SOURCES:
            check_limit(self.max_age_ms[source], f"max_age_ms[{source}]")
            check_limit(self.gap(source), f"gap_ms[{source}]")

    def gap(self, source: str) -> float:
        return self.gap_ms.get(source, self.gap_ms["default"])

    def hold_ms(self, source: str) -> float:
        return min(self.max_age_ms[source], self.gap(source))


def check_limit(value, name: str) -> float:
    """A hold or gap limit has to be a finite, non-negative number."""
    number = float(value)
    if not math.isfinite(number) or number < 0:
        raise ValueError(f"{name} must be finite and non-negative")
    return number


def override(policy, **changes):
    """Copy of a policy with some numbers replaced; unknown names are refused."""
    known = {f.name for f in fields(policy)}
    unknown = sorted(set(changes) - known)
    if unknown:
        raise ValueError(f"unknown policy settings: {', '.join(unknown)}")
    return replace(policy, **changes)
