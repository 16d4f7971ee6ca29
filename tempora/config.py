"""Configuration dataclasses and the fixed lookup values shared by all jobs."""

from __future__ import annotations

from dataclasses import dataclass

WL = ["namespace", "deployment"]

# ---------------------------------------------------------------------------
# These must equal the behaviour being matched.
# ---------------------------------------------------------------------------

# Day codes indexed by weekday with Monday = 0 (the ML side's convention).
DAY_CODES = ["M", "TU", "W", "TH", "F", "SAT", "SUN"]

# Day codes indexed by weekday with Sunday = 0 (the trigger/cron convention).
DAY_CODES_SUNDAY_FIRST = ["SUN", "M", "TU", "W", "TH", "F", "SAT"]

# Cron weekday number for each trigger day code (Sunday = 0).
CRON_WEEKDAY = {"SUN": 0, "M": 1, "TU": 2, "W": 3, "TH": 4, "F": 5, "SAT": 6}

# Trigger-type priority used by the profile-based generator; unknown types get 50.
TYPE_PRIORITY = {
    "peak": 100,
    "weekday": 90,
    "morning": 80,
    "evening": 75,
    "afternoon": 70,
    "weekend": 60,
    "night": 50,
    "off-peak": 40,
    "seasonal": 30,
}
DEFAULT_TYPE_PRIORITY = 50

# Metric sources per metric type, in fallback order (first non-empty source wins).
METRIC_SOURCES = [
    ("cpu", "container_cpu_usage_seconds_total", 0),
    ("memory", "container_memory_usage_bytes", 0),
    ("memory", "container_memory_working_set_bytes", 1),
    ("replicas", "kube_deployment_status_replicas", 0),
    ("replicas", "kube_horizontalpodautoscaler_status_current_replicas", 1),
    ("replicas", "kube_deployment_status_replicas_ready", 2),
]


@dataclass(frozen=True)
class ProfileConfig:
    """Replica profiling (cleaning + 7x24 profile)."""

    outlier_std: float = 3.0
    min_replicas_floor: float = 1.0
    step_minutes: int = 5
    exact_percentiles: bool = True  # False -> percentile_approx (bounded memory per group)
    select_percentiles: bool = False  # True -> exact by selection (no buffer of a group's distinct values)
    approx_accuracy: int = 10000


@dataclass(frozen=True)
class DetectConfig:
    """Rule-based detectors over the 7x24 profile."""

    business_hours_start: int = 9
    business_hours_end: int = 17
    night_hours_start: int = 22
    night_hours_end: int = 6
    weekend_days: tuple = (5, 6)
    min_confidence: float = 0.6
    replica_buffer_percent: float = 0.2
    timezone: str = "UTC"
    wrap_aware: bool = False  # True: emit real overnight windows instead of 00:00-23:00

    def detectors(self) -> list[tuple]:
        """(type, hours, days, confidence floor, min cells, max taken from cell max?)."""
        wd = [0, 1, 2, 3, 4]
        bs, be = self.business_hours_start, self.business_hours_end
        ns, ne = self.night_hours_start, self.night_hours_end
        return [
            ("peak", list(range(bs, be)), wd, 0.5, 1, True),
            ("off-peak", list(range(be, 24)) + list(range(0, bs)), wd, 0.5, 1, True),
            ("night", list(range(ns, 24)) + list(range(0, ne)), wd, 0.5, 1, False),
            ("weekend", list(range(24)), list(self.weekend_days), 0.5, 1, False),
            ("morning", list(range(6, bs)), wd, 0.4, 5, False),
            ("evening", list(range(be, ns)), wd, 0.4, 5, False),
        ]


@dataclass(frozen=True)
class AnalysisConfig:
    """Clustering-based pattern mining (grid + k-means)."""

    k_min: int = 2
    k_max: int = 8
    max_iter: int = 300
    n_init: int = 10
    min_pattern_hours: float = 1.0
    min_support_rows: int = 10
    max_triggers: int = 10
    base_priority: int = 100
    priority_step: int = 10
    replica_buffer_percent: float = 0.2
    timezone: str = "UTC"
