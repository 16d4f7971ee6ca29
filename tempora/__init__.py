"""tempora: fleet-wide scaling-schedule analytics on Spark.

Metric samples in, load profiles, detected patterns, generated scaling
triggers and trigger evaluation (window state, active trigger, effective
replica bounds, timelines) out -- all as DataFrames keyed by workload
``(namespace, deployment)``.
"""

from tempora.config import AnalysisConfig, ProfileConfig, DetectConfig  # noqa: F401
from tempora.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["AnalysisConfig", "ProfileConfig", "DetectConfig", "build_session", "checkpoint_dir"]
