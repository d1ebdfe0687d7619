"""tessera: the data side of running ML models, as PySpark DataFrame jobs.

Profiling and validation, feature engineering, catalog tables, monitoring metrics,
drift statistics, Spark ML training/scoring, retrain/promote decisions and
Structured Streaming monitors.  Every operator takes and returns DataFrames; the
heavy lifting is done by Catalyst/Tungsten, never by driver-side loops.
"""

from tessera.session import build_session, checkpoint_dir, scratch_path

__all__ = ["build_session", "checkpoint_dir", "scratch_path"]
