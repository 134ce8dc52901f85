"""weekcast: weekly time-series features and forecasting as PySpark DataFrame jobs."""

from weekcast.config import CORRECTED, REFERENCE, Preset

__all__ = ["CORRECTED", "REFERENCE", "Preset"]
__version__ = "0.1.0"
