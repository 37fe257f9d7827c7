"""All queries of the engine, and their SQL."""

from . import metric, models, paths, resampling, scalar  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
