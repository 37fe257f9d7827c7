"""Three quantile rules, a guarded reference level, thresholds, and rank normalisation."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def linear(frame: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one column p50, p90, ... each; nulls don't count."""
    by = by or []
    levels = _placed(frame, column, by)
    at = {f"p{round(100 * p)}": (F.col("_n") - 1) * F.lit(float(p)) for p in shares}
    ends = [F.max(F.when((F.col("le") > end(k)) & (F.col("le") - F.col("c") <= end(k)), F.col(column))).alias(f"_{name}{side}") for name, k in at.items() for side, end in (("low", F.floor), ("high", F.ceil))]
    found = levels.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    return found.select(*by, *((F.col(f"_{name}low") + (F.col(f"_{name}high") - F.col(f"_{name}low")) * (k - F.floor(k))).alias(name) for name, k in at.items()))


def _placed(frame: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, column, c, le, _n): distinct values, how many rows have each and up to each, and how many the group has."""
    levels = ranks.levels(frame, by, column)
    total = frame.filter(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    if not by:
        return levels.crossJoin(total)  # a row
    return levels.join(total.withColumnsRenamed({n: f"_{n}_" for n in by}), reduce(lambda a, n: a & F.col(n).eqNullSafe(F.col(f"_{n}_")), by, F.lit(True))).drop(*(f"_{n}_" for n in by))


def _at(frame: DataFrame, column: str, by: list[str], place: Column) -> DataFrame:
    """The value at a place, from 0, of each group in order; place may use _n, the group's rows."""
    return _placed(frame, column, by).filter((F.col("le") > place) & (F.col("le") - F.col("c") <= place)).drop("le", "c")


def higher(frame: DataFrame, column: str, share: float, by: list[str] | None = None) -> DataFrame:
    """The value at 0-based place ceil((n - 1) * share)."""
    by = by or []
    return _at(frame, column, by, F.ceil((F.col("_n") - 1) * F.lit(float(share)))).select(*by, F.col(column).alias("threshold"))


def upper(frame: DataFrame, column: str, fpr: float, by: list[str] | None = None) -> DataFrame:
    """The threshold that a share fpr of values passes: place min(n - 1, ceil((1 - fpr) * n)); the least positive number for 0."""
    if not 0 < fpr < 1:
        raise ValueError("fpr lies between 0 and 1")
    by = by or []
    found = _at(frame, column, by, F.least(F.col("_n") - 1, F.ceil(F.lit(1.0 - fpr) * F.col("_n"))))
    return found.select(*by, F.when(F.col(column) > 0, F.col(column)).otherwise(F.lit(sys.float_info.epsilon)).alias("threshold"))


def robust_reference(frame: DataFrame, column: str, share: float) -> DataFrame:
    """A percentile; where it reaches the top level, the middle of the two top levels."""
    levels = frame.groupBy(column).count().select(column)
    top = levels.orderBy(F.desc(column)).limit(2).agg(F.max(column).alias("top"), F.min(column).alias("next"), F.count("*").alias("levels"))
    found = linear(frame, column, [share]).toDF("p").crossJoin(top)
    return found.select(F.when((F.col("levels") == 2) & (F.col("p") >= F.col("top")), (F.col("top") + F.col("next")) / 2).otherwise(F.col("p")).alias("reference"))


class QuantileNormalizer:
    """Scores as mid-ranks, 0 to 1, among a reference of benign scores."""

    def __init__(self, levels: DataFrame | None = None):
        self.levels = levels

    def fit(self, reference: DataFrame, score: str = "score") -> "QuantileNormalizer":
        """Distinct levels with how many reference scores lie below and up to each; ValueError for none."""
        if reference.isEmpty():
            raise ValueError("the reference has no scores")
        levels = ranks.levels(reference.select(F.col(score).alias("level")), [], "level")
        self.levels = levels.select("level", (F.col("le") - F.col("c")).alias("lt"), "le")
        return self

    def transform(self, scores: DataFrame, score: str = "score", out: str = "norm") -> DataFrame:
        """Adds out: (less + up to) / 2 / n, null for a null score. Distinct scores are looked up, then joined back."""
        if self.levels is None:
            raise RuntimeError("fit() comes first")
        reference = self.levels.select(F.col("level").alias(score), (F.col("le") - F.col("lt")).alias("c"))
        return ranks.standing(scores, reference, score, out)
