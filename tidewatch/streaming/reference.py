"""A reference of benign scores that raw scores of a stream, or a table, are placed in by an interval join.

Two neighbouring levels of the reference bound an interval, in which all scores have one
share of the reference below them. The line is cut into as many buckets as there are some
levels, and intervals are listed under the buckets that they reach: a row for each level and
bucket at most. Scores meet their bucket's intervals by an equi-join, so neither side is
held whole by a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import checkpointed

#: Levels of a bucket, in the mean.
EACH = 64


@dataclass(frozen=True)
class Reference:
    """intervals: (bucket, low, high, equal, above): the share at low itself, and between low and high; version goes with each score."""

    version: int
    intervals: DataFrame
    start: float
    width: float
    buckets: int

    @classmethod
    def of(cls, levels: DataFrame, version: int = 1) -> Reference:
        """levels: (level, lt, le) of a fitted QuantileNormalizer; ValueError for none."""
        ends = levels.agg(F.min("level").alias("low"), F.max("level").alias("high"), F.max("le").alias("n"), F.count("*").alias("levels")).first()
        if not ends.levels:
            raise ValueError("the reference has no scores")
        buckets = 1 + ends.levels // EACH
        made = cls(version, levels, float(ends.low), (float(ends.high) - float(ends.low)) / buckets or 1.0, buckets)
        # As many scores lie below the next level as up to this one.
        after = levels.select(F.col("lt").alias("le"), F.col("level").alias("high"))
        n = F.lit(float(ends.n))
        spans = levels.join(after, "le", "left").select(F.col("level").cast("double").alias("low"), F.col("high").cast("double").alias("high"), ((F.col("lt") + F.col("le")) / 2.0 / n).alias("equal"), (F.col("le") / n).alias("above"))
        least = levels.sparkSession.createDataFrame([(float("-inf"), float(ends.low), 0.0, 0.0)], spans.schema)
        spans = spans.unionByName(least)
        reached = F.sequence(made._bucket(F.col("low")), F.when(F.col("high").isNull(), F.lit(buckets - 1)).otherwise(made._bucket(F.col("high"))))
        return cls(version, checkpointed(spans.select(F.explode(reached).alias("bucket"), "*")), made.start, made.width, buckets)

    def _bucket(self, score: Column) -> Column:
        place = F.floor((F.greatest(score, F.lit(self.start)) - F.lit(self.start)) / F.lit(self.width))
        return F.least(place, F.lit(self.buckets - 1)).cast("int")

    def placed(self, scores: DataFrame, score: str = "score", out: str = "norm") -> DataFrame:
        """Adds out: the share of the reference below score, equal ones counted half; null for null and NaN."""
        s = F.when(~F.isnan(score), F.col(score).cast("double"))
        asked = scores.withColumn("_score", s).withColumn("_bucket", self._bucket(F.col("_score")))
        here = (F.col("_bucket") == F.col("bucket")) & (F.col("_score") >= F.col("low")) & (F.col("high").isNull() | (F.col("_score") < F.col("high")))
        met = asked.join(self.intervals, here, "left")
        return met.select(*scores.columns, F.when(F.col("_score") == F.col("low"), F.col("equal")).otherwise(F.col("above")).alias(out))
