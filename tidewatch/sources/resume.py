"""Results by fold that are made once: a fold is computed again only if its input has changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .readers import exists


@dataclass(frozen=True)
class Resumable:
    """A folder of results, partitioned by fold, and commits that name the folds that are done with a digest of their input.

    Data is written before the commit, so a run that dies in between does its folds again;
    a fold's files are replaced as a whole.
    """

    folder: str
    by: str = "fold"

    def digests(self, inputs: DataFrame) -> DataFrame:
        """(fold, digest): the rows of each fold, in any order, repeats counted."""
        row = F.xxhash64(*(F.col(c) for c in sorted(inputs.columns)))
        both = F.concat_ws(":", F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)")).cast("string"))
        return inputs.groupBy(self.by).agg(both.alias("digest"))

    def done(self, spark: SparkSession) -> DataFrame:
        """(fold, digest) of the last commit of each fold."""
        path = f"{self.folder}/commits"
        if not exists(spark, f"{path}/*"):
            return spark.createDataFrame([], f"{self.by} string, digest string")
        last = Window.partitionBy(self.by).orderBy(F.desc("commit"))
        rows = spark.read.parquet(path).withColumn("_k", F.row_number().over(last)).filter("_k = 1")
        return rows.select(F.col(self.by).cast("string").alias(self.by), "digest")

    def run(self, inputs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Computes and writes the folds whose input isn't that of their last commit; which they are. make keeps the fold's column.

        Folds, not rows, are collected: there are as many as there are models to fit.
        """
        spark = inputs.sparkSession
        now = self.digests(inputs).withColumn(self.by, F.col(self.by).cast("string"))
        stale = now.join(self.done(spark), [self.by, "digest"], "left_anti").orderBy(self.by).collect()
        if not stale:
            return []
        folds = [r[self.by] for r in stale]
        made = make(inputs.filter(F.col(self.by).cast("string").isin(folds)))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(f"{self.folder}/data")
        commit = 1 + (spark.read.parquet(f"{self.folder}/commits").agg(F.max("commit")).first()[0] if exists(spark, f"{self.folder}/commits/*") else 0)
        spark.createDataFrame([(r[self.by], r.digest, commit) for r in stale], f"{self.by} string, digest string, commit long").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return folds

    def read(self, spark: SparkSession) -> DataFrame:
        """The results of committed folds."""
        data = spark.read.option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data")
        done = self.done(spark).select(F.col(self.by).alias("_done"))
        return data.join(done, F.col(self.by).cast("string") == F.col("_done"), "left_semi")
