"""Running totals, places and mid-ranks in order, with no task that holds a whole group.

Rows are dealt into ranges of their order by Spark's sampled range partitioning and written
there, so that each partition is a stretch of the order. What lies before a stretch comes
from the stretches' own totals, of which there are as many as partitions, and one more for
each further group that begins in a stretch. Windows then run inside of a stretch only.
Neither side of a join here has a bound, so none is broadcast.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written to spark.checkpoint.dir; a local session without it gets a folder of its own."""
    sc = frame.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-ranks-"))
    return frame.checkpoint()


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"_{n}_"])
    return out


def running(frame: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row the sums of its group's rows up to it in order, itself included.

    by: the group's columns, null being a group. order needs to be total: rows that are equal
    in it have an arbitrary order among themselves. Sums are of integers, nulls count as 0.
    """
    inputs = {f"_in_{name}": F.coalesce(c.cast("long"), F.lit(0)) for name, c in sums.items()}
    placed = frame.withColumns(inputs).repartitionByRange(*by, *order) if by or order else frame.withColumns(inputs)
    # The sampled bounds of ranges differ from run to run, so they are made once.
    placed = checkpointed(placed.withColumn("_part", F.spark_partition_id()))
    own = placed.groupBy("_part", *by).agg(*(F.sum(f"_in_{name}").alias(f"_of_{name}") for name in sums))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.select("_part", *by, *(F.coalesce(F.sum(f"_of_{name}").over(before), F.lit(0)).alias(f"_in_{name}") for name in sums), F.lit(False).alias("_row"))
    # What lies before a stretch is its first row: a join would broadcast either side through the driver.
    rows = placed.withColumn("_row", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    here = Window.partitionBy("_part", *by).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(f"_in_{name}").over(here) for name in sums}).filter("_row").select(*frame.columns, *sums)


def position(frame: DataFrame, by: list[str], order: list[Column | str], out: str = "pos") -> DataFrame:
    """Adds the place, from 0, within a group."""
    return running(frame, by, order, {out: F.lit(1)}).withColumn(out, F.col(out) - 1)


def levels(frame: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(by, value, c, le): distinct values with their weight, rows by default, and that of all values up to it; null values have none."""
    counted = frame.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("c"))
    return running(counted, by, [value], {"le": F.col("c")})


def standing(asked: DataFrame, reference: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds out to asked: the share of its group's reference that lies below value, equal ones counted half.

    reference: (by, value, c), c the weight of a value. Distinct values of both sides are put
    in order together, so each is looked up once; null for a null value, and where the group
    has no reference.
    """
    by = by or []
    both = reference.select(*by, value, F.col("c").cast("long").alias("c"), F.lit(False).alias("asked")).unionByName(asked.select(*by, value).distinct().withColumn("c", F.lit(0).cast("long")).withColumn("asked", F.lit(True)))
    both = both.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum("c").alias("c"), F.max("asked").alias("asked"))
    found = running(both, by, [value], {"le": F.col("c")}).filter("asked")
    total = reference.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.sum("c").alias("_total")).select(*(F.col(n).alias(f"_{n}_") for n in by), "_total")
    found = found.join(total, _same(found, total, by)) if by else found.crossJoin(total)  # a row
    share = F.try_divide((2 * F.col("le") - F.col("c")) / 2.0, F.col("_total"))
    found = found.select(*(F.col(n).alias(f"_{n}_") for n in [*by, value]), share.alias(out))
    return asked.join(found.hint("merge"), _same(asked, found, [*by, value]), "left").select(*asked.columns, out)
