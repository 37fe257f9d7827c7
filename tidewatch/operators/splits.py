"""Deterministic splits: by digest, by position in a group, stratified, early and late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import position


def digest_modulus(text: Column, modulus: int) -> Column:
    """The md5 of a text, as one number, modulo a small one: Horner over its four 32-bit words."""
    digest, out = F.md5(text), F.lit(0).cast("long")
    for k in range(4):
        word = F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
        out = (out * (2**32 % modulus) + word) % modulus
    return out


def held_out(sample_id: Column) -> Column:
    """A fifth of ids, by digest."""
    return digest_modulus(sample_id, 100) < 20


def risk_group(source: Column, should_block: Column, direct: list[str], indirect: list[str], benign: list[str] | None = None) -> Column:
    """direct_ or indirect_, safe or unsafe, or benign_pure; with benign given, other sources are errors."""
    kind = F.when(should_block, "unsafe").otherwise("safe")
    out = F.when(source.isin(direct), F.concat(F.lit("direct_"), kind)).when(source.isin(indirect), F.concat(F.lit("indirect_"), kind))
    if benign is None:
        return out.otherwise("benign_pure")
    return out.when(source.isin(benign), "benign_pure").otherwise(F.raise_error(F.concat(F.lit("unknown risk source: "), source)).cast("string"))


def hashed(key: Column) -> Column:
    """32 bits of a key's md5, the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def group_folds(frame: DataFrame, group: str, key: str, k: int = 5) -> DataFrame:
    """Adds fold: the place in the group, by number, modulo k."""
    return position(frame, [group], [F.col(key).cast("long")]).withColumn("fold", F.col("pos") % k).drop("pos")


def shuffled_folds(frame: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """Adds fold, stratified by label, in the order of a hash."""
    return position(frame, [label], [hashed(F.col(key)), F.col(key)]).withColumn("fold", F.col("pos") % k).drop("pos")


def halves(frame: DataFrame, key: str) -> DataFrame:
    """Adds calibration: the first half, rounded down, in the order of a hash."""
    n = frame.agg(F.count("*").alias("_n"))  # a row
    placed = position(frame.withColumn("_h", hashed(F.col(key))), [], ["_h", key], "_k").crossJoin(n)
    return placed.withColumn("calibration", F.col("_k") < F.floor(F.col("_n") / 2)).drop("_h", "_k", "_n")


def early_late(frame: DataFrame, group: str, key: str, early: int | None = None) -> DataFrame:
    """Adds segment: early for the first rows of a group, or, without a number, for even places."""
    placed = position(frame, [group], [F.col(key).cast("long")])
    first = F.col("pos") % 2 == 0 if early is None else F.col("pos") < early
    return placed.withColumn("segment", F.when(first, "early").otherwise("late")).drop("pos")


def leave_family_out(frame: DataFrame, family: str, unsafe: str, key: str) -> DataFrame:
    """A row for each family and sample: role train, test, or none.

    Trained on the other families' unsafe samples and half of the safe ones, tested on
    the family's own and the other half.
    """
    safe = halves(frame.filter(f"not {unsafe}").select(key), key)
    families = frame.filter(unsafe).select(F.col(family).alias("held_family")).distinct()
    marked = frame.join(safe, key, "left").crossJoin(families)
    role = F.when(F.col(unsafe), F.when(F.col(family) == F.col("held_family"), "test").otherwise("train")).otherwise(F.when(F.col("calibration"), "train").otherwise("test"))
    return marked.select("held_family", key, role.alias("role"))


def terciles(frame: DataFrame, order: list[str]) -> DataFrame:
    """Adds tercile 0, 1 or 2: sizes n // 3, n // 3 and the rest."""
    n = frame.agg(F.floor(F.count("*") / 3).alias("_third"))  # a row
    ranked = position(frame, [], order, "_k").crossJoin(n)
    return ranked.withColumn("tercile", F.least(F.lit(2), F.floor(F.col("_k") / F.greatest(F.col("_third"), F.lit(1)))).cast("int")).drop("_k", "_third")
