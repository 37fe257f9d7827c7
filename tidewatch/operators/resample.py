"""Bootstrap by hashed draws: replicates are rows, and draws are weights on distinct outcomes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics
from .ranks import checkpointed, position, standing
from .splits import hashed


def numbered(frame: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Adds pos, the place in order of key, from which draws pick."""
    return position(frame, by or [], [key])


#: Draws that one row stands for until they are made, and that one task makes.
CHUNK, TASK = 10_000, 500_000
#: Places whose bits are one row, and the rows up to whose number bits are broadcast (32 MB).
BLOCK, BITS = 65_536, 2**28


def places(sizes: DataFrame, replicates: int, by: list[str] | None = None, salt: str = "") -> DataFrame:
    """(b, by..., pos): a row for each draw, made in the task that it was dealt to.

    sizes: (by..., n). Draw k of replicate b takes place md5(salt b:k) mod n, so any engine
    draws alike. Rows stand for up to CHUNK draws and are dealt out before these are made,
    to as many tasks as there are TASK draws.
    """
    by = by or []
    total = replicates * (sizes.agg(F.sum("n").alias("n")).first().n or 0)
    # The number is fixed: so few small rows would be put into one task by adaptive execution.
    tasks = max(sizes.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK).cast("long"))
    each = sizes.filter("n > 0").select(*by, "n", F.explode(chunks).alias("_chunk"))
    each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("b")).repartition(tasks, "b", "_chunk", *by)
    start = F.col("_chunk") * CHUNK
    each = each.withColumn("k", F.explode(F.sequence(start, F.least(start + CHUNK, F.col("n")) - 1)))
    text = F.concat(F.lit(salt), *(F.concat(F.col(c).cast("string"), F.lit(":")) for c in by), F.col("b").cast("string"), F.lit(":"), F.col("k").cast("string"))
    return each.select("b", *by, F.pmod(hashed(text), F.col("n")).alias("pos"))


def draws(sizes: DataFrame, replicates: int, by: list[str] | None = None, salt: str = "") -> DataFrame:
    """(b, by..., pos, w): how often replicate b draws each place, with replacement; shuffled once, by place."""
    by = by or []
    made = places(sizes, replicates, by, salt).repartition(*by, "pos")
    return made.groupBy("b", *by, "pos").agg(F.count("*").alias("w"))


def drawn(placed: DataFrame, replicates: int, by: list[str] | None = None, salt: str = "") -> DataFrame:
    """Draws with the columns of the rows at their places. placed: (by..., pos, ...)."""
    by = by or []
    sizes = placed.groupBy(*by).agg(F.count("*").alias("n"))
    # Spark takes the draws for as small as the sizes they are made from, and would broadcast them.
    return draws(sizes, replicates, by, salt).join(placed.hint("merge"), [*by, "pos"])


def interval(values: DataFrame, column: str, level: float = 0.95) -> list[Column]:
    tail = (1 - level) / 2
    return [F.percentile(column, F.lit(tail)).alias(f"{column}_low"), F.percentile(column, F.lit(1 - tail)).alias(f"{column}_high")]


def bits(placed: DataFrame, flag: str) -> DataFrame:
    """(block, words): a bit for each place, set where flag is 1; 64 places in a number, BLOCK in a row."""
    bit = F.when(F.col(flag) == 1, F.expr("shiftleft(1L, cast(pos % 64 as int))")).otherwise(0)
    words = placed.groupBy(F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    # Places have no gaps, so neither have words.
    rows = words.groupBy(F.expr(f"word div {BLOCK // 64}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return rows.select("block", F.transform("words", lambda w: w["bits"]).alias("words"))


def bootstrap_rate(frame: DataFrame, hit: Column, key: str, replicates: int, salt: str = "") -> DataFrame:
    """(low, high) of the share of rows with hit, by the percentile method; 0 and 0 for no rows.

    Up to BITS rows, draws look their hits up in the tasks that make them, and only the sums
    of replicates are shuffled; beyond that draws are joined by place.
    """
    # Places are in the order of ranges, which is dealt once.
    placed = checkpointed(numbered(frame.withColumn("_hit", F.coalesce(hit.cast("int"), F.lit(0))), key).select("pos", "_hit"))
    sizes = placed.agg(F.count("*").alias("n"))
    if sizes.first().n <= BITS:
        word = F.get("words", F.expr(f"cast(pos % {BLOCK} div 64 as int)"))
        # Each place has its block; an inner join would make every digest once more, to see whether it is null.
        found = places(sizes, replicates, salt=salt).join(F.broadcast(bits(placed, "_hit")), F.expr(f"pos div {BLOCK}") == F.col("block"), "left")
        shares = found.groupBy("b").agg(F.avg(F.getbit(word, F.expr("cast(pos % 64 as int)"))).alias("share"))
    else:
        shares = drawn(placed, replicates, salt=salt).groupBy("b").agg((F.sum(F.col("w") * F.col("_hit")) / F.sum("w")).alias("share"))
    return shares.agg(F.coalesce(F.percentile("share", F.lit(0.025)), F.lit(0.0)).alias("low"), F.coalesce(F.percentile("share", F.lit(0.975)), F.lit(0.0)).alias("high"))


def bootstrap_auroc(frame: DataFrame, key: str, replicates: int, scores: list[str], salt: str = "", by: list[str] | None = None) -> DataFrame:
    """(b, by..., one AUROC for each score) over replicates; all scores see the same draws.

    A replicate of one class alone has nulls. by: strata that are resampled on their own.
    """
    by = by or []
    placed = numbered(frame.select(*by, key, "y", *scores), key, by)
    # Draws are made once for all scores.
    pairs = F.array(*(F.struct(F.lit(i).alias("_which"), F.col(s).alias("_value")) for i, s in enumerate(scores)))
    long = drawn(placed, replicates, by, salt).select("b", *by, "y", "w", F.explode(pairs).alias("_pair")).select("b", *by, "y", "w", "_pair.*")
    found = metrics.auroc(long, by=["b", *by, "_which"], score="_value", weight="w")
    return found.groupBy("b", *by).agg(*(F.max(F.when(F.col("_which") == i, F.col("auroc"))).alias(s) for i, s in enumerate(scores)))


def paired_delta(frame: DataFrame, key: str, a: str, b: str, replicates: int, salt: str = "", by: list[str] | None = None) -> DataFrame:
    """Mean, interval and P(> 0) of AUROC(a) - AUROC(b); replicates of one class alone are left out."""
    by = by or []
    deltas = bootstrap_auroc(frame, key, replicates, [a, b], salt, by).select(*by, (F.col(a) - F.col(b)).alias("delta")).filter("delta is not null")
    return deltas.groupBy(*by).agg(F.count("*").alias("replicates"), F.avg("delta").alias("mean_delta"), *interval(deltas, "delta"), F.avg((F.col("delta") > 0).cast("double")).alias("p_positive"))


def cluster_delta(frame: DataFrame, key: str, family: str, a: str, b: str, replicates: int) -> DataFrame:
    """As paired_delta(), of the mean over families: safe rows are drawn once a replicate and shared, unsafe ones within their family."""
    safe = numbered(frame.filter("y = 0").select(key, a, b), key)
    unsafe = numbered(frame.filter("y = 1").select(key, family, a, b), key, [family])
    # Both are read several times below, for each score.
    drawn_safe = checkpointed(drawn(safe, replicates, salt="safe:"))
    drawn_unsafe = checkpointed(drawn(unsafe, replicates, [family]))
    out = None
    for s in (a, b):
        # An AUROC is the mean standing of unsafe rows among safe ones: no family meets a copy of the safe rows.
        levels = drawn_safe.groupBy("b", s).agg(F.sum("w").alias("c"))
        own = drawn_unsafe.groupBy("b", family, s).agg(F.sum("w").alias("w"))
        placed = standing(own, levels, s, "_share", ["b"])
        one = placed.groupBy("b", family).agg((F.sum(F.col("w") * F.col("_share")) / F.sum("w")).alias(s))
        out = one if out is None else out.join(one, ["b", family])
    means = out.groupBy("b").agg(F.avg(F.col(a) - F.col(b)).alias("delta")).filter("delta is not null")
    return means.agg(F.count("*").alias("replicates"), F.avg("delta").alias("mean_delta"), *interval(means, "delta"), F.avg((F.col("delta") > 0).cast("double")).alias("p_positive"))


def numpy_rate_intervals(spark: SparkSession, decisions: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Intervals of asr, orr and escalation_rate from one generator of numpy, drawn in sample order.

    The draws of one seed can't be split, so one task makes them; it gets one small number
    for each sample. decisions: (ordinal, should_block, decision).
    """
    rows = decisions.select("ordinal", F.col("should_block").cast("int").alias("y"), F.when(F.col("decision") == "allow", 0).when(F.col("decision") == "block", 1).otherwise(2).alias("d"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ordinal")
        y, d = pdf["y"].to_numpy(), pdf["d"].to_numpy()
        parts = [(d[y == 1] == 0), (d[y == 0] != 0), (d == 2)]
        rng = np.random.default_rng(seed)
        shares = np.zeros((replicates, 3))
        for i in range(replicates):
            for k, p in enumerate(parts):
                if len(p):
                    shares[i, k] = p[rng.choice(len(p), size=len(p), replace=True)].mean()
        low, high = np.percentile(shares, [2.5, 97.5], axis=0)
        return pd.DataFrame({"rate": ["asr", "orr", "escalation_rate"], "low": low, "high": high})

    return rows.groupBy().applyInPandas(run, "rate string, low double, high double")


def synthetic_paths(spark: SparkSession, n: int, turns: int = 12, seed: int = 42) -> DataFrame:
    """(path, turn, y, score): n calm paths and n with a plateau, whose largest scores are alike."""
    rows = spark.range(2 * n).select(F.col("id").alias("path"), (F.col("id") % 2).cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    at = F.pmod(F.xxhash64("path", F.lit(seed)), F.lit(turns))
    base = F.when(F.col("y") == 1, 0.55 + 0.03 * F.randn(seed)).otherwise(0.22 + 0.05 * F.randn(seed))
    return rows.withColumn("score", F.when(F.col("turn") == at, 0.62 + 0.08 * F.rand(seed)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))))
