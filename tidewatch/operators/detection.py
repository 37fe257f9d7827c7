"""Detection on trajectories: first hits, early detection, localisation, sweeps, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics, quantiles, ranks


def first_hit(series: DataFrame, threshold: Column | float, path: str = "path", turn: str = "turn", value: str = "value") -> DataFrame:
    """(path, hit): the first turn at the threshold or above, null if none."""
    at = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return series.groupBy(path).agg(F.min(F.when(F.col(value) >= at, F.col(turn))).alias("hit"))


def early_detection(series: DataFrame, share: float, by: str = "method") -> DataFrame:
    """Per method: threshold of safe peaks, tpr, mean share of the path up to the hit, mean hit turn.

    series: (path, turn, y, method, value). The threshold is the share-quantile, upper rule,
    of the peaks of safe paths (y = 0); shares and turns are means over unsafe paths hit.
    """
    peaks = series.groupBy(by, "path", "y").agg(F.max("value").alias("peak"))
    thresholds = quantiles.higher(peaks.filter("y = 0"), "peak", share, [by])
    hits = series.filter("y = 1").join(F.broadcast(thresholds), by)  # a row for each method
    hits = hits.groupBy(by, "path", "threshold").agg(F.min(F.when(F.col("value") >= F.col("threshold"), F.col("turn"))).alias("hit"), F.count("*").alias("n"))
    return hits.groupBy(by, "threshold").agg(
        (F.count("hit") / F.count("*")).alias("tpr"),
        F.avg((F.col("hit") + 1) / F.col("n")).alias("mean_fraction"),
        F.avg("hit").alias("mean_hit_turn"),
    )


def prefix_auroc(turns: DataFrame, prefixes: list[int], score: str = "score") -> DataFrame:
    """(k, auroc) of the largest score over the first k turns of each path; k = 0 for all turns."""
    peaks = turns.groupBy("path", "y").agg(*(F.max(F.when(F.col("turn") < k, F.col(score)) if k else F.col(score)).alias(f"p{k}") for k in prefixes))
    long = peaks.select("y", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("score")) for k in prefixes))).alias("p")).select("y", "p.*")
    return metrics.auroc(long.filter("score is not null"), by=["k"]).select("k", "auroc")


def threshold_sweep(scored: DataFrame, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """Counts and f1 at each threshold: scores are put in the grid's steps first, then summed from the top.

    No row is copied for each threshold; what meets the grid has at most its length of rows
    in a group.
    """
    by = by or []
    steps = F.array(*map(F.lit, grid))
    step = F.size(F.filter(steps, lambda t: t <= F.col("score"))).alias("step")
    counts = scored.groupBy(*by, step).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    groups = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.collect_list(F.struct("step", "pos", "neg")).alias("counts"))
    each = groups.select(*by, "all_pos", "all_neg", "counts", F.posexplode(steps).alias("k", "theta"))

    def above(what: str) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["step"] > F.col("k"), c[what]).otherwise(0))

    swept = each.select(*by, "theta", above("pos").alias("tp"), above("neg").alias("fp"), "all_pos", "all_neg")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")), F.lit(0.0))
    return swept.select(*by, "theta", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), f1.alias("f1"))


def out_of_fold_threshold(scored: DataFrame, grid: list[float], digits: int = 4) -> DataFrame:
    """(fold, theta, f1): for each fold the threshold of the best f1, rounded, on the others; the lowest of equals."""
    # What the others have is what all have less the fold's own, so no row is copied for a fold.
    own = threshold_sweep(scored, grid, ["fold"])
    parts = ["tp", "fp", "fn"]
    rest = own.groupBy("theta").agg(*(F.sum(c).alias(f"all_{c}") for c in parts)).join(own, "theta").select(F.col("fold").alias("held"), "theta", *((F.col(f"all_{c}") - F.col(c)).alias(c) for c in parts))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    swept = rest.withColumn("f1", F.round(f1, digits))
    best = swept.groupBy("held").agg(F.max_by(F.struct("theta", "f1"), F.struct(F.col("f1"), -F.col("theta"))).alias("b"))
    return best.select(F.col("held").alias("fold"), "b.theta", "b.f1")


def argmax_turn(turns: DataFrame, value: str = "score") -> DataFrame:
    """(path, turn) of the largest value, the first of equals."""
    return turns.groupBy("path").agg(F.max_by("turn", F.struct(F.col(value), -F.col("turn"))).alias("turn"))


def leave_one_out(turns: DataFrame, value: str = "score") -> DataFrame:
    """Adds other_mean: the mean of the path's other turns, null for a single turn."""
    path = Window.partitionBy("path")
    return turns.withColumn("other_mean", F.try_divide(F.sum(value).over(path) - F.col(value), F.count("*").over(path) - 1))


def localisation(turns: DataFrame, least_turns: int = 3) -> DataFrame:
    """One row: how well scores find the turn that overlaps most with a path's reason.

    turns: (path, turn, overlap, score). Paths need least_turns turns and an overlap above 0.
    """
    path = Window.partitionBy("path")
    best = F.max_by("turn", F.struct(F.col("overlap"), -F.col("turn"))).over(path)
    placed = leave_one_out(turns).withColumns(
        {
            "n": F.count("*").over(path), "top": F.max("overlap").over(path), "proxy": best,
            "highest": F.max_by("turn", F.struct(F.col("score"), -F.col("turn"))).over(path),
            "rank": F.row_number().over(path.orderBy("score", "turn")),
        }
    )
    chosen = placed.filter((F.col("n") >= least_turns) & (F.col("top") > 0) & (F.col("turn") == F.col("proxy")))
    return chosen.agg(
        F.count("*").alias("n"), F.avg((F.col("highest") == F.col("proxy")).cast("double")).alias("top1"), F.avg(1 / F.col("n")).alias("chance"),
        F.avg(F.col("rank") / F.col("n")).alias("mean_rank"), F.avg(F.col("score") - F.col("other_mean")).alias("delta"),
        F.avg((F.col("score") > F.col("other_mean")).cast("double")).alias("positive"),
    )


def overlaps_without(turns: DataFrame, reasons: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(path, turn, overlap) of turns with their path's reason, after the vocabulary has been taken out of both; 0 where nothing is shared.

    turns: (path, turn, words), reasons: (path, words), arrays of words; vocabulary: (term),
    say a sensor's positive terms, so that the sensor isn't held against its own words. Word
    sets are relations here: the vocabulary leaves them by an anti-join. Paths of whose
    reason no word is left have no rows.
    """
    said = turns.select("path", "turn", F.explode(F.array_distinct("words")).alias("word")).join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    meant = reasons.select("path", F.explode(F.array_distinct("words")).alias("word")).join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    sizes = meant.groupBy("path").agg(F.count("*").alias("meant"))
    counts = said.join(meant.withColumn("hit", F.lit(1)), ["path", "word"], "left").groupBy("path", "turn").agg(F.count("*").alias("said"), F.count("hit").alias("shared"))
    all_ = turns.select("path", "turn").join(sizes, "path").join(counts, ["path", "turn"], "left").fillna(0, ["said", "shared"])
    return all_.select("path", "turn", (F.col("shared") / F.greatest(F.lit(1), F.col("said") + F.col("meant") - F.col("shared"))).alias("overlap"))


def longest_control(turns: DataFrame, least_turns: int = 3) -> DataFrame:
    """localisation(), and how much of it the longest turn explains. turns: (path, turn, overlap, score, length).

    Adds argmax_longest, the share of paths whose highest turn is the longest, n_other, the
    paths whose proxy isn't the longest, and top1_other, top1 over these; null for none.
    """
    found = localisation(turns, least_turns)
    first = lambda c: F.max_by("turn", F.struct(F.col(c), -F.col("turn")))
    paths = turns.groupBy("path").agg(first("overlap").alias("proxy"), first("score").alias("highest"), first("length").alias("longest"), F.max("overlap").alias("top"), F.count("*").alias("n"))
    paths = paths.filter((F.col("n") >= least_turns) & (F.col("top") > 0))
    other = F.col("proxy") != F.col("longest")
    control = paths.agg(F.avg((F.col("highest") == F.col("longest")).cast("double")).alias("argmax_longest"), F.count_if(other).alias("n_other"), F.avg(F.when(other, (F.col("highest") == F.col("proxy")).cast("double"))).alias("top1_other"))
    return found.crossJoin(control)  # a row each


def role_hit(turns: DataFrame, role: str) -> DataFrame:
    """(n, hit, base): how often the highest turn has a role, and that role's share of turns, over paths with it."""
    path = turns.groupBy("path").agg(F.max_by("role", F.struct(F.col("score"), -F.col("turn"))).alias("top"), F.avg((F.col("role") == role).cast("double")).alias("share"))
    return path.filter("share > 0").agg(F.count("*").alias("n"), F.avg((F.col("top") == role).cast("double")).alias("hit"), F.avg("share").alias("base"))


def detection_turns(paths: DataFrame) -> DataFrame:
    """Of unsafe paths that both caught: mean turns, and how often a is before, after, with b. paths: (y, hit_a, hit_b)."""
    both = paths.filter("y = 1 and hit_a is not null and hit_b is not null")
    return both.agg(F.count("*").alias("n"), F.avg("hit_a").alias("mean_a"), F.avg("hit_b").alias("mean_b"), F.count_if(F.col("hit_a") < F.col("hit_b")).alias("faster"), F.count_if(F.col("hit_a") > F.col("hit_b")).alias("slower"), F.count_if(F.col("hit_a") == F.col("hit_b")).alias("same"))


def family_auroc(scored: DataFrame, family: str = "family") -> DataFrame:
    """(family, auroc): each family's unsafe rows against all safe rows: their mean standing among these."""
    safe = scored.filter("y = 0").groupBy("score").agg(F.count("*").alias("c"))
    unsafe = scored.filter("y = 1").groupBy(family, "score").agg(F.count("*").alias("w"))
    placed = ranks.standing(unsafe, safe, "score", "_share")
    return placed.groupBy(family).agg((F.sum(F.col("w") * F.col("_share")) / F.sum("w")).alias("auroc"))


def rank_ensemble(peaks: DataFrame, methods: list[str], reference: str) -> DataFrame:
    """Adds ensemble: the mean of each method's mid-rank among the rows where reference holds."""
    out = peaks
    for m in methods:
        norm = quantiles.QuantileNormalizer().fit(peaks.filter(reference).select(F.col(m).alias("score")))
        out = norm.transform(out, m, f"_{m}")
    total = sum((F.col(f"_{m}") for m in methods[1:]), F.col(f"_{methods[0]}"))
    return out.withColumn("ensemble", total / len(methods)).drop(*(f"_{m}" for m in methods))


def verdict(low: Column, high: Column) -> Column:
    """What an interval of a difference says."""
    return F.when(low > 0, "better").when(high < 0, "worse").otherwise("undecided")
