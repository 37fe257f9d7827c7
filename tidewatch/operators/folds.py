"""Ordered statistics of a path's scores: windows where a closed form holds, folds elsewhere.

Each statistic is defined once, as a start and a step on columns. The same step is used
for peaks, for series, and for runs that start anew after each trip.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import checkpointed


@dataclass(frozen=True)
class Statistic:
    """step(state, score, dt) gives the next state; a state is a struct with first and value. params: what step depends on."""

    name: str
    threshold: float
    start: dict[str, float]
    step: Callable[[Column, Column, Column], dict[str, Column]]
    params: dict[str, float]

    def initial(self) -> Column:
        return F.struct(F.lit(True).alias("first"), *(F.lit(float(v)).alias(k) for k, v in {"value": 0.0, **self.start}.items()))

    def after(self, state: Column, score: Column, dt: Column) -> Column:
        made = self.step(state, score, dt)
        return F.struct(F.lit(False).alias("first"), *(made[k].alias(k) for k in ["value", *self.start]))


def i2t(tau: float = 5.0, theta: float = 0.9, threshold: float = 0.3) -> Statistic:
    if tau <= 0:
        raise ValueError("tau must be above 0")

    def step(s: Column, x: Column, dt: Column) -> dict[str, Column]:
        over = F.greatest(F.lit(0.0), x - F.lit(theta))
        return {"value": F.when(s["first"], s["value"]).otherwise(s["value"] * F.exp(-dt / F.lit(tau))) + over * over}

    return Statistic("i2t", threshold, {}, step, {"tau": tau, "theta": theta})


def cusum(k_ref: float = 0.75, threshold: float = 2.0) -> Statistic:
    return Statistic("cusum", threshold, {}, lambda s, x, dt: {"value": F.greatest(F.lit(0.0), s["value"] + (x - F.lit(k_ref)))}, {"k_ref": k_ref})


def ewma(alpha: float = 0.3, threshold: float = 0.9) -> Statistic:
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies above 0 and up to 1")
    return Statistic("ewma", threshold, {}, lambda s, x, dt: {"value": F.when(s["first"], x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * s["value"])}, {"alpha": alpha})


def kalman_slope(q_level: float = 1e-3, q_slope: float = 1e-4, r_obs: float = 0.05, threshold: float = 2.5) -> Statistic:
    """Standardised upward slope of a local linear trend; the 2 x 2 algebra is written out."""

    def step(s: Column, x: Column, dt: Column) -> dict[str, Column]:
        level = s["level"] + s["slope"]
        p00 = s["p00"] + s["p10"] + s["p01"] + s["p11"] + F.lit(q_level)
        p01, p10, p11 = s["p01"] + s["p11"], s["p10"] + s["p11"], s["p11"] + F.lit(q_slope)
        noise = p00 + F.lit(r_obs)
        k0, k1, miss = p00 / noise, p10 / noise, x - level
        new = {"level": level + k0 * miss, "slope": s["slope"] + k1 * miss, "p00": p00 - k0 * p00, "p01": p01 - k0 * p01, "p10": p10 - k1 * p00, "p11": p11 - k1 * p01}
        begun = {"level": x, "slope": F.lit(0.0), "p00": s["p00"], "p01": s["p01"], "p10": s["p10"], "p11": s["p11"]}
        out = {k: F.when(s["first"], begun[k]).otherwise(new[k]) for k in new}
        out["value"] = F.greatest(F.lit(0.0), out["slope"] / F.sqrt(F.greatest(out["p11"], F.lit(1e-12))))
        return out

    return Statistic("kalman_slope", threshold, {"level": 0.0, "slope": 0.0, "p00": 1.0, "p01": 0.0, "p10": 0.0, "p11": 1.0}, step, {"q_level": q_level, "q_slope": q_slope, "r_obs": r_obs})


STATISTICS = {"i2t": i2t, "cusum": cusum, "ewma": ewma, "kalman_slope": kalman_slope}


def make_statistic(name: str, **options: float) -> Statistic:
    if name not in STATISTICS:
        raise ValueError(f"unknown statistic {name!r}; known: {sorted(STATISTICS)}")
    return STATISTICS[name](**options)


def with_dt(scores: DataFrame, path: str = "path", t: str = "t", tie: str = "seq") -> DataFrame:
    """Adds dt: 1 for a path's first row, else the time since the row before, at least 0."""
    before = F.lag(t).over(Window.partitionBy(path).orderBy(t, tie))
    return scores.withColumn("dt", F.coalesce(F.greatest(F.lit(0.0), F.col(t) - before), F.lit(1.0)))


def ordered(scores: DataFrame, path: str = "path", t: str = "t", tie: str = "seq", score: str = "score", extra: list[str] | None = None) -> DataFrame:
    """One row a path with obs, its rows (t, seq, x, dt) in order: a path is what a fold holds in memory."""
    row = F.struct(F.col(t).alias("t"), F.col(tie).alias("seq"), F.col(score).alias("x"), "dt")
    return with_dt(scores, path, t, tie).groupBy(path, *(extra or [])).agg(F.sort_array(F.collect_list(row)).alias("obs"))


def peak(stat: Statistic, obs: str = "obs") -> Column:
    """The largest value along obs, at least 0, without starting anew."""
    start = F.struct(stat.initial().alias("s"), F.lit(0.0).alias("peak"))

    def step(acc: Column, o: Column) -> Column:
        s = stat.after(acc["s"], o["x"], o["dt"])
        return F.struct(s.alias("s"), F.greatest(acc["peak"], s["value"]).alias("peak"))

    return F.aggregate(obs, start, step, lambda acc: acc["peak"])


def last_value(stat: Statistic, obs: str = "obs") -> Column:
    return F.aggregate(obs, stat.initial(), lambda s, o: stat.after(s, o["x"], o["dt"]), lambda s: s["value"])


def series(scores: DataFrame, stat: Statistic, path: str = "path", t: str = "t", tie: str = "seq", score: str = "score", reset_on_trip: bool = False) -> DataFrame:
    """(path, seq, t, value, tripped) for each row, by a fold over each path's rows.

    With reset_on_trip the state starts anew after a value of the threshold or more; the
    time of the last row is kept. A fold in Python over one path at a time takes any length
    without growing arrays.
    """
    rows = with_dt(scores, path, t, tie).select(F.col(path).cast("string").alias("path"), F.col(t).cast("double").alias("t"), F.col(tie).cast("long").alias("seq"), F.col(score).cast("double").alias("x"), "dt")
    from .stats import stepper

    make, threshold = stepper(stat), stat.threshold

    def fold(pdf):
        pdf = pdf.sort_values(["t", "seq"], kind="stable")
        update, reset = make()
        values, trips = [], []
        for x, dt in zip(pdf["x"].to_numpy(), pdf["dt"].to_numpy()):
            values.append(update(float(x), float(dt)))
            trips.append(values[-1] >= threshold)
            if trips[-1] and reset_on_trip:
                reset()
        return pdf[["path", "seq", "t"]].assign(value=values, tripped=trips)

    return rows.groupBy("path").applyInPandas(fold, "path string, seq long, t double, value double, tripped boolean")


def running(scores: DataFrame, path: str = "path", t: str = "t", tie: str = "seq", score: str = "score", k_ref: float = 0.75) -> DataFrame:
    """Adds running_max, running_mean and cusum (no resets): windows that share one sort."""
    order = Window.partitionBy(path).orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)
    summed = scores.withColumn("_p", F.sum(F.col(score) - F.lit(k_ref)).over(order))
    return summed.select(
        "*", F.max(score).over(order).alias("running_max"), F.avg(score).over(order).alias("running_mean"),
        (F.col("_p") - F.least(F.lit(0.0), F.min("_p").over(order))).alias("cusum"),
    ).drop("_p")


def trips(stat: Statistic, obs: str = "obs") -> Column:
    """Places (from 0) in obs where the statistic reaches its threshold and starts anew."""
    start = F.struct(stat.initial().alias("s"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("trips"))

    def step(acc: Column, o: Column) -> Column:
        s = stat.after(acc["s"], o["x"], o["dt"])
        hit = s["value"] >= F.lit(stat.threshold)
        return F.struct(F.when(hit, stat.initial()).otherwise(s).alias("s"), (acc["k"] + 1).alias("k"), F.when(hit, F.array_append(acc["trips"], acc["k"])).otherwise(acc["trips"]).alias("trips"))

    return F.aggregate(obs, start, step, lambda acc: acc["trips"])


def best_statistic(paths: DataFrame, label: str = "y", candidates: tuple[str, ...] = ("i2t", "cusum", "ewma")) -> DataFrame:
    """(stat, auroc, best) of peaks of each candidate; the first of equals is best."""
    from .metrics import auroc

    long = paths.select(F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(n).alias("stat"), peak(make_statistic(n)).alias("score")) for k, n in enumerate(candidates)))).alias("p")).select("y", "p.*")
    found = auroc(long, by=["place", "stat"])
    order = Window.orderBy(F.desc_nulls_last("auroc"), "place")  # a row for each candidate
    return found.select("stat", "auroc", (F.row_number().over(order) == 1).alias("best"))


def replayed(stat: Statistic, obs: str = "obs") -> Column:
    """(peak, first_trip, trips) along obs with each row's own dt: peak and first trip outlive the statistic's resets; first_trip is a place from 0."""
    start = F.struct(stat.initial().alias("s"), F.lit(0).alias("k"), F.lit(0.0).alias("peak"), F.lit(None).cast("int").alias("first_trip"), F.lit(0).alias("trips"))

    def step(acc: Column, o: Column) -> Column:
        s = stat.after(acc["s"], o["x"], o["dt"])
        hit = s["value"] >= F.lit(stat.threshold)
        return F.struct(
            F.when(hit, stat.initial()).otherwise(s).alias("s"), (acc["k"] + 1).alias("k"), F.greatest(acc["peak"], s["value"]).alias("peak"),
            F.coalesce(acc["first_trip"], F.when(hit, acc["k"])).alias("first_trip"), (acc["trips"] + hit.cast("int")).alias("trips"),
        )

    return F.aggregate(obs, start, step, lambda acc: F.struct(acc["peak"].alias("peak"), acc["first_trip"].alias("first_trip"), acc["trips"].alias("trips")))


def replay_difference(scores: DataFrame, stat: Statistic) -> DataFrame:
    """(max_difference, mismatches, paths): the fold on columns against the plain loop, over the same rows.

    max_difference is the largest gap of a path's peak, mismatches the paths whose first trip
    or number of trips differ. Both evaluations are rows, joined by path.
    """
    a = ordered(scores).select("path", replayed(stat).alias("a")).select("path", "a.*")
    turns = series(scores, stat, reset_on_trip=True)
    placed = turns.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("t", "seq")) - 1)
    b = placed.groupBy("path").agg(F.greatest(F.lit(0.0), F.max("value")).alias("peak_b"), F.min(F.when(F.col("tripped"), F.col("k"))).alias("first_b"), F.count_if("tripped").alias("trips_b"))
    both = a.join(b, "path", "full_outer")
    same = F.col("first_trip").eqNullSafe(F.col("first_b")) & F.col("trips").eqNullSafe(F.col("trips_b"))
    return both.agg(F.max(F.coalesce(F.abs(F.col("peak") - F.col("peak_b")), F.lit(float("inf")))).alias("max_difference"), F.count_if(~same).alias("mismatches"), F.count("*").alias("paths"))


def memory_peaks(paths: DataFrame, grid: DataFrame, most: int, obs: str = "obs") -> DataFrame:
    """(path, y, fold, held, place, peak): the thermal peak of each path under each row of grid, all in one fold over the path.

    grid: (held, place, theta, tau), at most `most` rows, which each path's fold carries as an
    array; turns are one apart in time.
    """
    points = grid.agg(F.sort_array(F.collect_list(F.struct("held", "place", "theta", "tau"))).alias("grid"))
    points = points.withColumn("grid", F.when(F.size("grid") <= most, F.col("grid")).otherwise(F.raise_error(F.lit(f"the grid has more than {most} points")).cast(points.schema["grid"].dataType)))
    start = F.transform("grid", lambda g: F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("peak")))

    def step(acc: Column, o: Column) -> Column:
        def one(a: Column, g: Column) -> Column:
            over = F.greatest(F.lit(0.0), o["x"] - g["theta"])
            v = a["v"] * F.exp(-1 / g["tau"]) + over * over
            return F.struct(v.alias("v"), F.greatest(a["peak"], v).alias("peak"))

        return F.zip_with(acc, "grid", one)

    folded = paths.crossJoin(points).withColumn("peaks", F.aggregate(obs, start, step))  # a row
    each = folded.select("path", "y", "fold", F.explode(F.arrays_zip(F.col("grid").alias("g"), F.transform("peaks", lambda p: p["peak"]).alias("peak"))).alias("x"))
    return each.select("path", "y", "fold", "x.g.held", "x.g.place", "x.peak")


def grid_search(paths: DataFrame, folds: int, percents: list[float], taus: list[float]) -> DataFrame:
    """(fold, percent, tau, theta, train_auroc, test_auroc): of each fold the best pair on the others, and how it does on the fold.

    paths: (path, y, fold, obs). theta is a percentile of the safe scores of the other folds;
    the best pair has the largest AUROC of peaks there, the first of equals, percents outside.
    """
    from . import metrics, quantiles

    numbers = F.array(*(F.lit(k) for k in range(folds)))
    safe = paths.filter("y = 0").select("fold", F.explode("obs").alias("o")).select("fold", F.col("o.x").alias("x"))
    others = safe.select(F.explode(F.filter(numbers, lambda k: k != F.col("fold"))).alias("held"), "x")
    cuts = quantiles.linear(others, "x", [p / 100 for p in percents], ["held"])
    pairs = F.array(*(F.struct(F.lit(i * len(taus) + j).alias("place"), F.lit(float(p)).alias("percent"), F.col(f"p{round(p)}").alias("theta"), F.lit(float(tau)).alias("tau")) for i, p in enumerate(percents) for j, tau in enumerate(taus)))
    grid = cuts.select("held", F.explode(pairs).alias("g")).select("held", "g.*")
    grid = checkpointed(grid)
    peaks = checkpointed(memory_peaks(paths, grid, folds * len(percents) * len(taus)).withColumn("peak", F.round("peak", 9)))
    train = metrics.auroc(peaks.filter("fold != held"), by=["held", "place"], score="peak", degenerate=0.5)
    best = train.groupBy("held").agg(F.max_by(F.struct("place", "auroc"), F.struct(F.col("auroc"), -F.col("place"))).alias("b")).select("held", "b.place", F.col("b.auroc").alias("train_auroc"))
    test = metrics.auroc(peaks.filter("fold = held").join(best, ["held", "place"]), by=["held"], score="peak", degenerate=0.5)
    return best.join(grid, ["held", "place"]).join(test.select("held", F.col("auroc").alias("test_auroc")), "held", "left").select(F.col("held").alias("fold"), "percent", "tau", "theta", "train_auroc", "test_auroc")
