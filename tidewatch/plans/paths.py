"""Queries of ordered statistics on paths, of trips, and of detection on trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import decisions, detection, folds, metrics, quantiles
from ..sources.tables import score_stream, turns
from .registry import query
from .scalar import words_sql

#: Events as scores, normalised among those of even users.
N = """e AS (SELECT user_id::VARCHAR AS path, epoch_us(ts) / 1e6 AS t, event_id AS seq, value AS raw, event_type, (user_id % 2)::INT AS y FROM events),
c AS (SELECT raw AS level, count(*) AS c FROM e WHERE y = 0 GROUP BY raw),
l AS (SELECT level, sum(c) OVER (ORDER BY level) - c AS lt, sum(c) OVER (ORDER BY level) AS le, sum(c) OVER () AS n FROM c),
n AS (SELECT e.*, CASE WHEN l.level IS NULL THEN 0 WHEN l.level = e.raw THEN (lt + le) / 2.0::DOUBLE / n ELSE le / 1.0::DOUBLE / n END::DOUBLE AS x FROM e ASOF LEFT JOIN l ON e.raw >= l.level),
d AS (SELECT *, coalesce(greatest(0, t - lag(t) OVER (PARTITION BY path ORDER BY t, seq)), 1.0)::DOUBLE AS dt, row_number() OVER (PARTITION BY path ORDER BY t, seq) - 1 AS turn, count(*) OVER (PARTITION BY path) AS len FROM n)"""


def _fold(fields: dict[str, str], steps: dict[str, str], final: str) -> str:
    """A fold over a path's rows in order; a holds the state, o the row."""
    start = ", ".join(f"'{k}': {v}::DOUBLE" for k, v in fields.items())
    step = ", ".join(f"'{k}': ({steps.get(k, 'a.' + k)})::DOUBLE" for k in fields)
    return f"list_reduce(list({{'x': x, 'dt': dt, {start}}} ORDER BY t, seq), lambda a, o: {{'x': o.x, 'dt': o.dt, {step}}}, {{'x': 0::DOUBLE, 'dt': 0::DOUBLE, {start}}}).{final}"


I2T = "a.v * exp(-o.dt / 5.0::DOUBLE) + pow(greatest(0, o.x - 0.9::DOUBLE), 2)"
CUSUM = "greatest(0, a.v + (o.x - 0.75::DOUBLE))"
EWMA = "CASE WHEN a.f = 1 THEN o.x ELSE 0.3::DOUBLE * o.x + 0.7::DOUBLE * a.v END"


def _peak(value: str) -> str:
    return _fold({"v": "0", "p": "0", "f": "1"}, {"v": value, "p": f"greatest(a.p, {value})", "f": "0"}, "p")


KALMAN = {
    "f": "0",
    "l": "CASE WHEN a.f = 1 THEN o.x ELSE a.l + a.s + {k0} * {miss} END",
    "s": "CASE WHEN a.f = 1 THEN 0 ELSE a.s + {k1} * {miss} END",
    "a00": "CASE WHEN a.f = 1 THEN a.a00 ELSE {p00} - {k0} * {p00} END",
    "a01": "CASE WHEN a.f = 1 THEN a.a01 ELSE {p01} - {k0} * {p01} END",
    "a10": "CASE WHEN a.f = 1 THEN a.a10 ELSE {p10} - {k1} * {p00} END",
    "a11": "CASE WHEN a.f = 1 THEN a.a11 ELSE {p11} - {k1} * {p01} END",
}
_P = {"p00": "(a.a00 + a.a10 + a.a01 + a.a11 + 0.001::DOUBLE)", "p01": "(a.a01 + a.a11)", "p10": "(a.a10 + a.a11)", "p11": "(a.a11 + 0.0001::DOUBLE)", "miss": "(o.x - (a.l + a.s))"}
_P |= {"k0": f"({_P['p00']} / ({_P['p00']} + 0.05::DOUBLE))", "k1": f"({_P['p10']} / ({_P['p00']} + 0.05::DOUBLE))"}
KALMAN = {k: v.format(**_P) for k, v in KALMAN.items()}


def normed(spark, sf) -> DataFrame:
    s = score_stream(spark, sf)
    return quantiles.QuantileNormalizer().fit(s.filter("y = 0"), "raw").transform(s, "raw", "score")


def observed(spark, sf) -> DataFrame:
    return folds.ordered(normed(spark, sf), extra=["y"])


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in names else c for c in df.columns))


@query(f"WITH {N} SELECT seq, round(x, 9) AS norm FROM n")
def quantile_normalize(spark, sf):
    return normed(spark, sf).select("seq", F.round("score", 9).alias("norm"))


W = "(PARTITION BY path ORDER BY t, seq ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {N} SELECT seq, round(max(x) OVER {W}, 6) AS running_max FROM d")
def running_max(spark, sf):
    return _r(folds.running(normed(spark, sf)).select("seq", "running_max"), "running_max")


@query(f"WITH {N} SELECT seq, round(avg(x) OVER {W}, 6) AS running_mean FROM d")
def running_mean(spark, sf):
    return _r(folds.running(normed(spark, sf)).select("seq", "running_mean"), "running_mean")


@query(f"WITH {N}, s AS (SELECT *, sum(x - 0.75::DOUBLE) OVER {W} AS p FROM d) SELECT seq, round(p - least(0, min(p) OVER {W}), 6) AS cusum FROM s")
def cusum(spark, sf):
    return _r(folds.running(normed(spark, sf)).select("seq", "cusum"), "cusum")


def _last(name: str, spark, sf) -> DataFrame:
    return observed(spark, sf).select("path", F.round(folds.last_value(folds.make_statistic(name)), 6).alias("value"))


@query(f"WITH {N} SELECT path, round({_fold({'v': '0', 'f': '1'}, {'v': EWMA, 'f': '0'}, 'v')}, 6) AS value FROM d GROUP BY path")
def ewma(spark, sf):
    return _last("ewma", spark, sf)


@query(f"WITH {N} SELECT path, round({_fold({'v': '0'}, {'v': I2T}, 'v')}, 6) AS value FROM d GROUP BY path")
def thermal(spark, sf):
    return _last("i2t", spark, sf)


K0 = {"f": "1", "l": "0", "s": "0", "a00": "1", "a01": "0", "a10": "0", "a11": "1"}


@query(f"WITH {N}, k AS (SELECT path, {_fold(K0, KALMAN, 's')} AS s, {_fold(K0, KALMAN, 'a11')} AS v FROM d GROUP BY path) SELECT path, round(greatest(0, s / sqrt(greatest(v, 1e-12::DOUBLE))), 6) AS value FROM k")
def kalman_slope(spark, sf):
    return _last("kalman_slope", spark, sf)


PEAKS = f"p AS (SELECT path, y, {_peak(I2T)} AS i2t, {_peak(CUSUM)} AS cusum, {_peak(EWMA)} AS ewma FROM d GROUP BY path, y)"


def peaks_of(spark, sf, names=("i2t", "cusum", "ewma")) -> DataFrame:
    return observed(spark, sf).select("path", "y", *(folds.peak(folds.make_statistic(n)).alias(n) for n in names))


@query(f"WITH {N}, {PEAKS} SELECT path, y, round(i2t, 6) AS i2t, round(cusum, 6) AS cusum, round(ewma, 6) AS ewma FROM p")
def peaks(spark, sf):
    return _r(peaks_of(spark, sf), "i2t", "cusum", "ewma")


@query(f"WITH {N}, {PEAKS}, o AS (SELECT cusum, row_number() OVER (ORDER BY cusum) - 1 AS k, count(*) OVER () AS n FROM p WHERE y = 0) SELECT round(cusum, 6) AS threshold FROM o WHERE k = least(n - 1, ceil((1 - 0.05::DOUBLE) * n))")
def calibrate_threshold(spark, sf):
    return _r(quantiles.upper(peaks_of(spark, sf).filter("y = 0"), "cusum", 0.05), "threshold")


AUC = "(SELECT sum(CASE WHEN a.{m} > b.{m} THEN 1.0 WHEN a.{m} = b.{m} THEN 0.5 ELSE 0 END)::DOUBLE / count(*) FROM p a, p b WHERE a.y = 1 AND b.y = 0)"


@query(f"WITH {N}, {PEAKS}, s AS (SELECT 0 AS k, 'i2t' AS stat, {AUC.format(m='i2t')} AS auroc UNION ALL SELECT 1, 'cusum', {AUC.format(m='cusum')} UNION ALL SELECT 2, 'ewma', {AUC.format(m='ewma')}) SELECT stat, round(auroc, 6) AS auroc, row_number() OVER (ORDER BY auroc DESC, k) = 1 AS best FROM s")
def select_statistic(spark, sf):
    return _r(folds.best_statistic(observed(spark, sf)), "auroc")


@query(f"WITH {N} SELECT path, y, round(max(x), 6) AS runmax, round({_peak(EWMA)}, 6) AS ewma, round({_peak(CUSUM)}, 6) AS cusum, round({_peak(I2T)}, 6) AS thermal5, round({_peak(I2T.replace('5.0::', '2.0::'))}, 6) AS thermal2 FROM d GROUP BY path, y")
def online_peaks(spark, sf):
    o = observed(spark, sf)
    stats = {"ewma": folds.ewma(), "cusum": folds.cusum(), "thermal5": folds.i2t(5.0), "thermal2": folds.i2t(2.0)}
    out = o.select("path", "y", F.array_max(F.transform("obs", lambda x: x["x"])).alias("runmax"), *(folds.peak(s).alias(n) for n, s in stats.items()))
    return _r(out, "runmax", *stats)


@query(f"WITH {N} SELECT path, ({_fold({'v': '0', 'c': '0'}, {'v': f'CASE WHEN {CUSUM} >= 2 THEN 0 ELSE {CUSUM} END', 'c': f'a.c + CASE WHEN {CUSUM} >= 2 THEN 1 ELSE 0 END'}, 'c')})::BIGINT AS trips FROM d GROUP BY path")
def fuse_trips(spark, sf):
    return observed(spark, sf).select("path", F.size(folds.trips(folds.cusum())).cast("long").alias("trips"))


@query(f"WITH {N} SELECT seq, round(dt, 6) AS dt FROM d")
def dt_lag(spark, sf):
    return _r(folds.with_dt(score_stream(spark, sf)).select("seq", "dt"), "dt")


@query(f"WITH {N} SELECT seq, turn, array_to_string(list(seq) OVER (PARTITION BY path ORDER BY t, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS evidence FROM d")
def evidence_window(spark, sf):
    """The last ten observations of each path, and the place in the path."""
    order = Window.partitionBy("path").orderBy("t", "seq")
    return score_stream(spark, sf).select("seq", (F.row_number().over(order) - 1).cast("long").alias("turn"), F.array_join(F.collect_list("seq").over(order.rowsBetween(-9, 0)), ",").alias("evidence"))


def placed(spark, sf) -> DataFrame:
    order = Window.partitionBy("path").orderBy("t", "seq")
    return normed(spark, sf).withColumn("turn", (F.row_number().over(order) - 1).cast("long"))


@query(f"WITH {N} SELECT path, min(turn) FILTER (WHERE x >= 0.9) AS hit FROM d GROUP BY path")
def first_hit(spark, sf):
    return detection.first_hit(placed(spark, sf), 0.9, value="score")


@query(f"WITH {N} SELECT path, CASE WHEN max(x) >= 0.995 THEN 'block' ELSE 'allow' END AS decision, round(greatest(0, least(1, max(x))), 6) AS confidence, coalesce(min(turn) FILTER (WHERE x >= 0.995), -1) AS first_trip FROM d GROUP BY path")
def memoryless_verdict(spark, sf):
    return _r(decisions.memoryless_verdict(placed(spark, sf), 0.995), "confidence")


M = f"""{N}, m AS (SELECT path, turn, y, 'runmax' AS method, max(x) OVER {W} AS value FROM d UNION ALL SELECT path, turn, y, 'runmean', avg(x) OVER {W} FROM d),
k AS (SELECT method, path, y, max(value) AS peak FROM m GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY peak) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM k WHERE y = 0),
h AS (SELECT method, peak AS threshold FROM o WHERE i = ceil((n - 1) * 0.9::DOUBLE)),
z AS (SELECT m.method, path, threshold, min(turn) FILTER (WHERE value >= threshold) AS hit, count(*) AS n FROM m JOIN h USING (method) WHERE y = 1 GROUP BY ALL)"""


@query(f"WITH {M} SELECT method, round(threshold, 6) AS threshold, round(count(hit) / count(*)::DOUBLE, 6) AS tpr, round(avg((hit + 1) / n::DOUBLE), 6) AS mean_fraction, round(avg(hit), 6) AS mean_hit_turn FROM z GROUP BY method, threshold")
def early_detection(spark, sf):
    r = folds.running(placed(spark, sf))
    long = r.select("path", "turn", "y", F.explode(F.create_map(F.lit("runmax"), "running_max", F.lit("runmean"), "running_mean")).alias("method", "value"))
    return _r(detection.early_detection(long, 0.9), "threshold", "tpr", "mean_fraction", "mean_hit_turn")


@query(f"WITH {M}, b AS (SELECT path, max(hit) FILTER (WHERE method = 'runmax') AS hit_a, max(hit) FILTER (WHERE method = 'runmean') AS hit_b FROM z GROUP BY path) SELECT count(*) AS n, round(avg(hit_a), 6) AS mean_a, round(avg(hit_b), 6) AS mean_b, count(*) FILTER (WHERE hit_a < hit_b) AS faster, count(*) FILTER (WHERE hit_a > hit_b) AS slower, count(*) FILTER (WHERE hit_a = hit_b) AS same FROM b WHERE hit_a IS NOT NULL AND hit_b IS NOT NULL")
def detection_turns(spark, sf):
    r = folds.running(placed(spark, sf))
    long = r.select("path", "turn", "y", F.explode(F.create_map(F.lit("a"), "running_max", F.lit("b"), "running_mean")).alias("method", "value"))
    safe = long.filter("y = 0").groupBy("method", "path").agg(F.max("value").alias("peak"))
    cut = F.broadcast(quantiles.higher(safe, "peak", 0.9, ["method"]))  # a row for each method
    hits = long.join(cut, "method").groupBy("path", "y").agg(*(F.min(F.when((F.col("method") == m) & (F.col("value") >= F.col("threshold")), F.col("turn"))).alias(f"hit_{m}") for m in "ab"))
    return _r(detection.detection_turns(hits), "mean_a", "mean_b")


_PRE = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END)::DOUBLE / count(*) FROM q{k} a, q{k} b WHERE a.y = 1 AND b.y = 0) AS auroc" for k in (1, 2, 3, 0))
_QS = ", ".join(f"q{k} AS (SELECT path, y, max(x) AS v FROM d {'WHERE turn < ' + str(k) if k else ''} GROUP BY path, y)" for k in (1, 2, 3, 0))


@query(f"WITH {N}, {_QS}, u AS ({_PRE}) SELECT k, round(auroc, 6) AS auroc FROM u")
def prefix_auroc(spark, sf):
    return _r(detection.prefix_auroc(placed(spark, sf), [1, 2, 3, 0]), "auroc")


#: Turns of conversations with their overlap with the first turn, which stands for the reason, and a lexical score.
T = f"""b AS (SELECT conv_id, turn, role, length(text) % 97 / 97.0::DOUBLE AS score, {words_sql('text')} AS w, first_value({words_sql('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
v AS (SELECT conv_id AS path, turn::BIGINT AS turn, role, score, coalesce(len(list_intersect(w, r)) / nullif(len(list_distinct(list_concat(w, r))), 0)::DOUBLE, 0) AS overlap FROM b WHERE turn > 0)"""


def _overlaps(spark, sf) -> DataFrame:
    t = turns(spark, sf).select("conv_id", "turn", F.col("m.role").alias("role"), (F.char_length("text") % 97 / F.lit(97.0)).alias("score"), text.content_words(F.col("text")).alias("w"))
    reason = t.filter("turn = 0").select("conv_id", F.col("w").alias("r"))
    return t.filter("turn > 0").join(reason, "conv_id").select(F.col("conv_id").alias("path"), "turn", "role", "score", text.jaccard(F.col("w"), F.col("r")).alias("overlap"))


@query(f"WITH {T}, x AS (SELECT *, count(*) OVER p AS n, max(overlap) OVER p AS top, first_value(turn) OVER (PARTITION BY path ORDER BY overlap DESC, turn) AS proxy, first_value(turn) OVER (PARTITION BY path ORDER BY score DESC, turn) AS highest, row_number() OVER (PARTITION BY path ORDER BY score, turn) AS k, (sum(score) OVER p - score) / nullif(count(*) OVER p - 1, 0) AS other FROM v WINDOW p AS (PARTITION BY path)) SELECT count(*) AS n, round(avg((highest = proxy)::INT), 6) AS top1, round(avg(1 / n::DOUBLE), 6) AS chance, round(avg(k / n::DOUBLE), 6) AS mean_rank, round(avg(score - other), 6) AS delta, round(avg((score > other)::INT), 6) AS positive FROM x WHERE n >= 3 AND top > 0 AND turn = proxy")
def localization(spark, sf):
    return _r(detection.localisation(_overlaps(spark, sf)), "top1", "chance", "mean_rank", "delta", "positive")


@query(f"WITH {T}, x AS (SELECT path, first(role ORDER BY score DESC, turn) AS top, avg((role = 'assistant')::INT) AS share FROM v GROUP BY path) SELECT count(*) AS n, round(avg((top = 'assistant')::INT), 6) AS hit, round(avg(share), 6) AS base FROM x WHERE share > 0")
def role_hit(spark, sf):
    return _r(detection.role_hit(_overlaps(spark, sf), "agent"), "hit", "base")


@query(f"WITH {T} SELECT path, turn, round((sum(score) OVER (PARTITION BY path) - score) / nullif(count(*) OVER (PARTITION BY path) - 1, 0), 6) AS other_mean FROM v")
def leave_one_out(spark, sf):
    return _r(detection.leave_one_out(_overlaps(spark, sf)).select("path", "turn", "other_mean"), "other_mean")


@query(f"WITH {T} SELECT path, first(turn ORDER BY score DESC, turn) AS turn FROM v GROUP BY path")
def argmax_turn(spark, sf):
    return detection.argmax_turn(_overlaps(spark, sf))


@query(f"WITH {N}, x AS (SELECT path, y, max(x) AS a, avg(x) AS b FROM d GROUP BY path, y), r AS (SELECT * FROM x WHERE y = 0) SELECT path, round(((SELECT (count(*) FILTER (WHERE r.a < x.a) + count(*) FILTER (WHERE r.a <= x.a)) / 2.0::DOUBLE / count(*) FROM r) + (SELECT (count(*) FILTER (WHERE r.b < x.b) + count(*) FILTER (WHERE r.b <= x.b)) / 2.0::DOUBLE / count(*) FROM r)) / 2, 6) AS ensemble FROM x")
def rank_ensemble(spark, sf):
    p = normed(spark, sf).groupBy("path", "y").agg(F.max("score").alias("a"), F.round(F.avg("score"), 12).alias("b"))
    return _r(detection.rank_ensemble(p, ["a", "b"], "y = 0").select("path", "ensemble"), "ensemble")


@query(f"WITH {N}, f AS (SELECT path, len, {_fold({'v': '0', 'c': '0'}, {'v': f'CASE WHEN {CUSUM} >= 2 THEN 0 ELSE {CUSUM} END', 'c': f'a.c + CASE WHEN {CUSUM} >= 2 THEN 1 ELSE 0 END'}, 'c')} AS c FROM d GROUP BY path, len) SELECT count(*) AS paths, sum(len)::BIGINT AS observations, sum(c)::BIGINT AS trips, round(sum(c) / greatest(1, count(*)), 6)::DOUBLE AS trip_rate FROM f")
def recorder_summary(spark, sf):
    o = observed(spark, sf).select("path", F.size("obs").cast("long").alias("n"), F.size(folds.trips(folds.cusum())).cast("long").alias("c"))
    return o.agg(F.count("*").alias("paths"), F.sum("n").alias("observations"), F.sum("c").alias("trips"), F.round(F.sum("c") / F.greatest(F.lit(1), F.count("*")), 6).alias("trip_rate"))


@query(f"WITH {N}, {PEAKS}, g AS (SELECT path, any_value(len) AS len FROM d GROUP BY path), x AS (SELECT p.y, p.cusum, g.len, row_number() OVER (ORDER BY g.len, path) - 1 AS k, count(*) OVER () // 3 AS t FROM p JOIN g USING (path)) SELECT least(2, k // greatest(t, 1))::INT AS tercile, count(*) AS n, round(avg(len), 6) AS mean_len, round(stddev_pop(len), 6) AS std_len, round(avg(cusum / greatest(1, len)), 6) AS mean_peak_per_turn FROM x GROUP BY 1")
def length_ablation(spark, sf):
    from ..operators.splits import terciles

    p = observed(spark, sf).select("path", F.size("obs").alias("len"), folds.peak(folds.cusum()).alias("cusum"))
    out = terciles(p, ["len", "path"]).groupBy("tercile")
    return out.agg(F.count("*").alias("n"), F.round(F.avg("len"), 6).alias("mean_len"), F.round(F.stddev_pop("len"), 6).alias("std_len"), F.round(F.avg(F.col("cusum") / F.greatest(F.lit(1), "len")), 6).alias("mean_peak_per_turn"))


@query(f"WITH {N}, {PEAKS} SELECT round({AUC.format(m='cusum')} - {AUC.format(m='ewma')}, 6) AS delta")
def auroc_delta(spark, sf):
    p = peaks_of(spark, sf)
    a, b = (metrics.auroc(p, score=m).select(F.col("auroc").alias(m)) for m in ("cusum", "ewma"))
    return a.crossJoin(b).select(F.round(F.col("cusum") - F.col("ewma"), 6).alias("delta"))


#: A statistic that trips now and then on events, whose times are far apart.
SLOW = {"tau": 86_400.0, "theta": 0.5, "threshold": 0.3}
_STEP = "(a.v * exp(-o.dt / 86400.0::DOUBLE) + pow(greatest(0, o.x - 0.5::DOUBLE), 2))"
_REPLAY = f"list_reduce(list({{'x': x, 'dt': dt, 'v': 0::DOUBLE, 'p': 0::DOUBLE, 'k': 0, 'f': -1, 'c': 0}} ORDER BY t, seq), lambda a, o: {{'x': o.x, 'dt': o.dt, 'v': CASE WHEN {_STEP} >= 0.3 THEN 0 ELSE {_STEP} END, 'p': greatest(a.p, {_STEP}), 'k': a.k + 1, 'f': CASE WHEN a.f < 0 AND {_STEP} >= 0.3 THEN a.k ELSE a.f END, 'c': a.c + CASE WHEN {_STEP} >= 0.3 THEN 1 ELSE 0 END}}, {{'x': 0::DOUBLE, 'dt': 0::DOUBLE, 'v': 0::DOUBLE, 'p': 0::DOUBLE, 'k': 0, 'f': -1, 'c': 0}})"


@query(f"WITH {N}, r AS (SELECT path, {_REPLAY} AS r FROM d GROUP BY path) SELECT path, round(r.p, 6) AS peak, nullif(r.f, -1)::INT AS first_trip, r.c::INT AS trips FROM r")
def accumulator_replay(spark, sf):
    """Peak, first trip and trips of each user with the times between events, over resets."""
    return _r(observed(spark, sf).select("path", folds.replayed(folds.i2t(**SLOW)).alias("r")).select("path", "r.*"), "peak")


@query("SELECT 0.0::DOUBLE AS max_difference, 0::BIGINT AS mismatches, count(DISTINCT user_id) AS paths FROM events")
def replay_difference(spark, sf):
    """The fold on columns and the plain loop agree on all users."""
    return _r(folds.replay_difference(normed(spark, sf), folds.i2t(**SLOW)), "max_difference", digits=9)


GRID_PERCENTS, GRID_TAUS, GRID_FOLDS = [50.0, 75.0, 90.0], [1.0, 2.0, 5.0, 10.0], 3
_GRID = f"""u AS (SELECT DISTINCT path, y FROM d),
f AS (SELECT path, y, (row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5(path), 1, 8))::UBIGINT, path) - 1) % {GRID_FOLDS} AS fold FROM u),
x AS (SELECT d.*, fold FROM d JOIN f USING (path)),
th AS ({' UNION ALL '.join(f"SELECT held, {p}::DOUBLE AS percent, quantile_cont(x.x, {p / 100}) AS theta FROM x, (SELECT unnest(range({GRID_FOLDS})) AS held) WHERE x.y = 0 AND x.fold <> held GROUP BY held" for p in GRID_PERCENTS)}),
g AS (SELECT held, percent, theta, tau, row_number() OVER (PARTITION BY held ORDER BY percent, tau) - 1 AS place FROM th, (SELECT unnest({GRID_TAUS!r}::DOUBLE[]) AS tau)),
pk AS (SELECT path, any_value(x.y) AS y, any_value(fold) AS fold, held, place, round(list_reduce(list({{'x': x.x, 'th': theta, 'tau': tau, 'v': 0::DOUBLE, 'p': 0::DOUBLE}} ORDER BY t, seq), lambda a, o: {{'x': o.x, 'th': o.th, 'tau': o.tau, 'v': a.v * exp(-1 / o.tau) + pow(greatest(0, o.x - o.th), 2), 'p': greatest(a.p, a.v * exp(-1 / o.tau) + pow(greatest(0, o.x - o.th), 2))}}, {{'x': 0::DOUBLE, 'th': 0::DOUBLE, 'tau': 1::DOUBLE, 'v': 0::DOUBLE, 'p': 0::DOUBLE}}).p, 9) AS peak FROM x, g GROUP BY path, held, place),
pairs AS (SELECT p.held, p.place, p.fold = p.held AS test, sum(CASE WHEN p.peak > n.peak THEN 1.0 WHEN p.peak = n.peak THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS auroc FROM pk p JOIN pk n ON p.held = n.held AND p.place = n.place AND (p.fold = p.held) = (n.fold = n.held) WHERE p.y = 1 AND n.y = 0 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY auroc DESC, place) AS k FROM pairs WHERE NOT test)"""


@query(f"WITH {N}, {_GRID} SELECT b.held::INT AS fold, percent, tau, round(theta, 6) AS theta, round(b.auroc, 6) AS train_auroc, round(coalesce(t.auroc, 0.5), 6) AS test_auroc FROM best b JOIN g USING (held, place) LEFT JOIN pairs t ON t.held = b.held AND t.place = b.place AND t.test WHERE k = 1")
def grid_search(spark, sf):
    """Of each fold of users the thermal threshold and decay that do best on the others, and how they do on the fold."""
    from ..operators.splits import shuffled_folds

    o = observed(spark, sf)
    paths = o.join(shuffled_folds(o.select("path", "y"), "y", "path", GRID_FOLDS).select("path", F.col("fold").cast("int").alias("fold")), "path")
    return _r(folds.grid_search(paths, GRID_FOLDS, GRID_PERCENTS, GRID_TAUS), "theta", "train_auroc", "test_auroc")


#: Words that come more than twice as often in turns of odd conversations than of even ones, which stand for a sensor's positive terms.
_VOCAB = f"""b AS (SELECT conv_id, turn, length(text) % 97 / 97.0::DOUBLE AS score, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS length, {words_sql('text')} AS w FROM conversations),
e AS (SELECT conv_id, turn, unnest(list_distinct(w)) AS word FROM b),
vocab AS (SELECT word FROM e GROUP BY word HAVING count(*) FILTER (WHERE conv_id % 2 = 1) > 2 * count(*) FILTER (WHERE conv_id % 2 = 0)),
k AS (SELECT * FROM e WHERE word NOT IN (SELECT word FROM vocab)),
r AS (SELECT conv_id, word FROM k WHERE turn = 0),
rn AS (SELECT conv_id, count(*) AS meant FROM r GROUP BY conv_id),
s AS (SELECT k.conv_id, k.turn, count(*) AS said, count(r.word) AS shared FROM k LEFT JOIN r ON r.conv_id = k.conv_id AND r.word = k.word WHERE k.turn > 0 GROUP BY ALL),
v AS (SELECT b.conv_id AS path, b.turn, score, length, coalesce(shared, 0) / greatest(1, coalesce(said, 0) + meant - coalesce(shared, 0))::DOUBLE AS overlap FROM b JOIN rn USING (conv_id) LEFT JOIN s ON s.conv_id = b.conv_id AND s.turn = b.turn WHERE b.turn > 0)"""


@query(f"WITH {_VOCAB}, x AS (SELECT *, count(*) OVER p AS n, max(overlap) OVER p AS top, first_value(turn) OVER (PARTITION BY path ORDER BY overlap DESC, turn) AS proxy, first_value(turn) OVER (PARTITION BY path ORDER BY score DESC, turn) AS highest, first_value(turn) OVER (PARTITION BY path ORDER BY length DESC, turn) AS longest, row_number() OVER (PARTITION BY path ORDER BY score, turn) AS place, (sum(score) OVER p - score) / nullif(count(*) OVER p - 1, 0) AS other FROM v WINDOW p AS (PARTITION BY path)) SELECT count(*) AS n, round(avg((highest = proxy)::INT), 6) AS top1, round(avg(1 / n::DOUBLE), 6) AS chance, round(avg(place / n::DOUBLE), 6) AS mean_rank, round(avg(score - other), 6) AS delta, round(avg((score > other)::INT), 6) AS positive, round(avg((highest = longest)::INT), 6) AS argmax_longest, count(*) FILTER (WHERE proxy <> longest) AS n_other, round(avg((highest = proxy)::INT) FILTER (WHERE proxy <> longest), 6) AS top1_other FROM x WHERE n >= 3 AND top > 0 AND turn = proxy")
def deconfounded_localization(spark, sf):
    """localization, with a sensor's own words taken out of turns and reasons, and the longest turn as control."""
    t = turns(spark, sf).select(F.col("conv_id").alias("path"), "turn", (F.char_length("text") % 97 / F.lit(97.0)).alias("score"), text.word_count(F.col("text")).alias("length"), text.content_words(F.col("text")).alias("words"))
    said = t.select((F.col("path") % 2).alias("odd"), F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count_if(F.col("odd") == 1).alias("odd"), F.count_if(F.col("odd") == 0).alias("even"))
    overlaps = detection.overlaps_without(t.filter("turn > 0"), t.filter("turn = 0"), said.filter("odd > 2 * even").select("term"))
    found = detection.longest_control(overlaps.join(t.select("path", "turn", "score", "length"), ["path", "turn"]))
    return _r(found, "top1", "chance", "mean_rank", "delta", "positive", "argmax_longest", "top1_other")
