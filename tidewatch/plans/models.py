"""Queries of sensors and of the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, sensors, splits
from ..operators.quantiles import QuantileNormalizer
from ..sources.tables import score_stream, table, turns
from ..streaming.flightlog import FlightLog
from ..streaming.fuse import OUT, Fuse, Replay, parts_by_time, replay, values
from ..streaming.reference import Reference
from .paths import CUSUM, N, W, _fold
from .registry import query

TERMS = rf"w AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(translate(lower(text), '{sensors.MARKED}', '{sensors.PLAIN}'), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM conversations), t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), n AS (SELECT id, term, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT term, count(*) AS df, sum(n) AS tf FROM n GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 50000), i AS (SELECT term, ln((1 + (SELECT count(*) FROM w)) / (1 + df)::DOUBLE) + 1 AS idf FROM v)"


def _rows(spark, sf):
    t = turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text", F.col("m.role").alias("role"))
    return t.withColumn("y", (F.col("conv_id") % 2).cast("int"))


@query(f"WITH {TERMS}, x AS (SELECT id, term, (1 + ln(n)) * idf AS q FROM n JOIN i USING (term)) SELECT id, term, round(q / sqrt(sum(q * q) OVER (PARTITION BY id)), 6) AS weight FROM x")
def tfidf_weights(spark, sf):
    rows = _rows(spark, sf)
    return sensors.TfIdf().fit(rows).transform(rows).select("id", "term", F.round("weight", 6).alias("weight"))


@query()
def tfidf_out_of_fold(spark, sf):
    """Out-of-fold AUROC of trajectories' largest turn score; labels are stand-ins by conv_id."""
    rows = _rows(spark, sf)
    folds = splits.shuffled_folds(rows.select("conv_id", "y").distinct(), "y", "conv_id", 3).select("conv_id", "fold")
    rows = rows.join(folds, "conv_id")
    scored = sensors.out_of_fold(rows.select("id", "text", "y", "fold"), sensors.TurnSensor, 3)
    peaks = rows.select("id", "conv_id", "y").join(scored.select("id", "score").hint("merge"), "id").groupBy("conv_id", "y").agg(F.max("score").alias("score"))
    return metrics.auroc(peaks)


@query()
def latent_probe(spark, sf):
    """Out-of-fold AUROC of a probe of embeddings for labels of 5 and more."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") >= 5).cast("int").alias("y"))
    v = splits.shuffled_folds(v, "y", "id").persist()
    return metrics.auroc(sensors.latent_probe(v).join(v.select("id", "y"), "id"))


TRIPS = _fold({"v": "0", "c": "0"}, {"v": f"CASE WHEN {CUSUM} >= 2 THEN 0 ELSE {CUSUM} END", "c": f"a.c + CASE WHEN {CUSUM} >= 2 THEN 1 ELSE 0 END"}, "c")


def _raw(spark, sf):
    """Raw scores of all users, and the reference of the even ones."""
    s = score_stream(spark, sf)
    fitted = QuantileNormalizer().fit(s.filter("y = 0"), "raw")
    return s.select("path", "t", "seq", F.col("raw").alias("score")), Reference.of(fitted.levels)


@query(f"WITH {N} SELECT path, ({TRIPS})::BIGINT AS trips, any_value(len) AS observations FROM d GROUP BY path")
def fuse_stream(spark, sf):
    """Trips of a stream over raw scores, normalised on the way, one state for each user, with a reset after each trip."""
    raw, reference = _raw(spark, sf)
    seen = replay(raw, fuse=Fuse("cusum", normalizer=reference)).seen()
    return seen.groupBy("path").agg(F.sum(F.col("tripped").cast("long")).alias("trips"), F.count("*").alias("observations"))


_KEPT = f"CASE WHEN {CUSUM} >= 2 THEN 0 ELSE {CUSUM} END"


@query(f"WITH {N}, w AS (SELECT floor(avg(t)) AS middle FROM d) SELECT path, round(coalesce({_fold({'v': '0'}, {'v': _KEPT}, 'v').replace('ORDER BY t, seq)', 'ORDER BY t, seq) FILTER (WHERE t >= middle)')}, 0), 6) AS value, count(*) AS turns FROM d, w GROUP BY path")
def fuse_values(spark, sf):
    """Each user's statistic after the stream, read from its state; all users start anew in the middle of the time."""
    raw, reference = _raw(spark, sf)
    at = raw.agg(F.floor(F.avg("t")).alias("at"), F.max("t").alias("now")).first()
    fuse = Fuse("cusum", normalizer=reference, resets=(float(at["at"]),))
    run = replay(raw, fuse=fuse)
    return values(spark, run.checkpoint, fuse, at.now).select("path", F.round("value", 6).alias("value"), "turns")


@query(f"WITH {N}, s AS (SELECT path, turn, len, sum(x - 0.75::DOUBLE) OVER {W} AS p FROM d), r AS (SELECT path, turn, len, p - least(0, min(p) OVER (PARTITION BY path ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS v FROM s) SELECT path, min(turn) FILTER (WHERE v >= 2) AS hit, coalesce(min(turn) FILTER (WHERE v >= 2) + 1, any_value(len)) AS observations FROM r GROUP BY path")
def early_stop(spark, sf):
    """The first trip of each user in a replay that ends a path there, and how many rows were looked at."""
    raw, reference = _raw(spark, sf)
    seen = replay(raw, fuse=Fuse("cusum", normalizer=reference, stop_on_trip=True)).seen()
    return seen.groupBy("path").agg(F.min(F.when(F.col("tripped"), F.col("turn_index"))).alias("hit"), F.count("*").alias("observations"))


@query(f"WITH {N}, f AS (SELECT path, len, {TRIPS} AS c FROM d GROUP BY path, len) SELECT count(*) AS paths, sum(len)::BIGINT AS observations, sum(c)::BIGINT AS trips, true AS sealed FROM f")
def flight_log(spark, sf):
    """What a sealed log of the stream holds, and whether all its seals hold."""
    raw, reference = _raw(spark, sf)
    run = Replay(spark)
    log = FlightLog(f"{run.base}/log")
    for part in parts_by_time(raw):
        run.feed(part, Fuse("cusum", normalizer=reference), log.write)
    held = log.read(spark, OUT).agg(F.count_distinct("path").alias("paths"), F.count("*").alias("observations"), F.count_if("tripped").alias("trips"))
    return held.crossJoin(log.verify(spark).agg(F.bool_and(F.col("status") == "ok").alias("sealed")))
