"""Queries of rates, confusion, rank metrics, splits and quantiles over samples and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detection, metrics, quantiles, splits
from ..sources.tables import samples, table, turns
from .registry import query
from .scalar import DIRECT, GROUP, INDIRECT, R, S, decided

#: A score without ties: a hash of the id, moved up for toxic documents.
SCORE = "(('0x' || substr(md5(sample_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE) * 0.7 + CASE WHEN should_block THEN 0.2::DOUBLE ELSE 0::DOUBLE END"
SC = f"{S}, c AS (SELECT *, should_block::INT AS y, {SCORE} AS score, round({SCORE}, 1) AS tied FROM s)"
#: AUROC by counting pairs.
PAIRS = "sum(CASE WHEN p.{x} > n.{x} THEN 1.0 WHEN p.{x} = n.{x} THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*)"


def scored(spark, sf) -> DataFrame:
    score = splits.hashed(F.col("sample_id")) / F.lit(4294967296.0) * 0.7 + F.when(F.col("should_block"), F.lit(0.2)).otherwise(0.0)
    s = samples(spark, sf).select("sample_id", "doc_id", "should_block", "dataset_source", "quality", "length")
    return s.withColumn("y", F.col("should_block").cast("int")).withColumn("score", score).withColumn("tied", F.round("score", 1))


@query(f"WITH {R} SELECT count(*) FILTER (WHERE should_block AND decision = 'allow') / nullif(count(*) FILTER (WHERE should_block), 0)::DOUBLE AS asr, count(*) FILTER (WHERE NOT should_block AND decision <> 'allow') / nullif(count(*) FILTER (WHERE NOT should_block), 0)::DOUBLE AS orr, count(*) FILTER (WHERE decision = 'escalate') / count(*)::DOUBLE AS escalation_rate FROM r")
def rates(spark, sf):
    d = decided(spark, sf)
    return metrics.rates(d, d)


@query(f"WITH {R}, h AS (SELECT * FROM r WHERE doc_id % 3 <> 0) SELECT round((SELECT count(*) FROM h WHERE should_block AND decision = 'allow') / nullif((SELECT count(*) FROM r WHERE should_block), 0)::DOUBLE, 9) AS asr, round((SELECT count(*) FROM h WHERE NOT should_block AND decision <> 'allow') / nullif((SELECT count(*) FROM r WHERE NOT should_block), 0)::DOUBLE, 9) AS orr, round((SELECT count(*) FROM h WHERE decision = 'escalate') / (SELECT count(*) FROM h)::DOUBLE, 9) AS escalation_rate")
def rates_with_missing_results(spark, sf):
    """Two in three samples have a result: the others stay in the denominators of asr and orr."""
    d = decided(spark, sf)
    out = metrics.rates(d, d.filter("doc_id % 3 != 0"))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


CONFUSION = "count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a AND b) AS fp, count(*) FILTER (WHERE a AND NOT b) AS fn, count(*) FILTER (WHERE NOT a AND NOT b) AS tn"
DERIVED = "tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 9) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 9) AS accuracy"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if c in names else c for c in df.columns))


@query(f"WITH {R}, x AS (SELECT {CONFUSION} FROM (SELECT should_block AS a, decision <> 'allow' AS b FROM r)) SELECT {DERIVED} FROM x")
def confusion(spark, sf):
    d = decided(spark, sf).select(F.col("should_block").cast("int").alias("y"), (F.col("decision") != "allow").cast("int").alias("pred"))
    return _rounded(metrics.confusion(d), "precision", "recall", "f1", "accuracy")


@query(f"WITH {R}, g AS (SELECT should_block AS a, decision <> 'allow' AS b, 'all' AS subset FROM r UNION ALL SELECT should_block, decision <> 'allow', CASE WHEN doc_id % 2 = 0 THEN 'early' ELSE 'late' END FROM r), x AS (SELECT subset, {CONFUSION} FROM g GROUP BY subset) SELECT subset, {DERIVED} FROM x")
def subset_metrics(spark, sf):
    segment = F.when(F.col("doc_id") % 2 == 0, "early").otherwise("late")
    d = decided(spark, sf).select(F.col("should_block").cast("int").alias("y"), (F.col("decision") != "allow").cast("int").alias("pred"), F.explode(F.array(F.lit("all"), segment)).alias("subset"))
    return _rounded(metrics.confusion(d, ["subset"]), "precision", "recall", "f1", "accuracy")


@query(f"WITH {SC} SELECT round({PAIRS.format(x='score')}, 9) AS auroc FROM c p, c n WHERE p.y = 1 AND n.y = 0")
def auroc_cli(spark, sf):
    return metrics.auroc(scored(spark, sf), degenerate=1.0).select(F.round("auroc", 9).alias("auroc"))


@query(f"WITH {SC} SELECT round({PAIRS.format(x='tied')}, 9) AS auroc FROM c p, c n WHERE p.y = 1 AND n.y = 0")
def auroc_mw(spark, sf):
    return metrics.auroc(scored(spark, sf), score="tied", degenerate=0.5).select(F.round("auroc", 9).alias("auroc"))


@query(f"WITH {SC}, k AS (SELECT y, sum(y) OVER w AS hits, count(*) OVER w AS n FROM c WINDOW w AS (ORDER BY score DESC, sample_id ROWS UNBOUNDED PRECEDING)) SELECT round(sum(hits / n::DOUBLE) FILTER (WHERE y = 1) / count(*) FILTER (WHERE y = 1), 9) AS auprc FROM k")
def auprc(spark, sf):
    return metrics.average_precision(scored(spark, sf)).select(F.round("auprc", 9).alias("auprc"))


@query(f"WITH {R}, z AS (SELECT *, CASE WHEN decision = 'allow' THEN 1 - confidence ELSE confidence END AS x, should_block AS a, decision <> 'allow' AS b FROM r), m AS (SELECT {CONFUSION} FROM z), d AS (SELECT {DERIVED} FROM m), k AS (SELECT a, sum(a::INT) OVER w AS hits, count(*) OVER w AS n FROM z WINDOW w AS (ORDER BY x DESC, sample_id ROWS UNBOUNDED PRECEDING)) SELECT (SELECT round({PAIRS.format(x='x')}, 9) FROM z p, z n WHERE p.a AND NOT n.a) AS auroc, (SELECT round(sum(hits / n::DOUBLE) FILTER (WHERE a) / count(*) FILTER (WHERE a), 9) FROM k) AS auprc, precision, recall, f1, NULL::VARCHAR AS na_reason FROM d")
def advanced_metrics(spark, sf):
    d = decided(spark, sf)
    return _rounded(metrics.advanced_metrics(d, d.select("sample_id", "decision", "confidence")), "auroc", "auprc", "precision", "recall", "f1")


@query(f"WITH {SC}, n AS (SELECT * FROM c WHERE y = 0) SELECT p.source AS family, round({PAIRS.format(x='tied')}, 9) AS auroc FROM c p, n WHERE p.y = 1 GROUP BY p.source")
def auroc_by_family(spark, sf):
    s = scored(spark, sf).select(F.col("dataset_source").alias("family"), "y", F.col("tied").alias("score"))
    return detection.family_auroc(s).select("family", F.round("auroc", 9).alias("auroc"))


@query(f"WITH {SC}, n AS (SELECT * FROM c WHERE y = 0), f AS (SELECT p.source, {PAIRS.format(x='tied')} AS a FROM c p, n WHERE p.y = 1 GROUP BY p.source) SELECT round(avg(a), 9) AS macro_auroc, count(*) AS families FROM f")
def macro_auroc(spark, sf):
    s = scored(spark, sf).select(F.col("dataset_source").alias("family"), "y", F.col("tied").alias("score"))
    return detection.family_auroc(s).agg(F.round(F.avg("auroc"), 9).alias("macro_auroc"), F.count("*").alias("families"))


@query(f"WITH {SC}, n AS (SELECT * FROM c WHERE y = 0), f AS (SELECT p.source, round({PAIRS.format(x='tied')}, 9) AS a, round({PAIRS.format(x='score')}, 9) AS b FROM c p, n WHERE p.y = 1 GROUP BY p.source), w AS (SELECT count(*) FILTER (WHERE b > a) AS wins, count(*) FILTER (WHERE b <> a) AS n FROM f), k AS (SELECT wins, n, unnest(range(wins, n + 1)) AS k FROM w) SELECT n, wins, round(sum(factorial(n::INT) / (factorial(k::INT) * factorial((n - k)::INT))::DOUBLE) / pow(2, n), 9) AS p FROM k GROUP BY n, wins")
def sign_test(spark, sf):
    """In how many families the untied score has the larger AUROC than the rounded one, and how likely so many are by chance."""
    s = scored(spark, sf).withColumnRenamed("dataset_source", "family")
    a, b = (detection.family_auroc(s.select("family", "y", F.col(c).alias("score"))).select("family", F.col("auroc").alias(n)) for c, n in (("tied", "a"), ("score", "b")))
    a, b = (x.withColumn(x.columns[1], F.round(x.columns[1], 9)) for x in (a, b))
    both = a.join(b, "family").agg(F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("a") != F.col("b")).alias("n"))
    return both.select("n", "wins", F.round(metrics.sign_test(F.col("wins"), F.col("n")), 9).alias("p"))


MID = "(SELECT {c}, avg(k) AS {o} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS k FROM l) GROUP BY {c})"


@query(f"WITH {SC}, l AS (SELECT length(text) AS a, tied AS b FROM c), ra AS {MID.format(c='a', o='x')}, rb AS {MID.format(c='b', o='z')} SELECT round(corr(x, z), 9) AS rho, count(*) AS n FROM l JOIN ra USING (a) JOIN rb USING (b)")
def spearman(spark, sf):
    return _rounded(metrics.spearman(scored(spark, sf).select(F.col("length").alias("a"), F.col("tied").alias("b")), "a", "b"), "rho")


@query(f"WITH {SC}, u AS (SELECT DISTINCT tied FROM c) SELECT count(*) AS n_unique, count(*) < 10 AS coarse, CASE WHEN count(*) <= 12 THEN array_to_string(list_transform(list(tied ORDER BY tied), lambda x: printf('%.1f', x)), ',') END AS levels FROM u")
def granularity(spark, sf):
    g = metrics.granularity(scored(spark, sf).select(F.col("tied").alias("score")))
    return g.select("n_unique", "coarse", F.array_join(F.transform("levels", lambda x: F.format_string("%.1f", x)), ",").alias("levels"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.75), 9) AS p75, round(quantile_cont(value, 0.9), 9) AS p90 FROM events GROUP BY event_type")
def percentiles(spark, sf):
    return _rounded(quantiles.linear(table(spark, sf, "events"), "value", [0.5, 0.75, 0.9], ["event_type"]), "p50", "p75", "p90")


PEAK = "p AS (SELECT event_type, user_id, max(value) AS peak FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY peak) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM p)"


@query(f"WITH {PEAK} SELECT event_type, peak AS threshold FROM o WHERE k = ceil((n - 1) * 0.95::DOUBLE)")
def fpr_threshold(spark, sf):
    peaks = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("peak"))
    return quantiles.higher(peaks, "peak", 0.95, ["event_type"])


@query(f"WITH {SC}, u AS (SELECT DISTINCT tied FROM c ORDER BY tied DESC LIMIT 2), p AS (SELECT quantile_cont(tied, 0.99) AS p FROM c) SELECT round(CASE WHEN p >= (SELECT max(tied) FROM u) THEN (SELECT avg(tied) FROM u) ELSE p END, 9) AS reference FROM p")
def robust_reference(spark, sf):
    return quantiles.robust_reference(scored(spark, sf), "tied", 0.99).select(F.round("reference", 9).alias("reference"))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6)::DOUBLE AS median, round(stddev_pop(n_chars), 6) AS std FROM documents GROUP BY source")
def length_stats(spark, sf):
    d = table(spark, sf, "documents").select("source", "n_chars")
    moments = d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("std"))
    medians = quantiles.linear(d, "n_chars", [0.5], ["source"]).select(F.col("source").alias("s"), F.round("p50", 6).alias("median"))
    return moments.join(medians, moments["source"].eqNullSafe(medians["s"]), "left").select("source", "n", "mean", "median", "std")


@query("WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-záéíóúñ]+'))) AS word FROM conversations) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 15")
def top_tokens(spark, sf):
    """The 15 words of most turns."""
    from ..functions.text import tokenize

    words = turns(spark, sf).select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query("WITH t AS (SELECT role, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, list_has_any(regexp_extract_all(lower(text), '[a-záéíóúñ]+'), ['the', 'le']) AS hit, regexp_matches(lower(text), 'the|le') AS sub FROM conversations) SELECT role, count(*) AS turns, round(100.0::DOUBLE * avg(hit::INT), 6) AS pct_hit, round(100.0::DOUBLE * avg((sub AND NOT hit)::INT), 6) AS pct_substring_only, round(100.0::DOUBLE * avg((n >= 80)::INT), 6) AS pct_long, round(avg(n), 6) AS mean_words FROM t GROUP BY role")
def turn_diagnostics(spark, sf):
    from ..functions.text import tokenize, word_count

    t = table(spark, sf, "conversations").select("role", word_count(F.col("text")).alias("n"), F.arrays_overlap(tokenize(F.col("text")), F.array(F.lit("the"), F.lit("le"))).alias("hit"), F.lower("text").rlike("the|le").alias("sub"))
    pct = lambda c: F.round(100.0 * F.avg(c.cast("int")), 6)
    return t.groupBy("role").agg(F.count("*").alias("turns"), pct(F.col("hit")).alias("pct_hit"), pct(F.col("sub") & ~F.col("hit")).alias("pct_substring_only"), pct(F.col("n") >= 80).alias("pct_long"), F.round(F.avg("n"), 6).alias("mean_words"))


FOLDS = f"{S}, f AS (SELECT *, (row_number() OVER (PARTITION BY {GROUP} ORDER BY doc_id) - 1) % 5 AS fold FROM s)"


def _grouped(spark, sf) -> DataFrame:
    s = samples(spark, sf)
    return s.withColumn("grp", splits.risk_group(F.col("dataset_source"), F.col("should_block"), DIRECT, INDIRECT))


@query(f"WITH {FOLDS} SELECT sample_id, fold FROM f")
def det_folds(spark, sf):
    return splits.group_folds(_grouped(spark, sf), "grp", "doc_id").select("sample_id", "fold")


@query(f"WITH {FOLDS} SELECT fold, count(*) AS n, count(*) FILTER (WHERE should_block) AS positives FROM f GROUP BY fold")
def fold_balance(spark, sf):
    return splits.group_folds(_grouped(spark, sf), "grp", "doc_id").groupBy("fold").agg(F.count("*").alias("n"), F.count_if("should_block").alias("positives"))


@query(f"WITH {S} SELECT sample_id, (row_number() OVER (PARTITION BY should_block ORDER BY ('0x' || substr(md5(sample_id), 1, 8))::UBIGINT, sample_id) - 1) % 5 AS fold FROM s")
def stratified_fold(spark, sf):
    return splits.shuffled_folds(samples(spark, sf), "should_block", "sample_id").select("sample_id", "fold")


@query(f"WITH {S}, x AS (SELECT sample_id, row_number() OVER (ORDER BY ('0x' || substr(md5(sample_id), 1, 8))::UBIGINT, sample_id) AS k, count(*) OVER () AS n FROM s WHERE NOT should_block) SELECT sample_id, k <= n // 2 AS calibration FROM x")
def cal_eval_split(spark, sf):
    return splits.halves(samples(spark, sf).filter("not should_block").select("sample_id"), "sample_id").select("sample_id", "calibration")


@query(f"WITH {S}, x AS (SELECT sample_id, row_number() OVER (PARTITION BY {GROUP} ORDER BY doc_id) - 1 AS k FROM s) SELECT sample_id, CASE WHEN k % 2 = 0 THEN 'early' ELSE 'late' END AS segment FROM x")
def early_late_split(spark, sf):
    return splits.early_late(_grouped(spark, sf), "grp", "doc_id").select("sample_id", "segment")


@query(f"WITH {S}, h AS (SELECT sample_id, row_number() OVER (ORDER BY ('0x' || substr(md5(sample_id), 1, 8))::UBIGINT, sample_id) AS k, count(*) OVER () AS n FROM s WHERE NOT should_block), f AS (SELECT DISTINCT source AS held_family FROM s WHERE should_block) SELECT held_family, sample_id, CASE WHEN should_block THEN CASE WHEN source = held_family THEN 'test' ELSE 'train' END WHEN k <= n // 2 THEN 'train' ELSE 'test' END AS role FROM s LEFT JOIN h USING (sample_id) CROSS JOIN f")
def leave_family_out(spark, sf):
    return splits.leave_family_out(samples(spark, sf).select("sample_id", "dataset_source", "should_block"), "dataset_source", "should_block", "sample_id")


@query(f"WITH {S}, x AS (SELECT sample_id, row_number() OVER (ORDER BY length(text), sample_id) - 1 AS k, count(*) OVER () // 3 AS t FROM s) SELECT sample_id, least(2, k // greatest(t, 1))::INT AS tercile FROM x")
def terciles(spark, sf):
    return splits.terciles(scored(spark, sf), ["length", "sample_id"]).select("sample_id", "tercile")


GRID = [round(k / 20, 2) for k in range(21)]
SWEEP = f"{SC}, g AS (SELECT unnest({GRID!r}::DOUBLE[]) AS theta)"
COUNTS = "count(*) FILTER (WHERE y = 1 AND score >= theta) AS tp, count(*) FILTER (WHERE y = 0 AND score >= theta) AS fp, count(*) FILTER (WHERE y = 1 AND score < theta) AS fn"
F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"


@query(f"WITH {SWEEP}, x AS (SELECT theta, {COUNTS} FROM c, g GROUP BY theta) SELECT theta, tp, fp, fn, round({F1}, 9) AS f1 FROM x")
def threshold_sweep(spark, sf):
    return _rounded(detection.threshold_sweep(scored(spark, sf), GRID), "f1")


@query(f"WITH {SWEEP}, f AS (SELECT *, (row_number() OVER (PARTITION BY {GROUP} ORDER BY doc_id) - 1) % 5 AS fold FROM c), x AS (SELECT h.range AS held, theta, {COUNTS} FROM f, g, range(5) h WHERE fold <> h.range GROUP BY ALL), b AS (SELECT held, theta, round({F1}, 4) AS f1 FROM x) SELECT held AS fold, theta, f1 FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY f1 DESC, theta) AS k FROM b) WHERE k = 1")
def oof_threshold(spark, sf):
    grouped = scored(spark, sf).withColumn("grp", splits.risk_group(F.col("dataset_source"), F.col("should_block"), DIRECT, INDIRECT))
    return detection.out_of_fold_threshold(splits.group_folds(grouped, "grp", "doc_id").select("fold", "y", "score"), GRID)
