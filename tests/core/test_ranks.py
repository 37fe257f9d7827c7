"""Running totals, places, mid-ranks and percentiles over ranges, against plain loops; draws in chunks."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics, quantiles, ranks, resample
from tidewatch.sources import tables


@pytest.fixture
def many_parts(spark):
    """Ranges of a few rows each, so that groups straddle them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def grouped_rows():
    rnd = random.Random(4)
    groups = ["hot"] * 6 + ["b", None, "c"]
    return [(i, rnd.choice(groups), rnd.choice([None, 0.5, *(rnd.random() for _ in range(4))]), rnd.randint(-3, 9)) for i in range(900)]


def test_running_totals_of_straddling_groups(many_parts):
    rows = grouped_rows()
    frame = many_parts.createDataFrame(rows, "id long, g string, x double, v int")
    got = ranks.running(frame, ["g"], [F.desc_nulls_last("x"), "id"], {"total": F.col("v"), "n": F.lit(1)})
    assert got.columns == ["id", "g", "x", "v", "total", "n"]
    expected, sums = {}, {}
    for i, g, _, v in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
        total, n = sums.get(g, (0, 0))
        sums[g] = expected[i] = (total + v, n + 1)
    assert {r.id: (r.total, r.n) for r in got.collect()} == expected


def test_places_and_levels(many_parts):
    rows = grouped_rows()
    frame = many_parts.createDataFrame(rows, "id long, g string, x double, v int")
    placed = {r.id: r.pos for r in ranks.position(frame, [], ["id"]).collect()}
    assert placed == {i: i for i in range(900)}
    found = {(r.g, r.x): (r.c, r.le) for r in ranks.levels(frame, ["g"], "x").collect()}
    for (g, x), (c, le) in found.items():
        same = [r[2] for r in rows if r[1] == g and r[2] is not None]
        assert (c, le) == (same.count(x), sum(y <= x for y in same))
    assert len(found) == len({(g, x) for _, g, x, _ in rows if x is not None})
    assert ranks.position(frame.limit(0), ["g"], ["id"]).count() == 0


def test_standing_is_the_share_below_and_half_of_equal(many_parts):
    rows = grouped_rows()
    frame = many_parts.createDataFrame(rows, "id long, g string, x double, v int")
    reference = frame.filter("v > 3").groupBy("g", "x").agg(F.count("*").alias("c"))
    for r in ranks.standing(frame, reference, "x", "share", ["g"]).collect():
        ref = [x for _, g, x, v in rows if v > 3 and g == r.g and x is not None]
        if r.x is None:
            assert r.share is None
        else:
            assert math.isclose(r.share, (sum(y < r.x for y in ref) + sum(y <= r.x for y in ref)) / 2 / len(ref))


def test_percentiles_equal_numpy(many_parts):
    rows = grouped_rows()
    frame = many_parts.createDataFrame(rows, "id long, g string, x double, v int")
    for r in quantiles.linear(frame, "x", [0.0, 0.1, 0.5, 0.975, 1.0], ["g"]).collect():
        values = [x for _, g, x, _ in rows if g == r.g and x is not None]
        assert np.allclose([r.p0, r.p10, r.p50, r.p98, r.p100], np.percentile(values, [0, 10, 50, 97.5, 100]))
    assert quantiles.linear(frame.limit(0), "x", [0.5], ["g"]).count() == 0


def test_rank_metrics_equal_loops(many_parts):
    rnd = random.Random(6)
    rows = [(f"s{i}", rnd.randint(0, 1), rnd.randint(0, 30) / 10) for i in range(400)]
    frame = many_parts.createDataFrame(rows, "sample_id string, y int, score double")
    pos, neg = ([s for _, y, s in rows if y == k] for k in (1, 0))
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert math.isclose(metrics.auroc(frame).first().auroc, won / len(pos) / len(neg))
    hits = area = 0
    for k, (_, y, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
        hits += y
        area += y * hits / k
    assert math.isclose(metrics.average_precision(frame).first().auprc, area / len(pos))
    order = sorted(s for *_, s in rows)
    mid = {s: (order.index(s) + 1 + len(order) - order[::-1].index(s)) / 2 for s in order}
    assert all(math.isclose(r.rank, mid[r.score]) for r in metrics.average_ranks(frame, "score", "rank").collect())


def test_draws_do_not_depend_on_chunks(spark, monkeypatch):
    sizes = spark.createDataFrame([("a", 37), ("b", 5), ("c", 0)], "g string, n long")
    whole = sorted(map(tuple, resample.draws(sizes, 3, ["g"], "salt:").collect()))
    monkeypatch.setattr(resample, "CHUNK", 4)
    assert sorted(map(tuple, resample.draws(sizes, 3, ["g"], "salt:").collect())) == whole
    totals = {}
    for b, g, _, w in whole:
        totals[b, g] = totals.get((b, g), 0) + w
    assert totals == {(b, g): n for b in range(3) for g, n in (("a", 37), ("b", 5))}


def test_no_window_holds_all_rows(many_parts):
    """The only single-partition exchanges are those of totals: a row for each range."""
    frame = many_parts.range(1000).withColumn("x", F.col("id") % 7)
    plan = ranks.position(frame, [], ["x", "id"])._jdf.queryExecution().executedPlan().toString()
    at = [k for k, line in enumerate(plan.split("\n")) if "SinglePartition" in line]
    assert all("HashAggregate" in plan.split("\n")[k + 1] for k in at)


def test_draws_are_not_broadcast_and_keep_their_tasks(spark):
    placed = resample.numbered(spark.range(3_000).select("id", (F.col("id") % 2).cast("int").alias("hit")), "id")
    found = resample.drawn(placed, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [pos" in plan and "BroadcastHashJoin [pos" not in plan and "REPARTITION_BY_NUM" in plan
    assert found.agg(F.sum("w")).first()[0] == 60_000


def test_rates_of_ten_thousand_replicates_shuffle_no_draws(spark, monkeypatch):
    """As many replicates as the reference takes; blocks of 128 places, so that draws meet several."""
    rows = [(i, i % 7 < 2 if i % 11 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, h boolean")
    few = [resample.bootstrap_rate(frame, F.col("h"), "id", 200, "t:")]
    monkeypatch.setattr(resample, "BLOCK", 128)
    few.append(resample.bootstrap_rate(frame, F.col("h"), "id", 200, "t:"))
    whole = resample.bootstrap_rate(frame.filter("id < 150"), F.col("h"), "id", 10_000, "t:")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [(pos" in plan and "hashpartitioning(pos#" not in plan
    assert sum("md5(" in line for line in plan.split("\n")) == 1  # a digest a draw
    monkeypatch.setattr(resample, "BITS", 100)
    few.append(resample.bootstrap_rate(frame, F.col("h"), "id", 200, "t:"))
    assert "SortMergeJoin [pos" in few[-1]._jdf.queryExecution().executedPlan().toString()

    def drawn(n, b, k):
        return int(hashlib.md5(f"t:{b}:{k}".encode()).hexdigest()[:8], 16) % n

    for found, n, replicates in [(f, 300, 200) for f in few] + [(whole, 150, 10_000)]:
        shares = [sum(bool(rows[drawn(n, b, k)][1]) for k in range(n)) / n for b in range(replicates)]
        assert np.allclose(found.first(), np.percentile(shares, [2.5, 97.5]))
    none = resample.bootstrap_rate(frame.limit(0), F.col("h"), "id", 10, "t:").first()
    assert tuple(none) == (0.0, 0.0)


def test_scores_of_a_replicate_share_their_draws(spark, monkeypatch):
    made, draws = [], resample.draws
    monkeypatch.setattr(resample, "draws", lambda *a: made.append(a) or draws(*a))
    frame = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("y"), F.rand(3).alias("s"))
    both = resample.bootstrap_auroc(frame.withColumn("t", F.col("s")), "id", 4, ["s", "t"])
    assert both.count() == 4 and both.filter("s != t").count() == 0
    assert len(made) == 1 and "BroadcastHashJoin [pos" not in both._jdf.queryExecution().executedPlan().toString()


def test_no_side_that_grows_is_broadcast(spark, tmp_path):
    frame = spark.createDataFrame([(i, i % 3, i / 7) for i in range(60)], "id long, g long, x double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(ranks.position(frame, ["g"], ["id"]))
    levels = frame.groupBy("x").agg(F.count("*").alias("c"))
    looked_up = ranks.standing(frame, levels, "x", "share")
    assert "SortMergeJoin" in plan(looked_up) and looked_up.count() == 60
    for name, rows in (("documents", spark.range(40).selectExpr("id as doc_id", "repeat('a', int(id)) as text", "'en' as lang", "'s' as source")), ("labels", spark.range(40).selectExpr("id as doc_id", "1 as quality", "0 as toxic"))):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    found = tables.samples(spark, str(tmp_path)).select("doc_id", "length")
    assert "Broadcast" not in plan(found) and {r.doc_id: r.length for r in found.collect()} == {i: i for i in range(40)}
