"""References, resets of all, ends of paths, state reads and the sealed flight log, against plain loops."""

import glob
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import QuantileNormalizer
from tidewatch.sources.reports import canonical_json, sealed
from tidewatch.streaming import fuse
from tidewatch.streaming.flightlog import FlightLog
from tidewatch.streaming.reference import Reference

SCORES = "path string, t double, seq long, score double"


def rows_of(n=240, seed=3):
    rnd = random.Random(seed)
    return [(rnd.choice("abc"), float(k // 2), k, round(rnd.random(), 2)) for k in range(n)]


def fitted(spark, scores):
    return QuantileNormalizer().fit(spark.createDataFrame([(s,) for s in scores], "score double"))


def share(scores, x):
    return (sum(s < x for s in scores) + sum(s <= x for s in scores)) / 2 / len(scores)


@pytest.mark.parametrize("scores", [[0.5], [0.25, 0.25, 0.75], [round(random.Random(1).random() ** 6, 3) for _ in range(500)]])
def test_reference_equals_the_normaliser(spark, scores):
    asked = [(i, x) for i, x in enumerate([None, float("nan"), float("-inf"), float("inf"), -1.0, 2.0, 0.0, *scores, *(s + 1e-9 for s in scores)])]
    frame = spark.createDataFrame(asked, "id int, score double")
    got = {r.id: r.norm for r in Reference.of(fitted(spark, scores).levels).placed(frame).collect()}
    assert len(got) == len(asked)
    for i, x in asked:
        if x is None or math.isnan(x):
            assert got[i] is None
        else:
            assert math.isclose(got[i], share(scores, x), abs_tol=1e-12)


def test_references_change_between_batches_and_state_stays(spark, tmp_path):
    rows, old, new = rows_of(), [k / 10 for k in range(10)], [k / 20 for k in range(10)]
    frame = spark.createDataFrame(rows, SCORES)
    run = fuse.Replay(spark, f"file://{tmp_path}")
    refs = [Reference.of(fitted(spark, s).levels, v) for v, s in ((1, old), (2, new))]
    for part, ref in zip((frame.filter("t < 60"), frame.filter("t >= 60")), refs):
        run.feed(part, fuse.Fuse("cusum", threshold=1e9, normalizer=ref, options={"k_ref": 0.3}))
    value, seen = {}, {r.seq: r for r in run.seen().collect()}
    assert len(seen) == len(rows)
    for p, t, seq, raw in sorted(rows, key=lambda r: (r[1], r[2])):
        x = share(old if t < 60 else new, raw)
        value[p] = max(0.0, value.get(p, 0.0) + x - 0.3)
        r = seen[seq]
        assert (r.raw, r.reference) == (raw, 1 if t < 60 else 2)
        assert math.isclose(r.score, x, abs_tol=1e-12) and math.isclose(r.stat_value, value[p], abs_tol=1e-9)
    kept = {r.path: (r.value, r.turns) for r in fuse.values(spark, run.checkpoint).collect()}
    assert {p: n for p, (_, n) in kept.items()} == {p: sum(r[0] == p for r in rows) for p in value}
    assert all(math.isclose(kept[p][0], v, abs_tol=1e-9) for p, v in value.items())


def test_resets_of_all_and_of_one_path(spark, tmp_path):
    rows = rows_of()
    frame = spark.createDataFrame(rows, SCORES).withColumn("reset", F.lit(False))
    control = spark.createDataFrame([("a", 90.0, 100_000, None, True)], SCORES + ", reset boolean")
    watch = fuse.Fuse("cusum", threshold=1e9, resets=(45.0, 20.0), options={"k_ref": 0.2})
    run = fuse.replay(frame.unionByName(control), folder=f"file://{tmp_path}", fuse=watch)
    value, last = {}, {}
    for p, t, seq, x in sorted([*rows, ("a", 90.0, 100_000, None)], key=lambda r: (r[1], r[2])):
        if x is None or any(last.get(p, t) < cut <= t for cut in (20.0, 45.0)):
            value[p] = 0.0
        if x is not None:
            value[p], last[p] = max(0.0, value.get(p, 0.0) + x - 0.2), t
    kept = {r.path: r.value for r in fuse.values(spark, run.checkpoint).collect()}
    assert set(kept) == set(value) and all(math.isclose(kept[p], v, abs_tol=1e-9) for p, v in value.items())
    # A reset that is due, but that no observation has met yet.
    later = fuse.Fuse("cusum", resets=(20.0, 45.0, 500.0))
    assert {r.value for r in fuse.values(spark, run.checkpoint, later, 600.0).collect()} == {0.0}


def test_paths_end_with_their_first_trip(spark, tmp_path):
    rows = rows_of(400, 5)
    watch = fuse.Fuse("cusum", threshold=1.5, stop_on_trip=True, options={"k_ref": 0.45})
    run = fuse.replay(spark.createDataFrame(rows, SCORES), folder=f"file://{tmp_path}", fuse=watch)
    seen = {}
    for r in run.seen().collect():
        seen.setdefault(r.path, []).append((r.turn_index, r.tripped))
    for p in "abc":
        value, expected = 0.0, []
        for k, x in enumerate(x for q, _, _, x in sorted(rows, key=lambda r: (r[1], r[2])) if q == p):
            value = max(0.0, value + x - 0.45)
            expected.append((k, value >= 1.5))
            if expected[-1][1]:
                break
        assert sorted(seen[p]) == expected and expected[-1][1]
    assert all(r.stopped for r in fuse.values(spark, run.checkpoint).collect())


def logged(spark, folder):
    log = FlightLog(f"file://{folder}/log")
    run = fuse.replay(spark.createDataFrame(rows_of(), SCORES), folder=f"file://{folder}", sink=log.write, fuse=fuse.Fuse("cusum", options={"k_ref": 0.2}))
    return log, run


def test_flight_log_holds_each_batch_once(spark, tmp_path):
    log, run = logged(spark, tmp_path)
    assert [(r.batch, r.status) for r in log.verify(spark).orderBy("batch").collect()] == [(0, "ok"), (1, "ok"), (2, "ok")]
    held = log.read(spark, fuse.OUT)
    assert sorted(r.seq for r in held.collect()) == [r[2] for r in rows_of()]
    assert held.filter("tripped and size(evidence) = 0").count() == 0 and held.filter("tripped").count() > 0
    files = sorted(glob.glob(f"{tmp_path}/log/**/part-*", recursive=True))
    log.write(held.drop("batch").limit(5), 1)  # a batch that is sent again
    assert sorted(glob.glob(f"{tmp_path}/log/**/part-*", recursive=True)) == files
    line = next(x for f in files if "/data/" in f for x in open(f))
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"


def test_flight_log_shows_what_was_changed(spark, tmp_path):
    log, _ = logged(spark, tmp_path)
    data = lambda k: max(glob.glob(f"{tmp_path}/log/data/batch={k}/part-*"), key=os.path.getsize)
    manifest = glob.glob(f"{tmp_path}/log/manifests/batch=2/part-*")[0]
    content = open(data(0), "rb").read()
    with open(data(0), "wb") as f:
        f.write(content.replace(b'"seq"', b'"sEq"', 1))
    with open(f"{tmp_path}/log/data/batch=1/part-extra", "w") as f:
        f.write("{}\n")
    text = open(manifest).read()
    with open(manifest, "w") as f:
        f.write(text.replace('"observations":', '"observations":1', 1))
    for crc in glob.glob(f"{tmp_path}/log/**/.*.crc", recursive=True):
        os.remove(crc)
    assert {r.batch: r.status for r in log.verify(spark).collect()} == {0: "changed", 1: "unknown", 2: "broken"}


def test_canonical_json_sorts_all_depths(spark):
    kind = "b struct<z: int, a: array<struct<y: int, x: string>>>, a map<string, struct<q: int, p: int>>, n int, wall_time double"
    frame = spark.createDataFrame([(((1, [(2, "é")])), {"k2": (1, 2), "k1": (3, None)}, None, 5.0)], kind)
    text = frame.select(canonical_json(frame).alias("j")).first().j
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(text)["a"] == {"k1": {"p": None, "q": 3}, "k2": {"p": 2, "q": 1}}
    again = frame.withColumn("wall_time", F.lit(9.0))
    assert sealed(frame).first().sha256 == sealed(again).first().sha256


def test_a_path_asks_its_state_once_a_batch():
    """Each call goes to the JVM and back, for each path of each micro-batch."""
    import pandas as pd

    from tidewatch.streaming.fuse import Fuse, _Watch

    calls, kept = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append("get")
            return kept.get(self.name, iter(()) if self.name == "recent" else None)

        def exists(self):
            calls.append("exists")
            return self.name in kept

        def update(self, value):
            calls.append("update")
            kept[self.name] = value

        put = update

    class Handle:
        def getValueState(self, name, *args, **kwargs):
            return State(name)

        getListState = getValueState

    watch = _Watch(Fuse("cusum"), None)
    watch.init(Handle())
    rows = pd.DataFrame({"path": "a", "t": [2.0, 1.0, None], "seq": [2, 1, 3], "raw": [0.9, 0.8, 0.7], "score": [0.9, 0.8, 0.7], "reset": False})
    (first,) = watch.handleInputRows(("a",), iter([rows.head(2), rows.tail(1)]), None)
    assert first["seq"].tolist() == [1, 2, 3] and first["late"].tolist() == [False, False, True]
    assert calls == ["get", "update", "update"]
    (second,) = watch.handleInputRows(("a",), iter([rows.assign(t=[4.0, 1.5, 3.0])]), None)
    assert second["late"].tolist() == [True, False, False] and second["turn_index"].dropna().tolist() == [2, 3]
    assert calls[3:] == ["get", "get", "update", "update"]


def test_paths_of_a_bucket_share_a_frame_and_keep_states_of_their_own(spark, tmp_path):
    import pandas as pd

    from tidewatch.streaming.fuse import Fuse, _Buckets

    kept, calls = {}, []

    class Map:
        def getValue(self, key):
            calls.append("get")
            return kept.get(key)

        def updateValue(self, key, value):
            calls.append("update")
            kept[key] = value

    class Handle:
        def getMapState(self, *args, **kwargs):
            return Map()

    watch = _Buckets(Fuse("cusum"), None)
    watch.init(Handle())
    rows = pd.DataFrame({"path": ["a", "b", None, "a"], "t": [2.0, 1.0, 1.0, 1.0], "seq": [2, 1, 3, 1], "raw": 0.9, "score": 0.9, "reset": False})
    (out,) = watch.handleInputRows((7,), iter([rows.head(3), rows.tail(1)]), None)
    assert sorted(zip(out["path"].fillna("-"), out["seq"])) == [("-", 3), ("a", 1), ("a", 2), ("b", 1)]
    assert len(calls) == 6 and [r[0] for r in kept[("a",)][-1]] == [1.0, 2.0]
    # Through a stream: few buckets, many paths, one of them null, and each path on its own.
    rnd = random.Random(8)
    frame = spark.createDataFrame([(rnd.choice([None, *map(str, range(30))]), float(k // 3), k, rnd.random()) for k in range(600)], SCORES)
    seen = []
    for buckets in (2, None):
        run = fuse.replay(frame, folder=f"file://{tmp_path}", fuse=fuse.Fuse("cusum", options={"k_ref": 0.4}, buckets=buckets), batches=2)
        states = {(r.path, r.value, r.turns, r.stopped) for r in fuse.values(spark, run.checkpoint).collect()}
        seen.append(({json.dumps(r.asDict(True), sort_keys=True) for r in run.seen().collect()}, states))
    assert seen[0] == seen[1] and len(seen[0][0]) == 600 and len(seen[0][1]) == 31
