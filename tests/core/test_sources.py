"""Readers, fallbacks, gates, reports and seals."""

import hashlib
import json

import pytest

from tidewatch.operators import decisions
from tidewatch.sources import readers, reports


def test_csv_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Goal,Target\n"line one\nline two",yes\n,skipped\nthird,\n')
    got = readers.advbench(spark, f"{tmp_path}/a.csv").collect()
    assert [(r.sample_id, r.turns[0].content, r.metadata) for r in got] == [("advbench-0", "line one\nline two", {"target": "yes"}), ("advbench-2", "third", {})]
    (tmp_path / "j.csv").write_text("Goal,Category\nx,\ny,fraud\n")
    assert [r.harm_category for r in readers.jailbreakbench(spark, f"{tmp_path}/j.csv").collect()] == ["general", "fraud"]
    (tmp_path / "h.csv").write_text("Behavior,ID\nx,b7\ny,\n")
    assert [r.sample_id for r in readers.harmbench(spark, f"{tmp_path}/h.csv").collect()] == ["harmbench-b7", "harmbench-hb-1"]
    (tmp_path / "x.csv").write_text("prompt,label\nx,safe\n")
    row = readers.xstest(spark, f"{tmp_path}/x.csv").first()
    assert (row.should_block, row.harm_category, row.scenario_type) == (False, "safe", "over_refusal_control")


@pytest.mark.parametrize("wrap", [False, True])
def test_agentharm(spark, tmp_path, wrap):
    rows = [{"id": "q1", "goal": "x", "category": "c"}, {"prompt": "y", "harm_category": "d"}, {"id": "q3"}]
    (tmp_path / "a.json").write_text(json.dumps({"behaviors": rows} if wrap else rows))
    got = readers.agentharm(spark, f"{tmp_path}/a.json").collect()
    assert [(r.sample_id, r.turns[0].content, r.harm_category) for r in got] == [("q1", "x", "c"), ("agentharm-1", "y", "d")]


def test_trajectories(spark, tmp_path):
    turns = [{"role": "user", "content": "hi"}, {"role": "agent", "thought": "t", "action": "a"}, {"role": "agent", "content": "c"}, {"role": "environment", "content": "e"}]
    (tmp_path / "t.jsonl").write_text(json.dumps({"id": 7, "label": 1, "contents": [turns], "risk_source": "benign"}) + "\n\n")
    row = readers.trajectories(spark, f"{tmp_path}/t.jsonl").first()
    assert [(t.role, t.content) for t in row.turns] == [("user", "hi"), ("assistant", "[THOUGHT] t\n[ACTION] a"), ("assistant", "c"), ("tool", "e")]
    assert row.sample_id == "7" and row.should_block and row.metadata == {"risk_source": "benign"}


def test_dispatch(spark):
    assert readers.load_dataset(spark, "policy_compliance", include_held_out=True).count() == 50
    assert readers.load_dataset(spark, "policy_compliance").count() == 42
    assert readers.policy_samples(spark).filter("should_block").count() == 25
    assert readers.load_dataset(spark, "harmbench").count() == 0
    assert readers.load_dataset(spark, "xstest", include_held_out=True).filter("should_block").count() == 0
    with pytest.raises(ValueError):
        readers.load_dataset(spark, "none")
    with pytest.raises(FileNotFoundError):
        readers.load_dataset(spark, "advbench", strict=True)
    assert readers.load_all(spark, {}, limit=2, include_held_out=True).groupBy("dataset_source").count().filter("count = 2").count() == 3


def test_report_and_seals(spark, tmp_path):
    samples = spark.createDataFrame([("a", "s", True), ("b", "s", False)], "sample_id string, dataset_source string, should_block boolean")
    results = spark.createDataFrame([("a", "allow", 0.5, 1.0), ("b", "allow", 0.5, 1.0)], "sample_id string, decision string, confidence double, latency_ms double")
    rows = reports.report_rows(samples, results)
    assert {r.sample_id: r.evaluation_correct for r in rows.collect()} == {"a": False, "b": True}
    assert reports.write_csv(rows, f"{tmp_path}/csv") and not reports.write_csv(rows.limit(0), f"{tmp_path}/none")
    assert decisions.same_rows(reports.sealed(rows.withColumn("latency_ms", rows.latency_ms * 2)).select("sha256"), reports.sealed(rows).select("sha256"))
    folder = tmp_path / "seals"
    folder.mkdir()
    for name, body, seal in (("ok", b"{}", b"{}"), ("bad", b"{}", b"x"), ("free", b"{}", None), ("lost", None, b"x")):
        if body is not None:
            (folder / f"{name}.json").write_bytes(body)
        if seal is not None:
            (folder / (f"{name}.sha256" if name == "ok" else f"{name}.json.sha256")).write_text(hashlib.sha256(seal).hexdigest())
    assert {r.name: r.status for r in reports.verify_seals(spark, str(folder)).collect()} == {"ok": "ok", "bad": "mismatch", "free": "unsealed", "lost": "orphan"}


def test_only_a_missing_file_falls_back(spark, tmp_path, monkeypatch):
    with pytest.warns(UserWarning, match="made-up"):
        assert readers.load_dataset(spark, "advbench", str(tmp_path / "none.csv"), include_held_out=True).count() == 5
    # Readers take absent columns as null, and rows without a prompt are left out: no samples are made up.
    (tmp_path / "wrong.csv").write_text("a,b\n1,2\n")
    assert readers.load_dataset(spark, "advbench", f"{tmp_path}/wrong.csv", include_held_out=True).count() == 0

    def broken(spark, path):
        raise OSError("damaged")

    monkeypatch.setitem(readers.READERS, "advbench", broken)
    with pytest.raises(OSError, match="damaged"):
        readers.load_dataset(spark, "advbench", f"{tmp_path}/wrong.csv")
