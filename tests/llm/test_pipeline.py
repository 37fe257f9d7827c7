"""The pipeline's stages, one after another, on a small corpus."""

import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import minhash
from tidewatch.llm.common import RELEASE, Scratch
from tidewatch.llm.paragraphs import substring_dedup

from .test_ops import DOCS, words


def test_stages(spark, tmp_path):
    rnd = random.Random(6)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop"}

    def text(k, n):
        return " ".join("".join(rnd.choice(letters[k]) for _ in range(5)) for _ in range(n))

    passage = words(rnd, 80)
    rows = [(i, text(k, 80), k, rnd.choice("xyz"), 400) for i, k in enumerate(rnd.choice(["aa", "bb"]) for _ in range(200))]
    rows += [(500 + i, rows[0][1], "aa", "x", 400) for i in range(5)]
    rows += [(600 + i, f"{text('aa', 60)} {passage} {text('aa', 60)}", "aa", "y", 400) for i in range(3)]
    rows += [(700, None, "aa", "x", 0), (701, "12 34", None, None, 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = frame.collect()
        if k < 4:
            assert frame.columns == corpus_pipeline.COLUMNS
    ids = {name: [r.doc_id for r in found] for name, found in seen.items()}
    assert set(ids["language ID"]) == {r[0] for r in rows} - {700, 701}
    assert set(ids["language ID"]) - set(ids["MinHash near-dedup"]) == {500, 501, 502, 503, 504}
    assert sum(passage in r.text for r in seen["substring dedup"]) == 1 and len(ids["substring dedup"]) == len(ids["MinHash near-dedup"])
    assert max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 2
    assert sorted(ids["BPE"]) == sorted(ids["mixing"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.ids_sha256 for r in whole) == sorted(r.ids_sha256 for r in seen["BPE"])


def test_near_dedup_links_from_80_hundredths_on(spark, tmp_path):
    rnd, rows = random.Random(15), []
    for k in range(20):
        base = words(rnd, 104).split()
        # A copy with the last 10 to 11 of 100 shingles changed has similarity 0.80 to 0.82.
        rows += [(k, " ".join(base), "en", "x", 0), (100 + k, " ".join(base[: 104 - 10 - k % 2] + words(rnd, 10 + k % 2).split()), "en", "x", 0)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == set(range(20))


def test_bands_miss_few_pairs():
    for percent, bands, size in ((80, corpus_pipeline.BANDS, corpus_pipeline.ROWS), (85, minhash.BANDS, minhash.ROWS)):
        assert (1 - (percent / 100) ** size) ** bands < 1 / 86_000


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    before, setting = files(), spark.conf.get(RELEASE, None)
    kept = Scratch(spark, "test").keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(RELEASE, None) == setting and kept.count() == 7


def test_stages_drop_tables_that_nothing_reads(spark, tmp_path, monkeypatch):
    rnd, made = random.Random(16), []
    passage, near = words(rnd, 60), words(rnd, 100)
    texts = [f"{words(rnd, 40)} {passage} {words(rnd, 40)}" for _ in range(6)] + [near, f"{near} more"]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)] + [(None, "a b", "en", "x", 3)], DOCS)
    scratch = Scratch(spark, "test")
    own = scratch.keep(spark.range(3))
    found = substring_dedup(docs, scratch=scratch)
    assert len(scratch.kept) == 2 and scratch.kept[0][0] is own and own.count() == 3
    rows = found.collect()
    assert len(rows) == 9 and sum(passage in r.text for r in rows) == 1 and sum(r.removed_words > 40 for r in rows) >= 5
    monkeypatch.setattr(corpus_pipeline, "Scratch", lambda *a: made.append(Scratch(*a)) or made[-1])
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {None, *range(7)} and len(made[0].kept) == 1
