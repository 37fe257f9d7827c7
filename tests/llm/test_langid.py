"""Language ID's subwords and scores against plain loops; the bounds of its sample; null ids."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import langid
from tidewatch.llm.shingles import BASE, mixed

TEXTS = ["", "a", "Le chat, été!", "one two  three", "日本語 text", "x\x00y é" * 40, "123 456", "ÀÉ"]


def plain_buckets(text):
    """Subwords of 2 to 4 bytes of the spelled text, with no gap inside, hashed one by one."""
    out = []
    for k in langid.GRAMS:
        for i in range(len(text) - k + 1):
            gram = text[i : i + k]
            if 32 in gram[1:-1]:
                continue
            h = 0
            for byte in gram:
                h = (h * BASE + byte + 1) % 2**64
            out.append(int(mixed(np.array([h], np.uint64))[0]) >> (64 - langid.BUCKETS.bit_length() + 1))
    return out


def test_subwords_and_means_equal_plain_loops():
    spelled = [langid.spelled(t) for t in TEXTS]
    buckets, offsets = langid.subwords(spelled)
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), rng.normal(size=3))
    scores = model.scores(spelled)
    for k, text in enumerate(spelled):
        plain = plain_buckets(text)
        assert Counter(buckets[offsets[k] : offsets[k + 1]].tolist()) == Counter(plain)
        mean = np.mean([model.table[b].astype(np.float64) for b in plain], axis=0) if plain else np.zeros(3)
        assert np.allclose(scores[k], mean + model.bias)


def test_samples_and_labels_are_bounded(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 3000).cast("string")).alias("lang"))
    more = rows.filter("doc_id % 3000 < 5").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    counts = {r.lang: r["count"] for r in langid.training_rows(rows.unionByName(more)).groupBy("lang").count().collect()}
    assert len(counts) <= langid.LABELS and sum(counts.values()) <= langid.SAMPLE
    assert {"l0", "l1", "l2", "l3", "l4"} <= set(counts)
    few = langid.training_rows(rows.withColumn("lang", F.lit("l")), labels=2).groupBy("lang").count().first()
    assert few["count"] == langid.EACH
    with pytest.raises(ValueError):
        langid.training_rows(rows, sample=100)


def test_null_ids_are_not_learned_from(spark):
    frame = spark.createDataFrame([(None, "abc", "x"), (1, "def", "y"), (2, None, "z"), (3, "ghi", None)], "doc_id long, text string, lang string")
    assert {r.lang for r in langid.training_rows(frame).collect()} <= {"y"}
    assert [r.h for r in frame.select(langid.held_out().alias("h")).collect()][0] is False
