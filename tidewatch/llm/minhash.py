"""Operator 1, near-duplicate documents: banded MinHash with sequential Bayesian verification.

Documents of equal shingle sets are one class. Classes that share a band of their MinHash
signature are candidates. A candidate pair's signatures are compared batch by batch; it is
pruned once the posterior probability that its similarity reaches the threshold falls below
the chosen miss probability. Survivors are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, among, hand_back, strings, table
from .linking import ends, link
from .shingles import band_keys, batched, jaccard_counts, minhash, shingle_sets

#: 48 bands of 9: of pairs at the threshold of 0.85, one in 310,000 shares no band; at 0.6, four in ten share one.
BANDS, ROWS = 48, 9
#: Minima that signatures keep for the comparison of candidates.
KEPT = 144
#: Linked from this many hundredths on.
PERCENT = 85
#: Minima compared at a time, and the posterior probability below which a pair is pruned.
STEP, MISS = 24, 1e-6


def posterior(m: int, n: int, t: float) -> float:
    """P(similarity >= t) after m equal minima of n, from a uniform prior."""
    return sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))


@lru_cache(8)
def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest equal minima of n with which a pair isn't pruned."""
    return next(m for m in range(n + 1) if posterior(m, n, percent / 100) >= miss)


def surviving(a: np.ndarray, b: np.ndarray, percent: int, miss: float = MISS, step: int = STEP) -> np.ndarray:
    """Which rows of two matrices of signatures are left after all batches."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1], step):
        equal[alive] += (a[alive, at : at + step] == b[alive, at : at + step]).sum(axis=1)
        alive = alive[equal[alive] >= least_matches(min(at + step, a.shape[1]), percent, miss)]
    return alive


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, set_hash, signature and bands' keys."""
    import xxhash

    names = ["doc_id", "n_shingles", "set_hash", "signature", "keys"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for raws in batched(strings(batch.column(1))):
                flat, offsets = shingle_sets(raws)
                signs = minhash(flat, offsets, bands * rows)
                hashes = [xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                keys = band_keys(signs, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(raws)), pa.array(np.diff(offsets), pa.int64()), pa.array(hashes, pa.binary()), pa.array([s.tobytes() for s in signs[:, :KEPT]], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel(), pa.int64())),
                    ],
                    names,
                )
                at += len(raws)
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, n_shingles long, set_hash binary, signature binary, keys array<long>")


def _bayes(percent: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                if part.num_rows:
                    a, b = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint32).reshape(part.num_rows, -1) for k in (2, 3))
                    alive = pa.array(surviving(a, b, percent))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(alive), part.column(1).take(alive)], ["a", "b"])

    return kept


def _named(texts: list[str]) -> Iterator[tuple[list[bytes], list[str]]]:
    at = 0
    for raws in batched(texts):
        yield raws, texts[at : at + len(raws)]
        at += len(raws)


def _exact(percent: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids_a, ids_b, texts_a, texts_b = (c.to_pylist() for c in part.columns)
                # Pairs come by b, and hubs are in many: each text of a part is cut once.
                texts = list(dict.fromkeys(texts_a + texts_b))
                sets = {}
                for raws, names in _named(texts):
                    flat, offsets = shingle_sets(raws)
                    sets.update((t, flat[i:j]) for t, i, j in zip(names, offsets[:-1].tolist(), offsets[1:].tolist()))
                left, right = [], []
                for a, b, ta, tb in zip(ids_a, ids_b, texts_a, texts_b):
                    shared, all_ = jaccard_counts(sets[ta], sets[tb])
                    if 100 * shared >= percent * all_:
                        left.append(a)
                        right.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        hand_back()

    return kept


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, at = batch.column(0).to_numpy(), 0
        for raws in batched(strings(batch.column(1))):
            flat, offsets = shingle_sets(raws)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(ids[at : at + len(raws)], np.diff(offsets)))], ["shingle", "node"])
            at += len(raws)
    hand_back()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Two documents are linked if 100 * shared >= percent * union of their shingle sets;
    component_id is the smallest doc_id that can be reached over links, kept is true where
    that is doc_id. Null texts and texts without words have an empty set, are linked with
    nothing and kept. Repeated rows stay repeated, with equal results; rows that share a
    doc_id count as one document. A null doc_id is linked with nothing, has a null
    component_id and is kept. Other columns of docs are not looked at. An empty table
    gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = scratch.keep(signatures(docs, bands, rows))
    full = signs.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(full.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("size")))
    heads = full.join(classes.select("set_hash", F.col("node").alias("doc_id")), ["set_hash", "doc_id"], "left_semi")
    buckets = heads.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"))

    def compare(pairs: DataFrame) -> DataFrame:
        by = among(full.select(F.col("doc_id").alias("a"), "signature"), scratch.keep(ends(pairs)), "a").dropDuplicates(["a"])
        signed = pairs.join(by.withColumnRenamed("signature", "sa"), "a").join(by.select(F.col("a").alias("b"), F.col("signature").alias("sb")), "b")
        alive = scratch.keep(signed.select("a", "b", "sa", "sb").mapInArrow(_bayes(percent), "a long, b long"))
        texts = scratch.keep(among(docs.withColumnRenamed("doc_id", "a").filter("text is not null"), scratch.keep(ends(alive)), "a"))
        both = alive.join(texts.withColumnRenamed("text", "ta"), "a").join(texts.select(F.col("a").alias("b"), F.col("text").alias("tb")), "b")
        found = scratch.keep(both.select("a", "b", "ta", "tb").mapInArrow(_exact(percent), "a long, b long").distinct())
        scratch.drop(texts)
        return found

    def own(ids: DataFrame) -> DataFrame:
        """How many shingles of each document no other of them has."""
        texts = among(docs.withColumnRenamed("doc_id", "node").filter("text is not null"), ids, "node").dropDuplicates(["node"])
        alone = texts.mapInArrow(_shingle_rows, "shingle long, node long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
        return ids.join(alone.groupBy("node").agg(F.count("*").alias("own")), "node", "left").fillna(0, ["own"])

    found = link(buckets, compare, own, percent, scratch)
    # A link of two documents is one of their classes.
    named = classes.join(found, "node").select("set_hash", F.col("component"))
    named = classes.select("set_hash", "node").join(named, "set_hash", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    linked = signs.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    linked = linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    alone = signs.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
