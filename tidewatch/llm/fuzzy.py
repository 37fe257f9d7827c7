"""Operator 4, document fingerprints: context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text where its value is -1 modulo the block size;
each piece gives one letter. A fingerprint is `size:letters:letters at twice the size`, the
block size being 3 * 2**k, the largest that makes enough pieces. Two fingerprints of equal
or neighbouring block sizes are compared by edit distance.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import BASE, mixed, powers

WINDOW, LETTERS, LEAST = 7, 64, 3
#: A run of letters that two signatures must have in common to be alike at all; half of the shorter one, if that is less.
COMMON = 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprint(raw: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes; `3::` for no bytes."""
    n = len(raw)
    if not n:
        return f"{LEAST}::"
    x = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    room = 1 << max(12, n.bit_length())
    np.cumsum(x * powers(room, BASE)[:n], out=sums[1:])
    back = powers(room, pow(BASE, -1, 1 << 64))
    first = np.maximum(np.arange(1, n + 1) - WINDOW, 0)
    rolling = mixed((sums[1:] - sums[first]) * back[first]) >> np.uint64(32)
    size = LEAST
    while size * LETTERS < n:
        size *= 2
    cuts = np.flatnonzero(rolling % np.uint64(LEAST) == LEAST - 1)
    third = (rolling[cuts] + np.uint64(1)) // np.uint64(LEAST)

    def letters(size: int) -> str:
        """A letter for each piece; pieces after the 63rd are one."""
        ends = cuts[third % np.uint64(size // LEAST) == 0][: LETTERS - 1] + 1
        if not len(ends) or ends[-1] < n:
            ends = np.append(ends, n)
        starts = np.concatenate([[0], ends[:-1]])
        return ALPHABET[(mixed((sums[ends] - sums[starts]) * back[starts]) >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    while size > LEAST and (third % np.uint64(size // LEAST) == 0).sum() < LETTERS // 2:
        size //= 2
    return f"{size}:{letters(size)}:{letters(2 * size)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements that turn a into b; bit-parallel over a."""
    if not a or not b:
        return len(a) + len(b)
    m, masks = len(a), {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, top, full = (1 << m) - 1, 0, m, 1 << (m - 1), (1 << m) - 1
    for c in b:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up), up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(diagonal | right)) & full, right & diagonal & full
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short = min(len(a), len(b))
    if not short:
        return 0.0
    short = min(COMMON, max(1, short // 2))
    runs = {a[i : i + short] for i in range(len(a) - short + 1)}
    if not any(b[i : i + short] in runs for i in range(len(b) - short + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; 0 for block sizes that aren't equal or neighbours, 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
    sa, sb = int(sa), int(sb)
    if sa == sb:
        return max(_alike(a1, b1), _alike(a2, b2))
    if sa == 2 * sb:
        return _alike(a1, b2)
    if sb == 2 * sa:
        return _alike(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of text's code points replaced by as many from the start of following."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def dealt_in_order(docs: DataFrame, tasks: int) -> DataFrame:
    """docs (doc_id, text) with part and head, so that a part's rows and the next part's first row lie together.

    Parts are ranges of doc_id from approximate quantiles. A part's first document is also
    sent, with head set, to the part before it (the first part's to the last), so that each
    document's successor is at hand.
    """
    quantiles = docs.approxQuantile("doc_id", [i / tasks for i in range(1, tasks)], 0.2 / tasks) if tasks > 1 else []
    splits = [-math.inf, *sorted(set(quantiles)), math.inf]
    if len(splits) > 2:
        docs = Bucketizer(splits=splits, inputCol="doc_id", outputCol="part").transform(docs).withColumn("part", F.col("part").cast("int"))
    else:
        docs = docs.withColumn("part", F.lit(0))
    # The first document of each part: as many rows as there are parts, so they can be broadcast.
    heads = sorted(docs.groupBy("part").agg(F.min("doc_id")).collect())
    before = [(doc_id, heads[k - 1][0]) for k, (_, doc_id) in enumerate(heads)]
    sent = docs.sparkSession.createDataFrame(before, "doc_id long, part int")
    sent = docs.drop("part").join(F.broadcast(sent), "doc_id").select("doc_id", "text", "part", F.lit(True).alias("head"))
    both = docs.select("doc_id", "text", "part", F.lit(False).alias("head")).unionByName(sent)
    return both.repartitionByRange(tasks, "part").sortWithinPartitions("part", "head", "doc_id", "text")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part, doc_id and text; the head of the next part ends each part."""
    held: list[tuple] = []  # documents of the same doc_id as the last, which have the same successor

    def ready(text: str, print_: str) -> list[tuple]:
        """held's rows, now that the document after them is known."""
        rows = []
        for doc_id, own, own_print in held:
            other = edited(own, text).encode("utf-8", "surrogatepass")
            second = fingerprint(other)
            rows.append((doc_id, len(own), hashlib.sha256(other).hexdigest(), own_print, second, likeness(own_print, second), likeness(own_print, print_)))
        return rows

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], NAMES)

    part = None
    for batch in batches:
        for piece in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            rows: list[tuple] = []
            for doc_id, text, p, head in zip(*(c.to_pylist() for c in piece.columns)):
                text = text or ""
                print_ = fingerprint(text.encode("utf-8", "surrogatepass"))
                if p == part and held:
                    rows += ready(text, print_)
                held = [] if head else [(doc_id, text, print_)]
                part = p
            if rows:
                yield batch_of(rows)


def _unplaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a place in the order."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        prints = pa.array([fingerprint(t.encode("utf-8", "surrogatepass")) for t in texts], pa.string())
        own = {"doc_id": batch.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "fingerprint": prints}
        none = {n: pa.nulls(len(texts), pa.float64() if n.startswith("near") else pa.string()) for n in NAMES if n not in own}
        yield pa.RecordBatch.from_arrays([(own | none)[n] for n in NAMES], NAMES)


def document_fingerprints(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text) and of its edited text, and likenesses.

    The edited text has its last quarter replaced by the start of the next document in
    doc_id order; the first follows the last. A null text is an empty one; rows of equal
    doc_id follow each other by text; rows with a null doc_id have no place in the order:
    they are no document's successor, and what depends on a successor is null. One document is its own successor. An empty table gives an empty
    result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = every.filter("doc_id is not null")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = dealt_in_order(docs, tasks)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.mapInArrow(_fingerprints, schema).unionByName(every.filter("doc_id is null").mapInArrow(_unplaced, schema))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))
