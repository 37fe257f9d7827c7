"""Operator 6, language ID: averaged hashed subword embeddings and a linear softmax.

A text's letters are lower-cased, everything else is a gap. Subwords are its runs of two to
four bytes of UTF-8 within a word and its bounds, hashed into buckets. A text is the mean of
its subwords' embeddings, scored by a linear softmax; both are trained by stochastic
gradient descent in numpy. Temperature and rejection threshold come from labelled texts
that the descent hasn't seen.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import hand_back, table
from .shingles import BASE, mixed

GRAMS, BUCKETS, DIMENSIONS = (2, 3, 4), 1 << 17, 16
#: Labelled rows that training takes at most, of all languages together and of one, by a hash of doc_id.
SAMPLE, EACH = 6_000, 400
#: Languages that are learned at most: the model has 4 bytes for each of them and bucket, so 134 MB at most.
LABELS = 256
#: Parts of a language that are put in order each for itself first.
SLICES = 64
#: One in so many sampled rows calibrates; passes over the others; step size; rows of a step.
CALIBRATION, EPOCHS, RATE, BATCH = 5, 8, 1.0, 16
#: Share of calibration texts, whose language is found, that rejection may lose.
LOST = 0.002
UNKNOWN = "und"
OTHERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def spelled(text: str) -> bytes:
    """Lower-cased words of a text between single spaces, with a space at both ends."""
    if text.isascii():
        return b" " + b" ".join(text.encode().translate(ASCII_LOWER).split()) + b" "
    return b" " + OTHERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass") + b" "


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of spelled texts, one after another, and where each text's start."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    n, gap = len(data), data == 32
    x = data.astype(np.uint64) + np.uint64(1)
    hashes, owners = [], []
    h = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    for k in range(1, max(GRAMS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(BASE) + x[k - 1 :]
        if k > 2:  # a gap may stand at either end of a subword only
            inside = inside[:m] & ~gap[k - 2 : k - 2 + m]
        if k in GRAMS:
            at = np.flatnonzero(inside[:m] & (owner[:m] == owner[k - 1 :]))
            hashes.append((mixed(h[at]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
            owners.append(owner[at].astype(np.int32))
    hashes, owners = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (hashes, owners))
    order = np.argsort(owners, kind="stable")
    return hashes[order], np.searchsorted(owners[order], np.arange(len(texts) + 1))


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    #: Per bucket, its embedding times the softmax weights: what it adds to each language's score.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        buckets, offsets = subwords(texts)
        counts = np.diff(offsets)
        out = np.zeros((len(texts), len(self.labels)))
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.add.reduceat(self.table[buckets], offsets[some], axis=0, dtype=np.float64) / counts[some, None]
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, calibrated probabilities and whether a text is rejected."""
        known = np.array([t is not None and LETTER.search(t) is not None for t in texts], bool)
        p = softmax(self.scores([spelled(t) if k else b"" for t, k in zip(texts, known)]) / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(len(p)), best], 0.0)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known)], score, ~known | (score < self.threshold)


def lowest(right: np.ndarray) -> float:
    """The probability that all but LOST of rightly named texts reach, from their sorted probabilities.

    Of fewer than 1 / LOST texts the lowest can't tell: the log-odds' lower tail is carried on
    as an exponential one, through the median and the lowest.
    """
    n = len(right)
    if n * LOST >= 1:
        return float(right[int(LOST * n)])
    odds = np.log(right + 1e-12) - np.log1p(1e-12 - right)
    slope = (np.median(odds) - odds[0]) / np.log(max(n, 4) / 2)
    return float(1 / (1 + np.exp(slope * -np.log(n * LOST) - odds[0])))


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each whole text's subwords and how often each occurs: BUCKETS of them at most."""
    out = []
    for at in range(0, len(texts), 64):
        buckets, offsets = subwords([spelled(t) for t in texts[at : at + 64]])
        out += [np.unique(buckets[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """A model of rows (language, buckets, counts), as counted() makes them; every CALIBRATION-th row calibrates it."""
    labels = sorted({lang for lang, _, _ in rows})
    if not labels:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    names = {lang: k for k, lang in enumerate(labels)}
    shares = [(names[lang], b, (c / max(1, c.sum())).astype(np.float32)) for lang, b, c in rows]
    held = shares[::CALIBRATION] if len(rows) >= 10 * CALIBRATION else shares
    used = [r for k, r in enumerate(shares) if k % CALIBRATION] if held is not shares else shares
    rng = np.random.Generator(np.random.PCG64(seed))
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    steps, step = EPOCHS * -(-len(used) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(used))
        for at in range(0, len(order), BATCH):
            chosen = [used[i] for i in order[at : at + BATCH]]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = np.stack([share @ embed[b] for _, b, share in chosen])
            error = softmax(mean @ weights + bias).astype(np.float32)
            error[np.arange(len(chosen)), [k for k, _, _ in chosen]] -= 1
            back = error @ weights.T
            weights -= rate / len(chosen) * (mean.T @ error)
            bias -= rate / len(chosen) * error.sum(axis=0)
            for (_, b, share), g in zip(chosen, back):
                # A mean of n embeddings moves by 1/n of a step on each; the step is set on the mean.
                embed[b] -= rate / len(chosen) / max(float(share @ share), 1e-9) * share[:, None] * g
    model = Model(labels, embed @ weights, bias.astype(np.float64))
    known = [r for r in held if len(r[1])]
    if known:
        z = np.stack([share.astype(np.float64) @ model.table[b] for _, b, share in known]) + model.bias
        truth = np.array([k for k, _, _ in known])
        temperatures = np.geomspace(0.02, 20, 80)
        # Truth counts as sure up to one unseen error, so that texts without any error leave a temperature above 0.
        wrong = 1 / (len(truth) + 2)
        sure = np.full(z.shape, wrong / max(1, len(labels) - 1))
        sure[np.arange(len(z)), truth] = 1 - wrong
        model.temperature = float(min(temperatures, key=lambda t: -(sure * np.log(softmax(z / t) + 1e-12)).sum()))
        p = softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        model.threshold = lowest(right) if len(right) else 0.0
    return model


def held_out():
    """A fifth of documents by doc_id; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


ROWS = "lang string, h long, doc_id long, buckets array<int>, counts array<int>"


def training_rows(docs: DataFrame, sample: int = SAMPLE, each: int = EACH, labels: int = LABELS) -> DataFrame:
    """(lang, h, doc_id, buckets, counts) of labelled rows that aren't held out, the same ones for equal tables.

    The labels languages of the most such rows are learned, of equal ones those that come
    first; no other is ever predicted. Of each the each rows with the smallest hash h of
    doc_id are taken, fewer if they were more than sample together. Texts are counted whole,
    on executors. Rows of null doc_id, text or lang aren't learned from.
    """
    if sample < labels * 2 * CALIBRATION:
        raise ValueError(f"a sample of {sample} rows is too small for {labels} languages")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    learned = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels).collect()]
    rows = rows.filter(F.col("lang").isin(learned)).withColumn("h", F.xxhash64("doc_id"))
    each = min(each, sample // max(1, len(learned)))
    # Hashes alone are put in order: by tasks, by slices of a language, then by language. Texts are read for those up to the last one.
    first = rows.select("lang", "h", "doc_id", F.pmod(F.xxhash64("h"), F.lit(SLICES)).alias("slice"))
    for by in (["lang", "slice"], ["lang"]):
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).filter(F.col("n") <= each).drop("n")
    lasts = first.groupBy("lang").agg(F.max("h").alias("last"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                found = counted(part.column(3).to_pylist())
                lists = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], ["lang", "h", "doc_id", "buckets", "counts"])
        hand_back()

    # A row for each learned language is broadcast.
    chosen = rows.join(F.broadcast(lasts), "lang").filter("h <= last").select("lang", "h", "doc_id", "text").mapInArrow(made, ROWS)
    # Rows of one doc_id share a hash.
    same = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("buckets", "counts"))
    return chosen.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= each).drop("n")


def trained(docs: DataFrame) -> Model:
    """A model of docs (doc_id, text, lang), trained in one task: on a bounded sample, away from the driver."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            langs, hs, ids = (batch.column(k).to_pylist() for k in range(3))
            lists = [[np.asarray(x.values) for x in batch.column(k)] for k in (3, 4)]
            rows += zip(hs, ids, langs, *lists)
        rows.sort(key=lambda r: (r[0], r[1], r[2], zlib.crc32(r[3]), zlib.crc32(r[4])))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[2:] for r in rows]))], pa.binary())], ["model"])
        rows.clear()
        hand_back()

    found = training_rows(docs).coalesce(1).mapInArrow(made, "model binary").first()
    return pickle.loads(found.model) if found else train([])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs (text, ...), with lang_pred, score and rejected, row by row.

    lang_pred is `und`, with score 0 and rejected, where text is null or has no letters.
    rejected also where the calibrated probability is below the model's threshold. Repeated
    rows get equal results; an empty table gives an empty result; columns that aren't named
    in keep are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*keep, F.col("text").alias("_text"))
    names = [*keep, "lang_pred", "score", "rejected"]
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in chopped(batch):
                langs, score, rejected = model.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names)
        hand_back()

    return chosen.mapInArrow(rows, schema)


def chopped(batch: pa.RecordBatch, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of about size bytes of the last column, of at least one row."""
    lengths = np.array([s if s is not None else 0 for s in pa.compute.binary_length(batch.column(batch.num_columns - 1)).to_pylist()], np.int64)
    owner = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, trained(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
