"""Operator 13, ranked lexical search over a bit-sliced impact index.

Documents are dealt into blocks of up to WIDTH, in order of doc_id. In a block, a term has
the places of the documents that hold it and its impacts in slices: slice k has bit k of
each impact, a bit for each of those documents. A search multiplies a term's slices by its
weight (shifted slices are added), spreads them to the block's width, and adds the terms of
an item, all by bitwise sums and carries over whole slices. The documents of the k highest
sums are found from the most significant slice down: those that have its bit stay above
those that don't.

Impacts don't depend on weights, so the index is built in one pass that shuffles no text;
weights come from the blocks' counts when a search asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between terms; splitting at it is several times as fast as counting matches of TERM.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: UTF-8 bytes: A to Z in lower case, those of other ASCII characters that end a term a space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Documents of a block, and bytes of text after which a block ends before.
WIDTH, BYTES_PER_BLOCK = 4096, 1 << 25
#: Impacts are below 10^9 / 1000, so 20 slices hold them.
SLICES = 20
#: Items that a search handles together.
ITEMS = 256
INDEX = "block long, term string, df long, places binary, slices binary, ids array<long>"


def terms(text: Column) -> Column:
    """The matches of TERM in a text, with A to Z in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The document and the term's number of each token, and the distinct terms."""
    import pyarrow.compute as pc

    spaced = pa.array([(t or "").encode().translate(BYTES) for t in texts], pa.large_string())
    parts = pc.ascii_split_whitespace(spaced)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    flat = parts.flatten()
    there = pc.not_equal(flat, "")
    coded = flat.filter(there).dictionary_encode()
    return of[there.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _binary(ends: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)])


def sliced(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of values, counts[t] of them for term t: each term's bytes, slice by slice, and where they end."""
    width = (counts + 7) // 8  # bytes of one slice of each term
    base = np.cumsum(width) - width
    first = np.repeat(np.cumsum(counts) - counts, counts)
    slot = np.repeat(base * 8, counts) + np.arange(len(values)) - first
    total = int(width.sum())
    at, own = np.repeat(base, width), np.repeat(width, width)
    within = np.arange(total) - at
    out, bits = np.zeros(SLICES * total, np.uint8), np.zeros(8 * total, np.uint8)
    for k in range(SLICES):
        bits[slot] = (values >> k) & 1
        out[SLICES * at + k * own + within] = np.packbits(bits, bitorder="little")
    return out, SLICES * np.cumsum(width)


def _block(block: int, ids: list[int | None], texts: list[str | None], documents: int, length: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its ids, and each term with its places and slices."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    of, codes, names = _tokens([texts[i] for i in order])
    if not len(of):
        return
    n = np.bincount(of, minlength=len(ids)).astype(np.int64)
    m = 50 + (50 * n * documents) // length
    pairs, tf = np.unique(codes * WIDTH + of, return_counts=True)
    term, place = pairs // WIDTH, pairs % WIDTH
    impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[place])
    counts = np.bincount(term, minlength=len(names))
    slices, ends = sliced(impacts, counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(names), block), pa.int64()), names.cast(pa.string()), pa.array(counts, pa.int64()), _binary(2 * np.cumsum(counts), place.astype("<u2").tobytes()).cast(pa.binary()),
            _binary(ends, slices.tobytes()).cast(pa.binary()), pa.nulls(len(names), pa.list_(pa.int64())),
        ],
        ["block", "term", "df", "places", "slices", "ids"],
    )
    yield pa.RecordBatch.from_pylist([{"block": block, "term": None, "df": None, "places": None, "slices": None, "ids": [ids[i] for i in order]}], pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("places", pa.binary()), ("slices", pa.binary()), ("ids", pa.list_(pa.int64()))]))


@dataclass
class ImpactIndex:
    """rows: the blocks' terms, and a row of null term with the doc_ids of each block; documents: how many hold a term."""

    rows: DataFrame
    documents: int


def build_index(docs: DataFrame, scratch: Scratch) -> ImpactIndex:
    """The index of docs (doc_id, text), a written table.

    Null texts and texts without a term are in no block. Rows that repeat are documents of
    their own; a null doc_id is kept and comes after the others. Other columns aren't looked
    at. An empty table gives an index without blocks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = F.size(F.array_remove(F.split("text", BETWEEN), "")).cast("long").alias("n")
    documents, length = docs.select(count).filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                if len(ids) == WIDTH or size + len(t) > BYTES_PER_BLOCK and ids:
                    yield from _block(block, ids, texts, documents, length)
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield from _block(block, ids, texts, documents, length)

    return ImpactIndex(scratch.keep(docs.mapInArrow(blocks, INDEX)), documents)


def add(total: list[int], slices: list[int], shift: int = 0) -> None:
    """Adds the numbers of slices, times 2^shift, to those of total, slice by slice with carries."""
    carry = 0
    for k, s in enumerate(slices, shift):
        if k >= len(total):
            total.extend([0] * (k + 1 - len(total)))
        t = total[k]
        half = t ^ s
        total[k] = half ^ carry
        carry = (t & s) | (half & carry)
    k = len(slices) + shift
    while carry:
        if k >= len(total):
            total.append(0)
        total[k], carry = total[k] ^ carry, total[k] & carry
        k += 1


def times(slices: list[int], weight: int) -> list[int]:
    """The slices of weight times the numbers of slices."""
    total: list[int] = []
    for shift in range(weight.bit_length()):
        if weight >> shift & 1:
            add(total, slices, shift)
    return total


def spread(slices: list[int], places: np.ndarray, width: int) -> list[int]:
    """Slices of the documents at places as slices of a whole block of width, a multiple of 8."""
    size = (len(places) + 7) // 8
    bits = np.unpackbits(np.frombuffer(b"".join(s.to_bytes(size, "little") for s in slices), np.uint8).reshape(len(slices), size), axis=1, count=len(places), bitorder="little")
    wide = np.zeros((len(slices), width), np.uint8)
    wide[:, places] = bits
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(wide, axis=1, bitorder="little")]


def ones(bits: int, width: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(width // 8, "little"), np.uint8), bitorder="little"))


def highest(total: list[int], k: int, width: int) -> np.ndarray:
    """The places of the k highest numbers above 0, of equal ones those that come first."""
    sure, open_ = 0, 0
    for s in total:
        open_ |= s
    for s in reversed(total):
        with_bit = open_ & s
        if (sure | with_bit).bit_count() > k:
            open_ = with_bit
        else:
            sure |= with_bit
            open_ ^= with_bit
    return np.concatenate([ones(sure, width), ones(open_, width)[: k - sure.bit_count()]])


def numbers(total: list[int], places: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(s.to_bytes(width // 8, "little") for s in total), np.uint8).reshape(len(total), -1), axis=1, bitorder="little")
    return (bits[:, places].astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)


def _ranked(k: int):
    def found(pdf):
        import pandas as pd

        heads = pdf["ids"].notna()
        ids = list(pdf.loc[heads, "ids"].iloc[0])
        width = 8 * ((len(ids) + 7) // 8)
        sums: dict[int, list[int]] = {}
        for weight, places, slices, items in pdf.loc[~heads, ["weight", "places", "slices", "items"]].itertuples(index=False):
            places = np.frombuffer(places, "<u2")
            size = (len(places) + 7) // 8
            own = [int.from_bytes(slices[i : i + size], "little") for i in range(0, SLICES * size, size)]
            product = times(own, int(weight))
            if not product:
                continue
            wide = spread(product, places, width)
            for item in items:
                add(sums.setdefault(int(item), []), wide)
        out = []
        for item, total in sums.items():
            places = highest(total, k, width)
            out += [(item, None if ids[p] is None or ids[p] != ids[p] else int(ids[p]), int(s)) for p, s in zip(places, numbers(total, places, width))]
        return pd.DataFrame(out, columns=["item_id", "doc_id", "score"]).astype({"item_id": "int64", "doc_id": "Int64", "score": "int64"})

    return found


def search(index: ImpactIndex, items: DataFrame, k: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k highest documents; equal scores by doc_id, null last.

    items: (item_id, text), other columns aren't looked at. Rows that repeat an item_id are
    one item of all their terms; items of null item_id, and without a known term, have no
    rows. A score sums weight times impact over an item's terms, once each.
    """
    scratch = scratch or Scratch(items.sparkSession, "impacts")
    asked = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term")).distinct()
    batches = 1 + asked.select("item_id").distinct().count() // ITEMS
    asked = scratch.keep(asked.groupBy("term", F.pmod(F.xxhash64("item_id"), F.lit(batches)).alias("batch")).agg(F.collect_list("item_id").alias("items")))
    known = index.rows.filter("term is not null").select("term", "df").join(small(scratch.keep(asked.select("term").distinct())), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2.0) / (2 * F.col("df") + 1).cast("double")))
    asked = scratch.keep(asked.join(known.select("term", weight.alias("weight")), "term"))
    here = index.rows.filter("term is not null").join(small(asked), "term").select("block", "batch", "weight", "places", "slices", "items", F.lit(None).cast("array<long>").alias("ids"))
    # Each group of a block and a batch of items gets the block's doc_ids.
    heads = index.rows.filter("term is null").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("slices"), F.lit(None).cast("array<long>").alias("items"), "ids")
    best = here.unionByName(heads).groupBy("block", "batch").applyInPandas(_ranked(k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "impacts")
    return search(build_index(table(spark, sf_dir, "documents"), scratch), table(spark, sf_dir, "benchmark"), 50, scratch)


#: What stands between terms; splitting at it is several times as fast as counting matches of TERM.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13_SQL = f"""WITH tok AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}') AS ws FROM documents),
docs AS (SELECT r, doc_id, ws, len(ws) AS n FROM tok WHERE len(ws) > 0),
whole AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, nn),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
sums AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (r), whole GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM sums WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50"""
