"""Operator 9, token-ID output: patched frame-of-reference blocks.

Documents are encoded in ascending doc_id order, an end id follows each, and the ids
go into shards of segments. A segment's bytes hold a directory of documents, an index
of block starts, and blocks of 128 ids: the block's minimum is subtracted, the rest is
packed at the width that 9 of 10 values need, and outliers stand in an exception list.
Spark's writers store the segments, so that shards lie in any store and survive lost
executors; spark.read gets them back.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import byte_letters
from .common import Scratch, table
from .langid import chopped

BLOCK = 128
#: Share of a block's values that fit the packed width.
PERCENTILE = 0.9
KTH = int(np.ceil(BLOCK * PERCENTILE)) - 1
#: Ids after which a segment is closed; encoded pieces that a worker keeps, and as many again of those used before.
SEGMENT, CACHE = 1 << 17, 400_000
#: The longest piece that is kept.
LONGEST = 64
#: Bytes of texts that are encoded at once, unless one text is longer.
TEXTS = 1 << 22
#: Latin letters.
LETTER = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
LETTERS = re.compile(LETTER.pattern + "+")
#: Words that go to the library in one text.
TOGETHER = 300
ID = attrgetter("id")
MAGIC, HEAD = b"PFR2", struct.Struct("<4sIQI")
END_ID = 2


def bits(values: np.ndarray) -> np.ndarray:
    """The bits that each value needs, 0 for 0."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width as rows of 16 * width bytes."""
    kind, full = (">u2", 16) if width <= 16 else (">u4", 32)
    spread = np.unpackbits(values.astype(kind).view(np.uint8).reshape(len(values), -1), axis=1)
    return np.packbits(spread.reshape(len(values), BLOCK, full)[:, :, full - width :].reshape(len(values), -1), axis=1)


def unpack(raw: np.ndarray, width: int) -> np.ndarray:
    kind, full = (">u2", 16) if width <= 16 else (">u4", 32)
    spread = np.zeros((len(raw), BLOCK, full), np.uint8)
    spread[:, :, full - width :] = np.unpackbits(raw, axis=1).reshape(len(raw), BLOCK, width)
    return np.packbits(spread.reshape(len(raw), -1), axis=1).view(kind).astype(np.uint32).reshape(len(raw), BLOCK)


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment's bytes: head, documents (ids, lengths, a bit each for a null id), block starts, blocks."""
    n = len(ids)
    count = -(-n // BLOCK)
    filled = np.empty(count * BLOCK, np.uint32)
    filled[:n] = ids
    filled[n:] = ids[-1] if n else 0
    grid = filled.reshape(count, BLOCK)
    low = grid.min(axis=1) if count else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    need = bits(rest)
    width = np.maximum(np.partition(need, KTH, axis=1)[:, KTH], 1) if count else np.zeros(0, np.uint8)
    out = need > width[:, None]
    extra = out.sum(axis=1)
    size = 6 + 16 * width.astype(np.int64) + 5 * extra
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    body = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        packed = pack(np.where(out[at], 0, rest[at]), int(w))
        head = np.empty((len(at), 6), np.uint8)
        head[:, :4] = low[at].astype("<u4").view(np.uint8).reshape(-1, 4)
        head[:, 4], head[:, 5] = w, extra[at]
        block = np.concatenate([head, packed], axis=1)
        body[start[at][:, None] + np.arange(block.shape[1])] = block
    b, where = np.nonzero(out)
    k = np.arange(len(b)) - np.repeat(np.cumsum(extra) - extra, extra)
    at = start[b] + 6 + 16 * width[b].astype(np.int64)
    body[at + k] = where
    body[(at + extra[b] + 4 * k)[:, None] + np.arange(4)] = rest[b, where].astype("<u4").view(np.uint8).reshape(-1, 4)
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), n, count), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), np.packbits([d is None for d in doc_ids]).tobytes(), start.astype("<u8").tobytes(), body.tobytes()])


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids (masked where null), lengths and ids of a segment."""
    magic, n_docs, n, count = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    lengths = np.frombuffer(raw, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    null = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n_docs // 8), at + 16 * n_docs), count=n_docs).astype(bool)
    if null.any():
        doc_ids = np.ma.masked_array(doc_ids, null)
    at += 16 * n_docs + -(-n_docs // 8)
    start = np.frombuffer(raw, "<u8", count + 1, at).astype(np.int64)
    body = np.frombuffer(raw, np.uint8, int(start[-1]), at + 8 * (count + 1))
    ids = np.empty((count, BLOCK), np.uint32)
    if count:
        head = body[start[:-1][:, None] + np.arange(6)]
        low = head[:, :4].copy().view("<u4").ravel()
        for w in np.unique(head[:, 4]):
            at = np.flatnonzero(head[:, 4] == w)
            ids[at] = unpack(body[start[at][:, None] + 6 + np.arange(16 * int(w))], int(w))
        extra = head[:, 5].astype(np.int64)
        b = np.repeat(np.arange(count), extra)
        k = np.arange(len(b)) - np.repeat(np.cumsum(extra) - extra, extra)
        at = start[b] + 6 + 16 * head[b, 4].astype(np.int64)
        ids[b, body[at + k]] = body[(at + extra[b] + 4 * k)[:, None] + np.arange(4)].view("<u4").ravel()
        ids += low[:, None]
    return doc_ids, lengths, ids.ravel()[:n]


def read_block(raw: bytes, number: int) -> np.ndarray:
    """One block's ids, found by the index of block starts; the last block is filled up with its last id."""
    _, n_docs, _, count = HEAD.unpack_from(raw)
    at = HEAD.size + 16 * n_docs + -(-n_docs // 8)
    first, last = np.frombuffer(raw, "<u8", 2, at + 8 * number).astype(np.int64)
    block = raw[at + 8 * (count + 1) + first : at + 8 * (count + 1) + last]
    low, width, k = struct.unpack_from("<IBB", block)
    ids = unpack(np.frombuffer(block, np.uint8, 16 * width, 6)[None, :], width)[0]
    at = 6 + 16 * width
    ids[np.frombuffer(block, np.uint8, k, at)] = np.frombuffer(block, "<u4", k, at + k)
    return ids + np.uint32(low)


class Encoder:
    """The tokenizers library over whole texts, with what it made of each piece kept.

    A byte-level tokenizer always cuts before a space or a line feed that stands between
    two characters that aren't white space. So a text's ids are those of its pieces; texts
    with other white space, or with a special token's string, go to the library whole. Arrow
    cuts texts and tells pieces apart, so that a piece is looked up once for many texts; of
    what isn't known yet, letters go to the library's model without being cut again, the rest
    to the library in texts of many, a line feed before each.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.line = self._ids("\n")
        self.stops = {c: self._ids(c) for c in ".,"}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece after a space, or after the line feed it starts with; None if it could belong with white space around it."""
        if piece in ("", "\n"):
            return None
        line = piece[0] == "\n"
        word = piece[1:] if line else piece
        if word[0].isspace() or "\x1c" <= word[-1] <= "\x1f":
            return None
        return (self.line if line else b"") + self._ids(word if line else " " + word)

    def _pieces(self, pieces: list[str]) -> dict[str, bytes | None]:
        """What _piece() gives for each piece. Letters are one word for the model; other words without white space go to the library in texts of many."""
        made, others = {}, []
        tokenize, space, table, line = self.model.tokenize, self.letters[32], self.letters, self.line
        for p in pieces:
            begun = p[:1] == "\n"
            w = p[1:] if begun else p
            if LETTERS.fullmatch(w):
                if not w.isascii():
                    w = w.encode().decode("latin-1").translate(table)
                ids = array("I", map(ID, tokenize(w if begun else space + w))).tobytes()
                made[p] = line + ids if begun else ids
            elif w.split() == [w]:
                others.append(p)
        for at in range(0, len(others), TOGETHER):
            part = others[at : at + TOGETHER]
            ids = np.frombuffer(self._ids("".join([p if p[0] == "\n" else "\n " + p for p in part])), "<u4")
            starts = np.flatnonzero(ids == np.frombuffer(line, "<u4")[0])
            if len(line) == 4 and len(starts) == len(part):  # else the vocabulary's line feed is no id of its own
                raw, cut = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                made.update((p, raw[a if p[0] == "\n" else a + 4 : b]) for p, a, b in zip(part, cut, cut[1:]))
        return made | {p: self._piece(p) for p in pieces if p not in made}

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, made or taken from either generation of the cache; none for what _piece() can't tell."""
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        cache, old, passing = self.cache, self.old, {}
        found = list(map(cache.get, pieces))
        missing = [i for i, f in enumerate(found) if f is None]
        # A stop or comma after a letter is always cut off, so that many pieces follow from others.
        cores = [p[:-1] if p[-1:] in self.stops and LETTER.match(p[-2:-1]) else p for p in map(pieces.__getitem__, missing)]
        new = []
        for c in dict.fromkeys(cores):
            if c not in cache:
                if (f := old.get(c)) is None:
                    new.append(c)
                else:
                    cache[c] = f
        for c, raw in self._pieces(new).items() if new else ():
            (cache if len(c) <= LONGEST else passing)[c] = raw or b""
        for i, c in zip(missing, cores):
            p, f = pieces[i], cache[c] if c in cache else passing[c]
            found[i] = f + self.stops[p[-1]] if p != c and f else f
        return found

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; none for null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        whole = np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        # Each list begins with an empty string, before the line feed that is put before a text.
        spaced = pc.replace_substring(pc.binary_join_element_wise("\n", pc.fill_null(texts, ""), ""), "\n", " \n")
        lists = pc.split_pattern(spaced, " ")
        bounds, told = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        bounds, which = bounds - bounds[0], told.indices.to_numpy()
        found = self._known(told.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(found), "<u4")
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, count = (np.cumsum(count) - count)[which], count[which]
        unknown = count == 0
        unknown[bounds[:-1]] = False
        whole |= np.logical_or.reduceat(unknown, bounds[:-1])
        ends = np.cumsum(count)
        raw = ids[np.repeat(first - ends + count, count) + np.arange(ends[-1])].tobytes()
        ends = np.concatenate([[0], 4 * ends])[bounds].tolist()
        made = [raw[a + len(self.line) : b] for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(whole | pc.equal(pc.fill_null(texts, ""), "").to_numpy(zero_copy_only=False)).tolist():
            made[i] = self._ids(t) if (t := texts[i].as_py()) else b""
        return made


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SEGMENTS = T.StructType(
    [T.StructField(n, k) for n, k in (("shard", T.IntegerType()), ("shard_start", T.LongType()), ("first_doc", T.LongType()), ("n_ids", T.LongType()), ("segment", T.BinaryType()))]
)


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encodes docs (doc_id, text) and writes shards of segments to the folder out.

    Shards follow each other in doc_id order, as do segments in a shard. shard_start is a
    segment's place in its shard. A null or empty text has the end id only; rows of equal
    doc_id follow each other by text, those of null doc_id stand first. A worker holds one segment and TEXTS bytes of texts, or one longer text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, end, at = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), 0
        made = encoder(path or tokenizer_path())
        doc_ids, parts, held = [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            raw = write_segment(doc_ids, [len(p) // 4 for p in parts], ids)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([at], pa.int64()), pa.array([doc_ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())], SEGMENTS.names)

        for batch in batches:
            for part in chopped(batch, TEXTS):
                for doc_id, raw in zip(part.column(0).to_pylist(), made.encode(part.column(1))):
                    doc_ids.append(doc_id)
                    parts.append(raw + end)
                    held += len(parts[-1]) // 4
                    if held >= SEGMENT:
                        yield segment()
                        at, doc_ids, parts, held = at + held, [], [], 0
        if parts:
            yield segment()

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(rows, SEGMENTS).write.option("compression", "none").parquet(out)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a folder with start: the ids that stand before each in all files."""
    files = spark.read.schema(SEGMENTS).parquet(folder)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.min("first_doc").alias("first"))
    # one row for each shard: as many as the write had tasks
    order = Window.orderBy("first", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    # so the write's task count bounds what is broadcast
    return files.join(F.broadcast(shards), "shard").select((F.col("before") + F.col("shard_start")).alias("start"), "segment")


def document_digests(segments: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the crc32 of its ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, lengths, ids = read_segment(raw.as_py())
                ends = np.cumsum(lengths)
                data = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), scratch.base)
    return document_digests(read_token_files(spark, scratch.base))
