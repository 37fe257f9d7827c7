"""Operator 7, BPE encoding and decoding with a vocabulary of word ends.

Words are merged with a priority queue of merge ranks over a doubly linked symbol
list; entries whose symbols have changed since are stale and skipped. Decoding joins
the vocabulary's strings. The vocabulary file is a parameter; nothing is trained.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import hand_back, table

#: White space of the Unicode standard, which the vocabulary's pattern \s means.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = regex.compile(f"[^{SPACE}]+")
#: Characters at which str.split() also cuts, though they are no white space.
ODD = regex.compile("[\x1c-\x1f]")
#: The first combining mark. Characters below are letters or not in all versions of Unicode, and in normal form.
MARKS = "\u0300"
#: Chunks, and as many words, that one worker keeps encoded at most, and the longest of them in characters.
CACHE, LONGEST = 400_000, 64


def byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: printable ones are themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizer file of JSON."""

    def __init__(self, path: str, most: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", SPACE), regex.V0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.special_mark = "<|"
        assert all(t.startswith(self.special_mark) for t in self.special)
        self.strings = [""] * (max(*vocab.values(), *self.special.values()) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.library = Tokenizer.from_file(path)
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + end] for b in range(256)]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.whole = lru_cache(most)(self._merged)
        self.most = most
        self.cache: dict[str, bytes] = {}

    def _merged(self, word: bytes) -> tuple[int, ...]:
        """Symbols of a word after all merges, lowest rank first, leftmost first among equals."""
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if found := ranks.get(symbols[i] << 32 | symbols[i + 1]):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # stale: one of the two has been merged with another since
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get(made << 32 | symbols[k]):
                    heapq.heappush(queue, (found[0], i, made, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := ranks.get(symbols[h] << 32 | made)):
                heapq.heappush(queue, (found[0], h, symbols[h], made, found[1]))
        return tuple(s for s in symbols if s >= 0)

    def _chunk(self, chunk: str) -> bytes:
        """Ids, as unsigned 32-bit integers, of a run without white space."""
        if max(chunk) < MARKS:
            words = [w.encode() for w in self.words.findall(chunk.lower())]
        else:
            # Which characters are letters, and how marks are put in order, follows the library's version of Unicode.
            letters, byte_of = self.library.normalizer.normalize_str(chunk), self.byte_of
            words = [bytes([byte_of[c] for c in w]) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(letters)]
        merged = self.whole if len(chunk) <= LONGEST else self._merged
        ids = [i for w in words for i in merged(w)]
        return np.array(ids, "<u4").tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; none for null or no text."""
        if not text:
            return b""
        if self.special_mark in text:
            parts = self.special_pattern.split(text)
            if len(parts) > 1:
                return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        chunks = CHUNKS.findall(text) if ODD.search(text) else text.split()
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, chunks))
        except KeyError:
            if len(cache) > self.most:
                cache.clear()
            new = {c: self._chunk(c) for c in set(chunks).difference(cache)}
            cache.update(new)
            made = b"".join(map(cache.__getitem__, chunks))
            for c in new:
                if len(c) > LONGEST:
                    del cache[c]
            return made

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, joined as a tokenizer file without a decoder joins them: by a space."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])

    def forget(self) -> None:
        """Frees encoded words, and hands freed memory back to the system where its allocator can."""
        self.cache.clear()
        self.whole.cache_clear()
        hand_back()


@lru_cache(2)
def word_bpe(path: str, most: int = CACHE) -> WordBpe:
    """One vocabulary for all tasks of a worker."""
    return WordBpe(path, most)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Adds to doc_id and text: ids (array of int), n_tokens and decoded.

    Null and empty texts have no ids and decode to ''. Rows with a null doc_id and repeated
    rows stay; an empty table gives an empty result; other columns are left out. path names the vocabulary file,
    which must exist on every executor; by default the public one of word ends.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path or tokenizer_path())
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                decoded = [bpe.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(decoded, pa.string())],
                    ["doc_id", "text", "ids", "n_tokens", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, text string, ids array<int>, n_tokens long, decoded string")


def bpe_digests(docs: DataFrame, path: str | None = None, most: int = CACHE, forget: bool = False) -> DataFrame:
    """Digests of the ids and of the text decoded from them, one row per document.

    The long forms of bpe_round_trip() stay in the worker. Null and empty texts have 0
    tokens and the digests of no bytes; rows with a null doc_id and repeated rows stay; an
    empty table gives an empty result; other columns are left out. One pass, no shuffle; a worker holds 256 texts and at most most encoded words.
    forget: whether a task's end frees these words, for executors whose workers have other work as well.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path or tokenizer_path(), most)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                counts, ids_sha, decoded_sha = [], [], []
                for text in part.column(1).to_pylist():
                    raw = bpe.encode_bytes(text)
                    ids = np.frombuffer(raw, "<u4").tolist()
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    decoded_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if forget:
            bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
