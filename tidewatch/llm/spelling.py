"""Operator 12, spelling variants: words that differ by one code point, by a rare-first q-gram prefix filter.

A word's positional bigrams are put in a global order, rarest first. One edit changes two
bigrams at most, so of two near words' three rarest bigrams at least one is in both, at
places that differ by what the edit shifts. Only these are joined: for words of one length
at the same place, for words whose lengths differ by one at the same place or one further
on. Every pair that meets is verified, by its letters first, then by the edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Words have so many code points and occurrences at least; a form has FACTOR times the word's.
LETTERS, LEAST, FACTOR = 6, 5, 5
#: One run in so many of a document loses a code point.
SLIPS = 199
#: Maximal runs that are long enough; shorter ones can't become words.
LONG = re.compile(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}+")
#: One edit changes at most two bigrams, so three are a prefix.
PREFIX = 3
#: Words of a task of the join, which makes some hundreds of pairs of each: rows alone would ask for fewer tasks.
WORDS_PER_TASK = 5_000
#: Distinct words after which a task sends its counts on.
HELD = 400_000


def slipped(begun: int, run: str) -> str:
    """The run without one code point where the crc32 of `<doc_id>:<run>` says so; begun is that of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), begun)
    if h % SLIPS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) and their occurrences.

    Runs of letters, A to Z in lower case; some lose a code point. Null texts have none. The
    runs of a null doc_id keep all code points. Rows that repeat count each time.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                begun = zlib.crc32(b"%d:" % doc_id) if doc_id is not None else None
                # bytes.lower() changes A to Z alone.
                for run, n in Counter(LONG.findall(text.encode().lower().decode())).items():
                    if begun is not None:
                        run = slipped(begun, run)
                    found[run] = found.get(run, 0) + n
                if len(found) >= HELD:
                    yield flush()
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= LEAST) & (F.char_length("word") >= LETTERS))


def bigrams(words: DataFrame) -> DataFrame:
    """(word, length, mask, gram, place) of each word's positional bigrams; bit c % 63 of mask is set for each of its code points c."""
    mask = "aggregate(split(word, ''), 0L, (m, c) -> m | shiftleft(1L, cast(pmod(ascii(c), 63) AS INT)))"
    sized = words.select("word", F.char_length("word").alias("length"), F.expr(mask).alias("mask"))
    grams = F.transform(F.sequence(F.lit(1), F.col("length") - 1), lambda p: F.struct(F.substring(F.col("word"), p, F.lit(2)).alias("gram"), p.alias("place")))
    return sized.select("*", F.explode(grams).alias("g")).select("word", "length", "mask", "g.*")


def rarest(grams: DataFrame, by: list[str], parts: int) -> DataFrame:
    """(word, length, mask, gram, place, k) of the PREFIX rarest bigrams of each word, k from 0; rare is what few rows share by."""
    often = grams.groupBy(*by).agg(F.count("*").alias("often"))
    placed = grams.join(often, by).repartition(parts, "word").groupBy("word", "length", "mask").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "place"))).alias("all"))
    return placed.select("word", "length", "mask", F.posexplode(F.slice("all", 1, PREFIX)).alias("k", "g")).select("word", "length", "mask", "g.gram", "g.place", "k")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: the words (word) of LETTERS code points and more that one insertion, deletion or replacement turns into each other."""
    grams = scratch.keep(bigrams(words))

    key = ["gram", "place", "length"]
    parts = 1 + words.count() // WORDS_PER_TASK

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.withColumnsRenamed({"word": name, "mask": f"{name}_mask"}).repartition(parts, *key)

    # One code point more or less, or another, changes two bits at most.
    verified = (F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    # A replacement moves nothing: equal bigrams are at equal places, so places count for how frequent they are.
    still = scratch.keep(rarest(grams, key, parts).drop("k"))
    replaced = side(still, "a").join(side(still, "b"), key).filter((F.col("a") < F.col("b")) & verified)
    # A deletion moves what comes after it by one, and makes one new bigram, so two of the shorter word's are enough.
    moved = scratch.keep(rarest(grams, ["gram"], parts))
    longer = moved.select("word", (F.col("length") - 1).alias("length"), "mask", "gram", F.explode(F.array("place", F.col("place") - 1)).alias("place"))
    deleted = side(longer, "a").join(side(moved.filter(F.col("k") < PREFIX - 1), "b"), key).filter(verified)
    return replaced.select("a", "b").unionByName(deleted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def variants(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of words (word, n), a word a row.

    form is the near word of the largest n, of equals the smallest, if that is FACTOR times
    the word's n; else null. root is where forms lead to. An empty table gives an empty one.
    """
    words = scratch.keep(words.select("word", "n"))
    pairs = scratch.keep(near_pairs(words, scratch))
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = links.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    named = words.join(best, words["word"] == best["a"], "left")
    far = -F.col("best.m") >= FACTOR * F.col("n")
    forms = scratch.keep(named.select("word", F.when(far, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("best.m")).alias("form_n")))
    # A form has FACTOR times the occurrences, so no chain has 28 steps, and doubling them five times is enough.
    ups = forms.filter("form is not null").select("word", F.col("form").alias("up"))
    for _ in range(5):
        further = ups.select(F.col("word").alias("up"), F.col("up").alias("over"))
        ups = scratch.keep(ups.join(further, "up", "left").select("word", F.coalesce("over", "up").alias("up")))
    return forms.join(ups, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "spelling")
    return variants(word_counts(table(spark, sf_dir, "documents")), scratch)


#: crc32 of a run's and doc_id's UTF-8 bytes, through the table of its 256 remainders; letters up to U+00FF have two bytes at most.
OP12_SQL = f"""WITH RECURSIVE steps AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, run, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, flatten(list_transform(range(1, 1 + length(doc_id || ':' || run)), lambda i: CASE WHEN unicode(substr(doc_id || ':' || run, i, 1)) < 128 THEN [unicode(substr(doc_id || ':' || run, i, 1))::BIGINT] ELSE [(192 + unicode(substr(doc_id || ':' || run, i, 1)) // 64)::BIGINT, (128 + unicode(substr(doc_id || ':' || run, i, 1)) % 64)::BIGINT] END)) AS b FROM runs WHERE length(run) >= {LETTERS}),
hashed AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[(xor(c % 256, x) + 1)::INT])), 4294967295::BIGINT) AS h FROM bytes, crc),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {LEAST}),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, 1 + length(word))) AS i FROM w)),
near AS (SELECT DISTINCT * FROM (SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word UNION ALL SELECT c.word, w.word FROM cuts c JOIN w ON c.cut = w.word UNION ALL SELECT w.word, c.word FROM cuts c JOIN w ON c.cut = w.word)),
ranked AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM near JOIN w ON b = w.word),
forms AS (SELECT word, CASE WHEN r.n >= {FACTOR} * w.n THEN b END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= {FACTOR} * w.n THEN r.n END AS form_n FROM w LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON a = word),
walk AS (SELECT word, word AS tip FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.tip WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, tip AS root FROM walk JOIN forms f ON f.word = tip WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
