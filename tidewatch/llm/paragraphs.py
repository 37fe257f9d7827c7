"""Operator 8, substring dedup: paragraphs that share one of their smallest hashes, verified and clustered.

Texts have passages in common that start and end anywhere, so paragraphs are cut where the
words say so: before each word pair whose hash is the smallest of all pairs within RADIUS
words. Equal passages are cut alike, up to RADIUS words from their ends. Paragraphs of equal
sets of five-word shingles are one class; classes that share a band, a single one of each set's
smallest hashes (a prefix filter, not banded signatures), are compared by exact Jaccard similarity and clustered into components. Of each component the first place
(smallest doc_id, then place) stays; where other documents repeat paragraphs in a run of
enough words, those paragraphs are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, Scratch, among, hand_back, strings, table
from .linking import ends, link
from .shingles import BASE, PLACES, SHORT, WORDS, batched, mixed, word_hashes

RADIUS = 5
#: Similarity, in hundredths, from which paragraphs are linked.
PERCENT = 80
#: Words of a run of repeated paragraphs from which they are removed, and of other text in between, which stays.
RUN, GAP = 16, 12


def cut(raws: list[bytes], radius: int = RADIUS) -> tuple[np.ndarray, ...]:
    """Paragraphs of texts: owner (index of the text), first byte, end byte, words, and hashes of their words' shingles.

    Returns owner, first, end, words of each paragraph, then the shingles of all of them, sorted
    and distinct within a paragraph, with offsets.
    """
    lengths = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
    begin = np.cumsum(lengths) - lengths
    start, end, h = word_hashes(b"\n".join(raws).lower())
    n = len(h)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    owner = np.searchsorted(begin, start, side="right") - 1
    pair = np.full(n + 2 * radius, np.iinfo(np.uint64).max, np.uint64)
    pair[radius : radius + n - 1] = mixed(h[:-1] * PLACES[0] + h[1:] * PLACES[1])
    # A pair of words of two texts is none, and what stands beyond a text's bounds doesn't count: cuts depend on the text alone.
    inner = pair[radius : radius + n - 1]
    inner[owner[1:] != owner[:-1]] = np.iinfo(np.uint64).max
    own = pair[radius : radius + n]
    texts = np.full(n + 2 * radius, -1, np.int64)
    texts[radius : radius + n] = owner
    cuts = np.ones(n, bool)
    for d in range(1, radius + 1):
        # Of equal pairs the first one counts as the smallest.
        before, after = slice(radius - d, radius - d + n), slice(radius + d, radius + d + n)
        cuts &= ((own < pair[before]) | (texts[before] != owner)) & ((own <= pair[after]) | (texts[after] != owner))
    cuts[-1] = False
    cuts[:-1] &= owner[1:] == owner[:-1]
    cuts[0] = True
    cuts[1:] |= owner[1:] != owner[:-1]
    first = np.flatnonzero(cuts)
    words = np.diff(np.append(first, n))
    which = np.repeat(np.arange(len(first)), words)
    # Shingles inside of each paragraph; one of fewer words is a shingle itself.
    m = max(0, n - WORDS + 1)
    sums = np.zeros(m, np.uint64)
    for i in range(WORDS):
        sums += h[i : i + m] * PLACES[i]
    inside = np.flatnonzero(which[:m] == which[n - m :]) if m else np.zeros(0, np.int64)
    values, owners = mixed(sums[inside]), which[inside]
    short = np.flatnonzero(words < WORDS)
    if len(short):
        place = np.arange(n) - np.repeat(first, words)
        total = np.add.reduceat(h * PLACES[np.minimum(place, WORDS - 1)], first)[short]
        values = np.concatenate([values, mixed(total + np.uint64(SHORT) * words[short].astype(np.uint64))])
        owners = np.concatenate([owners, short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[keep], owners[keep]
    offsets = np.searchsorted(owners, np.arange(len(first) + 1))
    own = owner[first]
    last = np.append(first[1:], n) - 1
    return own, start[first] - begin[own], end[last] - begin[own], words, values, offsets


def set_ids(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, which is equal where both are: sums of mixes of its members, and its size."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(offsets).astype(np.uint64)
    a = np.add.reduceat(mixed(values * np.uint64(BASE)), offsets[:-1]) + mixed(size)
    b = np.add.reduceat(mixed(values ^ np.uint64(SHORT)), offsets[:-1]) + size
    return mixed(a).view(np.int64), mixed(b).view(np.int64)


def least_keys(values: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hashes of each set, as bands, and their offsets.

    Sets of similarity t share at least ceil(t n) members of either's n. Leaving out so many
    less one of the largest, two such sets have a smallest shared one among what is left of
    both: no pair from percent on is without a band in common. So small a set that one
    element more or less is too much has none, as it's linked with no other set.
    """
    size = np.diff(offsets)
    alone = (100 * (size - 1) < percent * size) & (100 * size < percent * (size + 1))
    kept = np.where(alone, 0, size - -(-percent * size // 100) + 1)
    ends = np.concatenate([[0], np.cumsum(kept)])
    at = np.repeat(offsets[:-1] - ends[:-1], kept) + np.arange(ends[-1])
    return values[at].view(np.int64), ends


SET = ["set_id", "set_check"]
PLACE_COLUMNS = "set_id long, set_check long, doc_id long, place int, start int, end int, words int"
BAND_COLUMNS = "set_id long, set_check long, doc_id long, size int, keys array<long>"
MEMBER_COLUMNS = "set_id long, set_check long, members array<long>"


def paragraphs(docs: DataFrame, columns: str, percent: int = PERCENT) -> DataFrame:
    """All paragraphs of docs (doc_id, text), with one of the sets of columns above.

    set_id and set_check name the set of shingles, members. start and end are bytes of UTF-8,
    place is the number of paragraphs before it in its document. size is that of the set,
    keys are its bands.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for raws in batched(strings(batch.column(1))):
                own, first, end, words, values, offsets = cut(raws)
                if len(own):
                    found = dict(zip(SET, map(pa.array, set_ids(values, offsets))))
                    if "members" in names:
                        found["members"] = lists(values.view(np.int64), offsets)
                    else:
                        found["doc_id"] = pa.array(ids[at : at + len(raws)][own])
                    if "keys" in names:
                        found |= {"size": pa.array(np.diff(offsets).astype(np.int32)), "keys": lists(*least_keys(values, offsets, percent))}
                    elif "place" in names:
                        place = np.arange(len(own)) - np.searchsorted(own, own)
                        found |= {n: pa.array(x.astype(np.int32)) for n, x in (("place", place), ("start", first), ("end", end), ("words", words))}
                    yield pa.RecordBatch.from_arrays([found[n] for n in names], names)
                at += len(raws)
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null").mapInArrow(made, columns)


def repeated_runs(docs: DataFrame, percent: int = PERCENT, run: int = RUN, gap: int = GAP, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, start, end, words, first_doc, component): byte spans of text that an earlier document has.

    Paragraphs count as repeated if their component's first place is in another document.
    Runs join repeated paragraphs with at most gap words between them; runs of fewer than
    run repeated words are left out. Spans hold repeated paragraphs only, never a gap.
    """
    scratch = scratch or Scratch(docs.sparkSession, "paragraphs")
    others = [frame for frame, _ in scratch.kept]
    # Size and keys follow from the set; as grouping columns they need no sort.
    found = paragraphs(docs, BAND_COLUMNS, percent).groupBy(*SET, "size", "keys").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    classes = scratch.keep(found.withColumn("node", F.monotonically_increasing_id()))
    buckets = classes.select(F.explode(F.array_distinct("keys")).alias("key"), "node", "size")
    columns = [*SET, "node", "first_doc", "last_doc"]
    copied = scratch.keep(classes.filter("first_doc < last_doc").select(columns))

    met = sets = None

    def prepare(nodes: DataFrame) -> None:
        nonlocal met, sets
        met = scratch.keep(classes.select(columns).join(nodes, "node"))
        scratch.drop(classes)  # most classes are of one document and meet no other
        found = among(paragraphs(docs, MEMBER_COLUMNS), met.select("set_id").distinct(), "set_id")
        # Texts may have a set many times; members follow from it.
        sets = scratch.keep(found.join(met.select(*SET, "node"), SET).groupBy("node", "members").agg(F.lit(1)).select("node", "members"))

    def compare(pairs: DataFrame) -> DataFrame:
        # Later rounds have few pairs; sets of no pair aren't shuffled.
        nodes = scratch.keep(ends(pairs))
        here = sets.join(F.broadcast(nodes.withColumnRenamed("a", "node")), "node", "left_semi") if nodes.limit(FEW + 1).count() <= FEW else sets
        both = pairs.join(here.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(here.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
        shared = F.size(F.array_intersect("ma", "mb"))
        found = scratch.keep(both.filter(100 * shared >= percent * (F.size("ma") + F.size("mb") - shared)).select("a", "b"))
        scratch.drop(nodes)
        return found

    def own(ids: DataFrame) -> DataFrame:
        """How many shingles of each paragraph no other of them has."""
        each = sets.join(ids, "node", "left_semi").select("node", F.explode("members").alias("shingle"))
        alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
        return ids.join(alone.groupBy("node").agg(F.count("*").alias("own")), "node", "left").fillna(0, ["own"])

    near = link(buckets, compare, own, percent, scratch, prepare)
    # Classes of several documents or linked with others, and the first document of their component.
    many = copied.unionByName(met.filter("first_doc = last_doc")).join(near, "node", "left").filter("first_doc < last_doc or component is not null")
    many = scratch.keep(many.select(*SET, "first_doc", "last_doc", F.coalesce("component", "node").alias("component")))
    scratch.drop_all_but(many, *others)
    firsts = many.groupBy("component").agg(F.min("first_doc").alias("first"), F.max("last_doc").alias("last")).filter("first < last")
    named = scratch.keep(many.join(firsts, "component").select(*SET, "component", F.col("first").alias("first_doc")))
    places = paragraphs(docs, PLACE_COLUMNS)
    # Few sets filter the paragraphs before these are shuffled.
    if named.limit(FEW + 1).count() <= FEW:
        places = places.join(F.broadcast(named.select("set_id").distinct()), "set_id", "left_semi")
    places = places.join(named, SET).filter("doc_id != first_doc").drop(*SET)
    # Runs: a document's repeated paragraphs, in order; blocks: those of a run with nothing else in between.
    order = Window.partitionBy("doc_id").orderBy("place")
    placed = places.withColumn("gap", F.col("start") - F.lag("end").over(order)).withColumn("skip", F.col("place") - F.lag("place").over(order) - 1)
    # A gap is measured in bytes, at 8 for a word and its separator; next places have none.
    new = F.when((F.col("skip") == 0) | (F.col("gap") <= 8 * gap), 0).otherwise(1)
    apart = F.when(F.col("skip") <= 0, 0).otherwise(1)
    blocks = placed.withColumn("run", F.sum(new).over(order)).withColumn("block", F.sum(apart).over(order)).groupBy("doc_id", "run", "block")
    blocks = blocks.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("first_doc").alias("first_doc"), F.min("component").alias("component"))
    # A gap says whether a run is long enough; its own text is no repeat and stays.
    enough = F.sum("words").over(Window.partitionBy("doc_id", "run")) >= run
    return blocks.withColumn("enough", enough).filter("enough").select("doc_id", "start", "end", "words", "first_doc", "component")


#: Repeated or compared sets whose ids are broadcast at most, at 8 bytes each.
FEW = 150_000


def _without(text: Column, spans: Column) -> Column:
    """Text without its byte spans, which are in order; what stood around a span is joined by one line feed or space.

    A function of one value binds it, so that texts aren't copied, and parts not made, once for each span.
    """
    count = F.size(spans)

    def between(raw: Column, k: Column) -> Column:
        first = F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))
        last = F.coalesce(F.get(spans, k)["start"], F.octet_length(raw))
        return F.substring(raw, first + 1, last - first).cast("string")

    def joined(parts: Column) -> Column:
        met = lambda k: (k > 0) & F.substring(F.get(parts, k - 1), -1, 1).isin(" ", "\n", "")
        return F.array_join(F.transform(parts, lambda p, k: F.when(met(k), F.ltrim(p)).otherwise(p)), "")

    parts = F.transform(F.array(text.cast("binary")), lambda raw: F.transform(F.sequence(F.lit(0), count), lambda k: between(raw, k)))
    return F.get(F.transform(parts, joined), F.lit(0))


def substring_dedup(docs: DataFrame, percent: int = PERCENT, run: int = RUN, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs (doc_id, text, ...) with repeated runs removed from text.

    Adds removed_words, spans (bytes of the old text) and first_docs (documents that keep
    what was removed). Rows stay, also those of which no words remain; rows without repeats
    keep their text as it is, as do null and empty texts and null doc_ids. Rows that share a
    doc_id are one document: its repeats within itself stay. An empty table gives an empty
    result. Other columns pass through; those named like the added ones are replaced.
    """
    scratch = scratch or Scratch(docs.sparkSession, "paragraphs")
    others = [frame for frame, _ in scratch.kept]
    runs = repeated_runs(docs, percent, run, scratch=scratch)
    spans = runs.groupBy(F.col("doc_id").alias("_doc")).agg(F.sum("words").alias("_words"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"), F.sort_array(F.collect_set("first_doc")).alias("_firsts"))
    spans = scratch.keep(spans)
    scratch.drop_all_but(spans, *others)
    docs = docs.drop("removed_words", "spans", "first_docs")
    same = F.col("doc_id").cast("long") == F.col("_doc")
    if spans.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        joined = docs.join(spans, same, "left")
    else:  # only texts with spans are shuffled
        ids = F.broadcast(spans.select("_doc"))
        joined = docs.join(ids, same, "left_semi").join(spans, same).unionByName(docs.join(ids, same, "left_anti"), allowMissingColumns=True)
    joined = joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_spans"))))
    return joined.select(*docs.columns, F.coalesce("_words", F.lit(0)).alias("removed_words"), F.col("_spans").alias("spans"), F.col("_firsts").alias("first_docs"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs)
