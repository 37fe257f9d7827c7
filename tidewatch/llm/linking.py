"""Components of linked items, from buckets of candidates, without all pairs of a bucket.

`link()` compares each item with its buckets' hubs first and joins what is linked. Buckets
whose items are in one component are done and leave. Of the others, items leave that have
too much of their own to be linked with anything. What stays is compared in rounds: a
bucket's pivots, items outside of its largest component, with the bucket's items of other
components, until every pair that shares a bucket has been compared or is in one component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffles_released

#: Pivots of a bucket in the first round after its hub's, twice as many in each further one; small buckets take as
#: many as make so many pairs.
PIVOTS, PAIRS = 64, 1 << 18
#: Times that items are looked through for those with too much of their own, each of which can leave more.
PEELS = 4


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) can reach.

    Alternates large stars and small stars until all components are stars. Each round
    is a written table, so a lost executor costs one round at most.
    """
    kept = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    rows = kept.count()  # a large or small star has no more edges than there were
    while rows:
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        made = scratch.keep(small, rows)
        scratch.drop(kept)
        kept = made
        ends = kept.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).select("u")
        with shuffles_released(scratch.spark):
            if kept.join(kept.select(F.col("v").alias("u")), "u", "left_semi").limit(1).select("u").unionByName(ends).isEmpty():
                break
    roots = kept.select(F.col("v").alias("node")).distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def ends(pairs: DataFrame) -> DataFrame:
    """(a): the distinct items of pairs (a, b)."""
    return pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()


def hopeless(percent: int) -> Column:
    """Whether a set of size elements, own of them its own, can't be similar to any other of size least or more.

    With m elements shared at most, the similarity to a set of b is at most m / (b + size - m).
    """
    least = F.greatest("least", F.ceil(F.col("size") * percent / 100))
    return 100 * (F.col("size") - F.col("own")) < percent * (least + F.col("own"))


def open_buckets(members: DataFrame) -> DataFrame:
    """members (key, c, size, ...) of buckets of more than one component c, with the least size of each bucket."""
    several = members.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("size").alias("least")).filter("c0 < c1")
    return members.join(several.select("key", "least"), "key")


def link(buckets: DataFrame, compare: Callable[[DataFrame], DataFrame], own: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch, prepare: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(node, component) of all nodes that compare() links with another node of a bucket.

    buckets: (key, node, size), with several rows for a node, which is a set of size elements.
    compare: from distinct pairs (a, b), a < b, to those that are linked, which must not be
    below percent hundredths in similarity. own: from a table of nodes to (node, own), how
    many elements of a node none of the others has. prepare: called once with the nodes of
    buckets of two and more. component is the smallest node that can be reached.
    """
    # Most keys are in one row: they are counted, in few bytes each, before hubs are looked for.
    several = scratch.keep(buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    found = buckets.join(several, "key").distinct()
    hubs = found.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.min_by("size", "node").alias("hub_size")).filter("hub < last")
    members = scratch.keep(found.join(hubs.select("key", "hub", "hub_size"), "key"))
    scratch.drop(several)
    if prepare is not None:
        prepare(scratch.keep(members.select("node").distinct()))

    # The hub that an item meets in most buckets.
    near = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    stars = members.filter("node > hub").filter(near).groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    best = scratch.keep(stars.groupBy("b").agg(F.max_by("a", ranked("n", "a")).alias("a")).select("a", "b"))
    labels = scratch.keep(components(compare(best), scratch).withColumnRenamed("component", "c"))
    here = members.select("key", "node", "size").join(labels, "node", "left").withColumn("c", F.coalesce("c", "node"))
    state = scratch.keep(open_buckets(here))
    scratch.drop(members, best)

    rows = state.count()
    for _ in range(PEELS if rows else 0):
        # An item is linked with items of an open bucket only, or with such as are in its component already.
        nodes = scratch.keep(state.select("node").distinct())
        less = scratch.keep(open_buckets(state.drop("own").join(own(nodes), "node").filter(~hopeless(percent)).drop("least")))
        scratch.drop(state, nodes)
        before, state, rows = rows, less, less.count()
        if rows > 0.8 * before or not rows:
            break
    joined = compared_in_rounds(state, compare, percent, scratch) if rows else None
    if joined is None:
        return labels.withColumnRenamed("c", "component")
    # Labels that are joined, and items that had no label until then.
    over = scratch.keep(components(joined, scratch).withColumnsRenamed({"node": "c", "component": "over"}))
    known = labels.unionByName(over.select(F.col("c").alias("node"), "c")).distinct()
    return known.join(over, "c", "left").select("node", F.coalesce("over", "c").alias("component"))


def ranked(first: str, then: str) -> Column:
    """Orders by first, a count, and by a hash of then among equals."""
    return F.shiftleft(F.col(first).cast("long"), 32) + F.pmod(F.xxhash64(then), F.lit(1 << 32))


def compared_in_rounds(state: DataFrame, compare: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame | None:
    """(a, b): which components of open buckets (key, node, size, own, c) are joined by links; None if there are none."""
    # A pair is compared in the first bucket that its items share. An item is in no more buckets than it has bands.
    keys = state.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    state = scratch.keep(state.select("key", "node", "size", "own", "c").join(keys, "node").withColumn("done", F.lit(False)))
    most = F.least(F.col("size_a") - F.col("own_a"), F.col("size_b") - F.col("own_b"))
    similar = 100 * most >= percent * (F.col("size_a") + F.col("size_b") - most)
    nearest = F.min_by("node", ranked("own", "node"))
    joined, turn = None, 0
    while True:
        if not turn:
            # The item with the least of its own is likely what others are copies of.
            pivots = state.groupBy("key").agg(nearest.alias("node"))
            chosen = state.join(pivots, ["key", "node"], "left_semi")
        else:
            parts = state.groupBy("key", "c").agg(F.count("*").alias("n"))
            parts = parts.groupBy("key").agg(F.max_by("c", ranked("n", "c")).alias("main"), F.sum("n").alias("all"))
            outside = state.filter("not done").join(parts, "key").filter("c != main")
            left = outside.groupBy("key").agg(F.count("*").alias("left"), nearest.alias("pivot"), F.greatest(F.lit(PIVOTS << turn - 1), F.floor(PAIRS / F.first("all"))).alias("take"))
            # Some of a bucket are taken in any case.
            taken = (F.col("node") == F.col("pivot")) | (F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("left") / F.col("take"))) == 0)
            chosen = outside.join(left, "key").filter(taken)
        turn += 1
        chosen = scratch.keep(chosen.select("key", *(F.col(c).alias(f"{c}_a") for c in ("node", "size", "own", "c", "keys"))))
        if chosen.isEmpty():
            return joined
        others = state.select(F.col("key").alias("k"), *(F.col(c).alias(f"{c}_b") for c in ("node", "size", "own", "c", "keys")))
        here = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
        pairs = chosen.join(others, (F.col("key") == F.col("k")) & (F.col("c_a") != F.col("c_b")) & similar & here)
        in_order = F.col("node_a") < F.col("node_b")
        pairs = pairs.select(*(F.when(in_order, F.col(f"{x}_a")).otherwise(F.col(f"{x}_b")).alias(n) for x, n in (("node", "a"), ("c", "ca"))), *(F.when(in_order, F.col(f"{x}_b")).otherwise(F.col(f"{x}_a")).alias(n) for x, n in (("node", "b"), ("c", "cb"))))
        pairs = scratch.keep(pairs.distinct())
        before = state
        state = state.join(chosen.select("key", F.col("node_a").alias("node"), F.lit(True).alias("now")), ["key", "node"], "left").withColumn("done", F.col("done") | F.col("now").isNotNull()).drop("now")
        met = None if pairs.isEmpty() else scratch.keep(compare(pairs.select("a", "b")).join(pairs, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        if met is not None and not met.isEmpty():
            over = components(met, scratch).select(F.col("node").alias("c"), F.col("component").alias("over"))
            state = state.join(over, "c", "left").withColumn("c", F.coalesce("over", "c")).drop("over")
            joined = met if joined is None else joined.unionByName(met)
        state = scratch.keep(open_buckets(state).drop("least"))
        scratch.drop(chosen, pairs, before)
