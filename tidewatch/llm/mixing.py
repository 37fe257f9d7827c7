"""Operator 3, mixing sources to target weights: entropy balancing in DataFrame operations.

Rates of documents lie between 0 and 2 and are as close in entropy to 1 as they can be
while each source's expected words equal its target. The dual of this problem is convex
and has one multiplier for each source; Newton steps, each an aggregation over the
corpus's histogram of sizes, solve it. A document's rate is exponentially tilted by its
size: 2 / (1 + exp(-multiplier * size)). Rates are rounded into 0, 1 or 2 copies by a
fixed hash of the document, shifted so that each source's sum meets its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small, table, word_count

#: Weights of sources in order, repeating; words of the mix by words of the corpus; most copies.
WEIGHTS, SHARE, COPIES = (3.0, 1.0, 2.0), 1.5, 2.0
#: Newton steps at most, of which the bracket's halvings alone are enough; each source's words then miss its target by this share at most.
STEPS, EXACT = 120, 1e-9
#: Steps of the shift that rounding is calibrated on.
BINS = 1 << 14


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = COPIES) -> DataFrame:
    """Adds target to (source, source_size), one row for each source.

    Sources by code point, null last, have weights in turn and share share * all sizes by
    them; none gets more than most * its size, and what is over goes to the others by
    weight. In closed form: with sources by size/weight, the level of words per unit of
    weight is that of the first at which all sources further on stay below their limits.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    place = (F.row_number().over(ordered) - 1) % len(weights)
    limited = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))).withColumn("limit", most * F.col("source_size"))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    goal = F.lit(share) * F.sum("source_size").over(every)
    given = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (goal - given) / left
    limited = limited.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    level = F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(every)["level"]
    return limited.withColumn("chosen", level).select("source", "source_size", F.least("limit", F.coalesce(F.col("chosen") * F.col("weight"), F.col("limit"))).alias("target"))


def dual_multipliers(histogram: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, multiplier) so that each source's expected words are its target.

    histogram: (source, size, n), the corpus by source and size. Solves for each source
    sum of n * size * rate = target by Newton steps, kept inside the bracket that earlier
    steps have found. Sizes are measured in the source's mean size. Sources at their limit
    have no finite multiplier; theirs is null, which means the limit itself. A source that
    no step brings to its target is an error.
    """
    histogram = histogram.withColumnRenamed("source", "h")
    state = targets.select("source", "target", "source_size", "mean", F.lit(0.0).alias("multiplier"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"))
    state = scratch.keep(state.filter("target < source_size * 2 and source_size > 0"))
    for _ in range(STEPS):
        rows = histogram.join(small(state), F.col("h").eqNullSafe(F.col("source")) & ~F.col("done"))
        x = F.col("size") / F.col("mean")
        rate = tilted(F.col("multiplier"), x)
        sums = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("words"), F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / 2)).alias("slope")).withColumnRenamed("source", "s")
        joined = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        miss = F.col("words") - F.col("target")
        low = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        far = F.greatest(F.abs("multiplier"), F.lit(1.0))
        middle = F.when(high >= 1e6, F.col("multiplier") + far).when(low <= -1e6, F.col("multiplier") - far).otherwise((low + high) / 2)
        ended = F.col("done") | F.col("words").isNull() | (F.abs(miss) <= EXACT * F.greatest("target", F.lit(1.0)))
        state = scratch.keep(
            joined.select(
                "source", "target", "source_size", "mean", F.when(ended, F.col("multiplier")).when(inside, newton).otherwise(middle).alias("multiplier"),
                F.when(ended, F.col("low")).otherwise(low).alias("low"), F.when(ended, F.col("high")).otherwise(high).alias("high"), ended.alias("done"),
            )
        )
        if state.filter(~F.col("done")).isEmpty():
            return state.select("source", "multiplier")
    raise ArithmeticError(f"no multiplier after {STEPS} steps")


def tilted(multiplier: Column, x: Column, most: float = COPIES) -> Column:
    return F.lit(most) / (1 + F.exp(F.least(F.lit(700.0), -multiplier * x)))


class Mix:
    """What decides on copies: a table of sources, and one of single documents that get one more copy.

    sized: a written table (doc_id, source, size) of all documents. Copies of a document follow
    from doc_id, source and size alone.
    """

    def __init__(self, sized: DataFrame, weights: tuple[float, ...], share: float, scratch: Scratch):
        histogram = scratch.keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
        totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
        targets = source_targets(totals.select("source", "source_size"), weights, share)
        means = totals.select(F.col("source").alias("s"), (F.col("source_size") / F.col("rows")).alias("mean"))
        targets = scratch.keep(targets.join(means, targets["source"].eqNullSafe(means["s"])).drop("s"))
        multipliers = dual_multipliers(histogram, targets, scratch).withColumnRenamed("source", "s")
        plan = scratch.keep(targets.join(multipliers, targets["source"].eqNullSafe(multipliers["s"]), "left").drop("s").withColumnRenamed("source", "s"))
        shift = self.shifts(self.rated(sized, plan)).withColumnRenamed("s", "shifted")
        self.plan = scratch.keep(plan.join(shift, plan["s"].eqNullSafe(shift["shifted"]), "left").drop("shifted"))
        self.more = scratch.keep(self.spares(self.rounded(sized)))

    @staticmethod
    def rated(rows: DataFrame, plan: DataFrame) -> DataFrame:
        """Adds the plan of a row's source, its rate, and level: rate and a hash of the row as a fraction."""
        rate = F.when(F.col("multiplier").isNull(), F.lit(COPIES)).otherwise(tilted(F.col("multiplier"), F.col("size") / F.col("mean")))
        fraction = F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 40)) / float(1 << 40)
        return rows.join(small(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate).withColumn("level", F.col("rate") + fraction)

    @staticmethod
    def shifts(rated: DataFrame) -> DataFrame:
        """(s, at, room): the step of each source's shift, and the words that then are left of its target.

        Level and shift, rounded down, are the copies.
        """
        # Words that each step of the shift in (-1, 1) adds: from 0 copies at -level to 2 copies.
        steps = F.explode(F.array(F.lit(1), F.lit(2)))
        turns = rated.filter("size > 0 and target < 2 * source_size").select("source", "size", "level", "target", steps.alias("copy"))
        turns = turns.withColumn("at", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.ceil((F.col("copy") - F.col("level")) * BINS)))).groupBy("source", "at").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
        # At most 2 * BINS + 1 rows of a source meet here.
        risen = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        turns = turns.withColumn("sum", F.sum("words").over(risen))
        shift = turns.filter("sum <= target").groupBy("source").agg(F.max("at").alias("at"), (F.first("target") - F.max("sum")).alias("room"))
        every = turns.groupBy("source").agg((F.min("at") - 1).alias("least"), F.first("target").alias("goal")).withColumnRenamed("source", "s")
        return every.join(shift, every["s"].eqNullSafe(shift["source"]), "left").select("s", F.coalesce("at", "least").alias("at"), F.coalesce("room", "goal").alias("room"))

    def rounded(self, rows: DataFrame) -> DataFrame:
        """Adds copies by the sources' shifts to rows (doc_id, source, size, ...), and what rated() adds."""
        rated = self.rated(rows, self.plan)
        turned = sum((F.when(F.ceil((c - F.col("level")) * BINS) <= F.col("at"), 1).otherwise(0) for c in (1, 2)), F.lit(0))
        return rated.withColumn("copies", F.when(F.col("at").isNull(), F.least(F.floor("level"), F.lit(2))).otherwise(turned).cast("long"))

    @staticmethod
    def spares(rounded: DataFrame) -> DataFrame:
        """(s, more_size, more_id) of documents that get one more copy, as far as a source has room, and one beyond that if it's nearer.

        All rows of a doc_id and size get it, so together they must fit. At most one document
        of each size does, the one of the fewest rows; large ones come first.
        """
        rows = rounded.filter("copies < 2 and size > 0 and room > 0 and size < 2 * room and doc_id is not null").groupBy("source", "size", "doc_id").agg(F.count("*").alias("rows"), F.first("room").alias("room"))
        spare = rows.groupBy("source", "size").agg(F.min_by(F.struct("doc_id", "rows"), F.struct("rows", F.xxhash64("doc_id", F.lit(3)), "doc_id")).alias("x"), F.first("room").alias("room"))
        spare = spare.select("source", F.struct((F.col("size") * F.col("x.rows")).alias("words"), "size", F.col("x.doc_id").alias("doc_id")).alias("x"), "room")
        listed = spare.groupBy("source").agg(F.sort_array(F.collect_list("x"), asc=False).alias("spare"), F.first("room").alias("room"))
        kind = "array<struct<words:bigint,size:bigint,doc_id:bigint>>"
        start = F.struct(F.col("room").cast("double").alias("room"), F.array().cast(kind).alias("more"), F.array().cast(kind).alias("over"))

        def fill(acc: Column, x: Column) -> Column:
            fits = x["words"] <= acc["room"]
            # What doesn't fit comes by words, so the last one is the smallest.
            return F.struct(F.when(fits, acc["room"] - x["words"]).otherwise(acc["room"]).alias("room"), F.when(fits, F.array_append(acc["more"], x)).otherwise(acc["more"]).alias("more"), F.when(fits, acc["over"]).otherwise(F.array(x)).alias("over"))

        filled = F.aggregate("spare", start, fill, lambda acc: F.concat(acc["more"], F.filter(acc["over"], lambda x: x["words"] < 2 * acc["room"])))
        return listed.select("source", F.explode(filled).alias("x")).select(F.col("source").alias("s"), F.col("x.size").alias("more_size"), F.col("x.doc_id").alias("more_id"))

    def applied(self, rows: DataFrame) -> DataFrame:
        """Adds copies, rate, source_size and target to rows (doc_id, source, size, ...)."""
        placed = self.rounded(rows)
        same = (F.col("doc_id") == F.col("more_id")) & (F.col("size") == F.col("more_size")) & F.col("source").eqNullSafe(F.col("s"))
        placed = placed.join(small(self.more).withColumn("more", F.lit(1)), same, "left")
        return placed.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken for each row of docs.

    docs: (doc_id, text, source). size is the words of the text, 0 for null; copies is 0, 1
    or 2 and taken copies * size. Equal input gives equal output: rounding depends on doc_id and
    size only, and rows of a source that agree in both are rounded alike. After rounding by
    the hash, a document of each size can be moved up by one copy; each source's taken words
    miss its target by half of the smallest such document's words (of all its equal rows) at
    most, unless room for more documents of one size is left. Null sources are
    one source, after all others. Documents without words have copies by the same rule and
    take 0 words. An empty table gives an empty result; other columns are not looked at.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(sized(docs))
    mixed = Mix(rows, weights, share, scratch).applied(rows)
    return mixed.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...), each as often as mix_sources() takes it: not, once or twice.

    Texts aren't shuffled: copies follow from small tables and the row itself. Other columns
    pass through; columns named like those of the plan are kept apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    mix = Mix(scratch.keep(sized(docs)), weights, share, scratch)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    taken = mix.applied(rows).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
