"""Operator 5, URL filters: a character language-model ratio behind allow and block rules.

URLs that a rule decides are the labelled examples. Two smoothed Markov models of variable
order, of accepted and of rejected URLs, score each URL; the verdict on those without a rule
is the calibrated, length-normalised difference of log-likelihoods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Verdict, host and path of each rule.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Characters with symbols of their own; all others share one, and one stands before the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&#:%+~,;@!*'()$[]|"
SYMBOLS = 64
OTHER, START = 62, 63
#: Characters of the longest context.
ORDER = 4
#: Contexts of so many characters have tables bounded by the alphabet, 64 ** 3 rows, which are broadcast.
SMALL = 2
#: A gram is hot, and so broadcast, from one in so many of all rows (URL, gram) on: there are fewer hot grams than that.
HOT = 10_000
#: Log-ratios are summed as whole multiples of one in so many, so that the order of rows doesn't matter.
UNIT = 1 << 32
#: Weight of the shorter context's estimate, in observations.
WEIGHT = 4.0
BINS = 2000

CODES = np.full(256, OTHER, np.int64)
for _k, _c in enumerate(ALPHABET):
    CODES[ord(_c)] = CODES[ord(_c.upper())] = _k


def parts(url: str = "url") -> tuple:
    """Columns host and path of a URL column; both empty for null or without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict; the longest rule that fits wins, null if none does."""
    host, path = parts()
    urls = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one that fits stays
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each character of URLs: the number of its gram, and the URL's number.

    A gram is the ORDER characters before, the nearest one as the highest digit, then the
    character itself. So the context of k characters is a gram's first k digits.
    """
    raws = [u.encode("utf-8", "surrogatepass") for u in urls]
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    data = CODES[np.frombuffer(b"".join(raws), np.uint8)]
    owner = np.repeat(np.arange(len(raws)), lengths)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = np.zeros(len(data), np.int64)
    for k in range(1, ORDER + 1):
        before = np.full(len(data), START, np.int64)
        before[k:] = np.where(place[k:] >= k, data[:-k], START)
        value = value * SYMBOLS + before
    return value * SYMBOLS + data, owner


def counted(urls: DataFrame) -> DataFrame:
    """(id, gram, n) of rows (id, url): how often each gram is in the rows of an id, summed within batches."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                gram, owner = grams([u or "" for u in part.column(1).to_pylist()])
                ids = part.column(0).to_numpy()[owner]
                order = np.lexsort((gram, ids))
                gram, ids = gram[order], ids[order]
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (ids[1:] != ids[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(gram[at]), pa.array(np.diff(np.append(at, len(gram))))], ["id", "gram", "n"])

    return urls.mapInArrow(made, "id long, gram long, n long")


def ratios(labelled: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, df, r) of wanted (gram, df): log of the accepted over the rejected model's probability, in UNITs.

    Both models come from all rows of labelled (url, rule_verdict). Each order's estimate is
    weighed with the shorter context's; counts of all contexts stay in tables.
    """
    kinds = labelled.select((F.col("rule_verdict") == "block").cast("long").alias("id"), "url")
    counts = counted(kinds).groupBy("gram").agg(*(F.sum(F.when(F.col("id") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    counts = scratch.keep(counts)
    out = wanted.withColumns({f"p{k}": F.lit(1.0 / SYMBOLS) for k in (0, 1)})
    symbol = F.col("gram") % SYMBOLS
    for order in range(ORDER + 1):
        context = F.shiftright("gram", 6 * (ORDER + 1 - order))
        cells = counts.groupBy(context.alias("context"), symbol.alias("symbol")).agg(*(F.sum(f"n{k}").alias(f"c{k}") for k in (0, 1)))
        sums = counts.groupBy(context.alias("context")).agg(*(F.sum(f"n{k}").alias(f"s{k}") for k in (0, 1)))
        if order <= SMALL:
            cells, sums = F.broadcast(cells), F.broadcast(sums)
        out = out.withColumns({"context": context, "symbol": symbol}).join(sums, "context", "left").join(cells, ["context", "symbol"], "left").fillna(0, ["c0", "c1", "s0", "s1"])
        out = out.select("gram", "df", *(((F.col(f"c{k}") + WEIGHT * F.col(f"p{k}")) / (F.col(f"s{k}") + WEIGHT)).alias(f"p{k}") for k in (0, 1)))
    return out.select("gram", "df", F.round((F.log("p0") - F.log("p1")) * UNIT).cast("long").alias("r"))


def scored(urls: DataFrame, labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds score to urls (url, ...): the mean log-likelihood ratio per character, above 0 where accepted ones are likelier; 0 for no text."""
    distinct = scratch.keep(urls.select("url").filter("url != ''").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = scratch.keep(counted(distinct.select("id", "url")))
    known = scratch.keep(ratios(labelled, found.groupBy("gram").agg(F.count("*").alias("df")), scratch))
    # Grams of very many URLs would each land in one task.
    often = 1 + found.count() // HOT
    hot = known.filter(F.col("df") > often).select("gram", "r")
    rare = found.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(known.filter(F.col("df") <= often).select("gram", "r"), "gram")
    both = found.join(F.broadcast(hot), "gram").select("id", "n", "r").unionByName(rare.select("id", "n", "r"))
    means = both.groupBy("id").agg((F.sum(F.col("n") * F.col("r")) / F.sum("n") / UNIT).alias("score"))
    return urls.join(distinct.join(means, "id").select("url", "score"), "url", "left").fillna(0.0, ["score"])


def threshold(held: DataFrame) -> float:
    """From scored examples (rule_verdict, score): where as large a share of accepted as of rejected ones lies on the wrong side.

    The driver gets 2 * 2,001 sums; without examples of both kinds it is 0.
    """
    step = F.greatest(F.lit(-BINS // 2), F.least(F.lit(BINS // 2), F.floor(F.col("score") * 100)))
    sums = {(r[0], r[1]): r[2] for r in held.groupBy("rule_verdict", step.alias("bin")).count().collect()}
    bins = np.arange(-BINS // 2, BINS // 2 + 1)
    allow, block = (np.array([sums.get((k, int(b)), 0) for b in bins], float) for k in ("allow", "block"))
    if not (allow.sum() and block.sum()):
        return 0.0
    lost = np.concatenate([[0], np.cumsum(allow)]) / allow.sum()
    let = 1 - np.concatenate([[0], np.cumsum(block)]) / block.sum()
    # Of equally good thresholds the middle one.
    worse = np.maximum(lost, let)
    best = np.flatnonzero(worse <= worse.min() + 1e-12)
    return float((bins[0] + (best[0] + best[-1]) / 2) / 100)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score for each row of pages (page_id, url).

    verdict is the rule's, where one fits, else allow where the score reaches the calibrated
    threshold and block below it. A null or empty url, or one without `://`, has empty host
    and path and no rule; its score is that of its text, 0 for none. Repeated rows get equal
    results; an empty table gives an empty result; other columns are not looked at.
    """
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    named = ruled(pages.select("page_id", "url"), rules)
    # Every fifth example, by a hash, isn't learned from and sets the threshold.
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    judged = scratch.keep(scored(named, named.filter(F.col("rule").isNotNull() & ~held), scratch))
    limit = threshold(judged.filter(F.col("rule").isNotNull() & held))
    own = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
