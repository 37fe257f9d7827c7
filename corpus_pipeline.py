"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.bpe import bpe_digests
from tidewatch.llm.common import Scratch, among, table
from tidewatch.llm.langid import identify, trained
from tidewatch.llm.minhash import near_duplicates
from tidewatch.llm.mixing import mixed_documents
from tidewatch.llm.paragraphs import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates are linked from 0.8 on; of pairs at 0.8, one in 129,000 shares none of 50 bands of 7.
PERCENT, BANDS, ROWS = 80, 50, 7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with enough probability."""
    return identify(docs.select(*COLUMNS), trained(docs), keep=COLUMNS).filter("not rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together.
    """
    scratch = Scratch(spark, "near-dedup")
    gone = scratch.keep(near_duplicates(docs, PERCENT, BANDS, ROWS, scratch).filter("not kept").select("doc_id").distinct())
    scratch.drop_all_but(gone)
    return among(docs.select(*COLUMNS), gone, "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of earlier documents; those of which no word is left go."""
    cut = substring_dedup(docs.select(*COLUMNS))
    words_left = F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    changed = F.col("removed_words") > 0
    cut = cut.filter(~changed | words_left)
    return cut.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not, once or twice."""
    return mixed_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return bpe_digests(docs, most=100_000, forget=True)  # workers of other stages hold memory as well


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", repeats),
    ("mixing", mixing),
    ("BPE", encode),
]

#: Language models, hashes and rounding can't be told in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
