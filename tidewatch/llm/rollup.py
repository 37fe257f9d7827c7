"""Operator 2, token counts: delta-maintained rollups with idempotent batch commits.

A rollup is a folder of batches. A batch holds signed sums of documents and tokens by
source, language and tokenizer version: inserts add, deletes subtract, revised counts do
both. Totals are the sums over committed batches, so no document is counted again. A batch
counts once Spark's committer has marked it as whole; a batch id that is there already is
skipped, and one that a lost job left unmarked is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, word_count

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, documents long, tokens long"
#: Words and single characters that are neither letters, digits nor separators.
PIECE = r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"


class TokenRollup:
    """Totals of documents and tokens in a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _whole(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}/_SUCCESS"))

    def _names(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isDirectory())

    def _live(self) -> list[str]:
        """Folders that totals are read from: the latest whole base and the whole batches it doesn't hold."""
        names = [n for n in self._names() if self._whole(n)]
        bases = [n for n in names if n.startswith("base=")]
        held = self._held(bases[-1]) if bases else set()
        return bases[-1:] + [n for n in names if n.startswith("batch=") and n not in held]

    def _held(self, base: str) -> set[str]:
        return {r.held for r in self.spark.read.schema("held string").parquet(f"{self.folder}/{base}").filter("held is not null").collect()}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds changes (source, lang, version, tokens, sign) under batch_id; False if that is there already.

        sign is 1 for an insert and -1 for a delete; a revised count is a delete of the old
        one and an insert of the new. Rows without sign or tokens add nothing; null keys are
        groups of their own; other columns are not looked at.
        """
        name = f"batch={batch_id}"
        if self._whole(name) or any(name in self._held(b) for b in self._names() if b.startswith("base=") and self._whole(b)):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        sums.fillna(0, ["documents", "tokens"]).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens; groups that sum to nothing are left out."""
        live = [f"{self.folder}/{n}" for n in self._live()]
        if not live:
            return self.spark.createDataFrame([], SCHEMA)
        sums = self.spark.read.schema(SCHEMA).parquet(*live).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents != 0 or tokens != 0")

    def compact(self) -> None:
        """Sums all whole batches into a new base; older folders may then be removed."""
        live = self._live()
        held = {n for n in live if n.startswith("batch=")} | {x for n in live if n.startswith("base=") for x in self._held(n)}
        count = 1 + max([0, *(int(n.split("=")[1]) for n in self._names() if n.startswith("base="))])
        # A row for each held batch stands beside the sums, so that one write makes the base whole.
        names = self.spark.createDataFrame([(n,) for n in sorted(held)], "held string").select(*(F.lit(None).cast("string").alias(k) for k in KEYS), F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("tokens"), "held")
        self.totals().withColumn("held", F.lit(None).cast("string")).unionByName(names).write.mode("overwrite").parquet(f"{self.folder}/base={count:09d}")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang and the counts of two tokenizer versions, words-1 and pieces-2; 0 for null texts."""
    pieces = F.coalesce(F.regexp_count("text", F.lit(PIECE)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("words"), pieces.alias("pieces"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over documents and labels.

    All documents are inserted as words-1; those labelled good are recounted as pieces-2;
    those labelled toxic are deleted; the second batch comes again and is skipped.
    """
    scratch = Scratch(spark, "rollup")
    docs = scratch.keep(counted(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = scratch.keep(docs.join(labels, "doc_id"))
    first, second = F.lit("words-1").alias("version"), F.lit("pieces-2").alias("version")

    def rows(frame: DataFrame, version, tokens: str, sign: int) -> DataFrame:
        return frame.select("source", "lang", version, F.col(tokens).alias("tokens"), F.lit(sign).alias("sign"))

    rollup = TokenRollup(spark, f"{scratch.base}/totals")
    rollup.commit("1-insert", rows(docs, first, "words", 1))
    good = labelled.filter("quality = 1")
    revised = rows(good, first, "words", -1).unionByName(rows(good, second, "pieces", 1))
    rollup.commit("2-revise", revised)
    toxic = labelled.filter("toxic = 1")
    rollup.commit("3-delete", rows(toxic.filter("quality = 1"), second, "pieces", -1).unionByName(rows(toxic.filter("not coalesce(quality = 1, false)"), first, "words", -1)))
    assert not rollup.commit("2-revise", revised)
    return rollup.totals()


OP2_SQL = r"""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT d.source, d.lang, coalesce(l.quality = 1, false) AS good, d.text
  FROM documents d LEFT JOIN l USING (doc_id)
  WHERE NOT coalesce(l.toxic = 1, false)
),
c AS (
  SELECT source, lang, CASE WHEN good THEN 'pieces-2' ELSE 'words-1' END AS version,
    CASE WHEN good THEN len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]'))
         ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS n
  FROM d
)
SELECT source, lang, version, count(*)::BIGINT AS documents, coalesce(sum(n), 0)::BIGINT AS tokens
FROM c GROUP BY source, lang, version
"""
