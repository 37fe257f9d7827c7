"""A sealed flight log: what a stream saw, in files that a chain of digests holds together.

Each micro-batch is a folder of JSON lines, and a manifest that names its files with their
SHA-256, counts its rows and trips, and has a seal over all that and the seal before it. The
manifest is written last: a batch counts once it is there, so a batch that is run again
after a failure is written anew, and one that is done isn't touched. Digests are made where
files are read; the driver gets a name and a digest for each file.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reports import canonical_json

MANIFEST = "batch long, previous string, files array<struct<name: string, sha256: string>>, observations long, trips long, seal string"
#: The seal before the first batch.
START = "0" * 64


def seal_of(batch: int, previous: str, files: list[tuple[str, str]], observations: int, trips: int) -> str:
    """SHA-256 of a manifest's content as canonical JSON."""
    content = {"batch": batch, "previous": previous, "files": [{"name": n, "sha256": d} for n, d in sorted(files)], "observations": observations, "trips": trips}
    return hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, name, sha256) of the data files of all batches, or of one batch's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_extract("path", r"batch=(\d+)/", 1).cast("long").alias("batch"), F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


@dataclass(frozen=True)
class FlightLog:
    """A log in a shared folder; pass write to foreachBatch."""

    folder: str

    def manifests(self, spark: SparkSession) -> DataFrame:
        path = f"{self.folder}/manifests"
        if not _exists(spark, path):
            return spark.createDataFrame([], MANIFEST)
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(path)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Commits a micro-batch once; a batch whose manifest is there is left alone."""
        spark = rows.sparkSession
        if _exists(spark, f"{self.folder}/manifests/batch={batch}/_SUCCESS"):
            return
        data = f"{self.folder}/data/batch={batch}"
        lines = rows.select(canonical_json(rows).alias("value"), "path", "t", "seq").sortWithinPartitions("path", "t", "seq").select("value")
        lines.write.mode("overwrite").text(data)
        counted = spark.read.text(data).agg(F.count("*").alias("n"), F.count_if(F.get_json_object("value", "$.tripped") == "true").alias("trips")).first()
        files = [(r.name, r.sha256) for r in digests(spark, data).collect()]  # a row for each file
        before = self.manifests(spark).filter(F.col("batch") < batch).agg(F.max_by("seal", "batch").alias("seal")).first().seal or START
        seal = seal_of(batch, before, files, counted.n, counted.trips)
        row = (batch, before, sorted(files), counted.n, counted.trips, seal)
        spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifests/batch={batch}")

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows of all committed batches, with a schema of their columns."""
        committed = self.manifests(spark).select("batch", F.explode("files.name").alias("name"))
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").text(f"{self.folder}/data").select("value", F.regexp_extract(F.input_file_name(), r"batch=(\d+)/", 1).cast("long").alias("batch"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
        return lines.join(committed, ["batch", "name"], "left_semi").select("batch", F.from_json("value", schema).alias("r")).select("batch", "r.*")

    def verify(self, spark: SparkSession) -> DataFrame:
        """(batch, status): ok; changed, missing or unknown where a file is; unsealed without a manifest; broken where the seal isn't that of what it covers."""
        found = digests(spark, f"{self.folder}/data")
        listed = self.manifests(spark).select("batch", F.explode("files").alias("f")).select("batch", F.col("f.name").alias("name"), F.col("f.sha256").alias("sealed"))
        status = F.when(F.col("sha256").isNull(), "missing").when(F.col("sealed").isNull(), "unknown").when(F.col("sealed") != F.col("sha256"), "changed")
        files = found.join(listed, ["batch", "name"], "full_outer").select("batch", status.alias("status")).groupBy("batch").agg(F.max("status").alias("file_status"))
        chain, previous = [], START
        # A manifest is a row for each batch; its files' names and digests are in it.
        for m in self.manifests(spark).orderBy("batch").toLocalIterator():
            good = m.previous == previous and m.seal == seal_of(m.batch, m.previous, [(f.name, f.sha256) for f in m.files], m.observations, m.trips)
            chain.append((m.batch, good))
            previous = m.seal
        seals = spark.createDataFrame(chain, "batch long, good boolean")
        joined = files.join(seals, "batch", "full_outer")
        return joined.select("batch", F.when(F.col("good").isNull(), "unsealed").when(~F.col("good"), "broken").otherwise(F.coalesce("file_status", F.lit("ok"))).alias("status"))
