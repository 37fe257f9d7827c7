"""Reports of a run, sealed evidence, and the verification of seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.decisions import evaluation_correct

COLUMNS = ["sample_id", "dataset_source", "should_block", "decision", "confidence", "latency_ms", "evaluation_correct"]


def report_rows(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Seven columns for each result of a known sample."""
    joined = samples.select("sample_id", "dataset_source", "should_block").join(results, "sample_id")
    return joined.withColumn("evaluation_correct", evaluation_correct(F.col("should_block"), F.col("decision"))).select(*COLUMNS)


def write_csv(rows: DataFrame, folder: str) -> bool:
    """One CSV file with a header; nothing is written for no rows."""
    if rows.isEmpty():
        return False
    rows.orderBy("sample_id").coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
    return True


def canonical(column: Column, kind: T.DataType) -> Column:
    """The column with the fields of all its structs in order of name, and entries of maps in order of key."""
    if isinstance(kind, T.StructType):
        fields = F.struct(*(canonical(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(column.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    return column


def canonical_json(frame: DataFrame, names: list[str] | None = None) -> Column:
    """Rows of frame as JSON: keys in order at each depth, nulls written out; equal rows give equal bytes."""
    names = sorted(frame.columns if names is None else names)
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    return F.to_json(F.struct(*(canonical(F.col(n), kinds[n]).alias(n) for n in names)), {"ignoreNullFields": "false"})


def sealed(frame: DataFrame, volatile: tuple[str, ...] = ("wall_time", "latency_ms")) -> DataFrame:
    """(json, sha256): each row as canonical JSON; volatile columns are left out of the digest."""
    stable = canonical_json(frame, [n for n in frame.columns if n not in volatile])
    return frame.select(canonical_json(frame).alias("json"), F.sha2(stable, 256).alias("sha256"))


def verify_seals(spark: SparkSession, folder: str) -> DataFrame:
    """(name, status) of artefacts and sidecars in a folder: ok, mismatch, orphan (no artefact) or unsealed.

    A sidecar X.sha256 holds the digest of X, or of X.json.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    seals = files.filter("name like '%.sha256'").select(F.regexp_replace("name", r"(\.json)?\.sha256$", "").alias("stem"), F.lower(F.regexp_extract(F.decode("content", "UTF-8"), "[0-9a-fA-F]{64}", 0)).alias("seal"))
    found = files.filter("name like '%.json'").select(F.regexp_replace("name", r"\.json$", "").alias("stem"), F.sha2("content", 256).alias("digest"))
    status = F.when(F.col("seal").isNull(), "unsealed").when(F.col("digest").isNull(), "orphan").when(F.col("seal") == F.col("digest"), "ok").otherwise("mismatch")
    return found.join(seals, "stem", "full_outer").select(F.col("stem").alias("name"), status.alias("status"))


def report_metrics(rates: DataFrame, intervals: DataFrame, advanced: DataFrame) -> DataFrame:
    """One row of a report's metrics: rates, intervals by rate with lower and upper, advanced ones. intervals: (rate, low, high)."""
    ci = F.map_from_entries(F.sort_array(F.collect_list(F.struct("rate", F.struct(F.col("low").alias("lower"), F.col("high").alias("upper"))))))
    whole = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    return whole(rates, "rates").crossJoin(intervals.agg(ci.alias("confidence_intervals_95"))).crossJoin(whole(advanced, "advanced"))  # a row each


def write_report(rows: DataFrame, metrics: DataFrame, summary: dict, folder: str) -> None:
    """A report in four forms: report.json (summary and metrics), samples as JSON lines and as CSV, report.md.

    rows: report_rows(); metrics: report_metrics(), of which the one row comes to the driver.
    """
    import json

    write_again(rows, {"summary": summary, "metrics": json.loads(metrics.select(canonical_json(metrics)).first()[0])}, folder)


def write_again(rows: DataFrame, body: dict, folder: str) -> None:
    """Writes a report from its samples and its body of summary and metrics; samples are written by their tasks, however many there are."""
    import json

    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{folder}/samples.parquet")
    kept = spark.read.schema(rows.schema).parquet(f"{folder}/samples.parquet")
    kept.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/samples.json")
    kept.write.mode("overwrite").option("header", True).csv(f"{folder}/samples.csv")
    rates = body["metrics"]["rates"]
    rows_of = ["| metric | value |", "|---|---|", *(f"| {k} | {'N/A' if v is None else f'{100 * v:.1f} %'} |" for k, v in rates.items())]
    for name, text in (("report.json", json.dumps(body, sort_keys=True, ensure_ascii=False)), ("report.md", "\n".join(rows_of))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def read_report(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    """Summary and metrics of a report, and its samples, to write it again elsewhere or in another form."""
    import json

    return json.loads(spark.read.text(f"{folder}/report.json").first().value), spark.read.parquet(f"{folder}/samples.parquet")
