"""Command line: `python -m tidewatch list | run | report`, also for spark-submit."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import attacks
from .operators import decisions, metrics, resample
from .sources import readers, reports


def coerced(value: str) -> bool | int | float | str:
    """true and false as bool, else an int, else a float, else the text itself."""
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def pairs(items: list[str]) -> dict[str, str]:
    """NAME=VALUE arguments as a dict; ValueError for anything else."""
    out = {}
    for item in items:
        name, found, value = item.partition("=")
        if not found or not name:
            raise ValueError(f"NAME=VALUE is asked for, not {item!r}")
        out[name] = value
    return out


def attacked(samples: DataFrame, attack: str | None) -> DataFrame:
    """Samples with text, the turns that aren't the assistant's, after an attack on those that should be blocked."""
    if attack:
        samples = attacks.apply_attack(samples, attack)
    said = F.filter("turns", lambda t: t["role"] != "assistant")
    return samples.withColumn("text", F.array_join(F.transform(said, lambda t: F.coalesce(t["content"], F.lit(""))), " "))


def evaluate(spark: SparkSession, samples: DataFrame, system: str, output: str, replicates: int = 1000, attack: str | None = None, options: dict | None = None) -> dict:
    """Runs a decision system on samples and writes its report; returns the summary.

    options go to the system's factory, where the system is named module:function and options
    are given. Samples without a result stay in the rates' denominators.
    """
    if options:
        made = decisions.load(system)(**options)
        decisions.register(system, made)
    samples.write.mode("overwrite").parquet(f"{output}/input")
    samples = attacked(spark.read.schema(samples.schema).parquet(f"{output}/input"), attack)
    results, seen = decisions.measured_run(samples, system, f"{output}/results")
    counts = samples.agg(F.count("*").alias("n"), F.count_if(F.col("metadata")["synthetic"] == "true").alias("synthetic")).first()
    joined = samples.select("sample_id", "should_block").join(results.select("sample_id", "decision"), "sample_id")
    intervals = None
    for name, (where, hit) in {"asr": ("should_block", F.col("decision") == "allow"), "orr": ("not should_block", F.col("decision") != "allow"), "escalation_rate": ("true", F.col("decision") == "escalate")}.items():
        one = resample.bootstrap_rate(joined.filter(where), hit, "sample_id", replicates, f"{name}:").select(F.lit(name).alias("rate"), "low", "high")
        intervals = one if intervals is None else intervals.unionByName(one)
    found = reports.report_metrics(metrics.rates(samples, results), intervals, metrics.advanced_metrics(samples, results))
    name = results.select("adapter_name", "adapter_version").first()
    summary = {**seen, "system": name.adapter_name if name else system, "version": name.adapter_version if name else None, "samples": counts.n, "synthetic_samples": counts.synthetic, "attack": attack or "none"}
    reports.write_report(reports.report_rows(samples, results), found, summary, output)
    return summary


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewatch")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="sources, attacks and decision systems")
    run = commands.add_parser("run", help="evaluate a decision system")
    run.add_argument("--source", action="append", default=[], metavar="NAME=PATH", help="a source and its file; made-up samples stand in for a file that is missing")
    run.add_argument("--system", default="keywords", help="a registered system, or module:function")
    run.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="for the function of --system")
    run.add_argument("--attack", choices=sorted(attacks.ATTACKS))
    run.add_argument("--limit", type=int, default=0, help="samples of each source, 0 for all")
    run.add_argument("--replicates", type=int, default=1000)
    run.add_argument("--held-out", action="store_true")
    run.add_argument("--accept-terms", action="store_true")
    run.add_argument("--strict", action="store_true")
    run.add_argument("--output", required=True)
    report = commands.add_parser("report", help="write a report again elsewhere")
    report.add_argument("input")
    report.add_argument("output")
    asked = parser.parse_args(arguments)
    if asked.command == "list":
        for what, names in (("sources", [*readers.READERS, "policy_compliance"]), ("attacks", attacks.ATTACKS), ("systems", decisions.SYSTEMS)):
            print(f"{what}: {', '.join(sorted(names))}")
        return 0
    spark = SparkSession.builder.appName("tidewatch").getOrCreate()
    if asked.command == "report":
        body, rows = reports.read_report(spark, asked.input)
        reports.write_again(rows, body, asked.output)
        return 0
    samples = None
    for name, path in pairs(asked.source).items():
        part = readers.load_dataset(spark, name, path or None, asked.held_out, asked.accept_terms, asked.strict)
        part = part.orderBy("sample_id").limit(asked.limit) if asked.limit > 0 else part
        samples = part if samples is None else samples.unionByName(part)
    if samples is None:
        parser.error("at least one --source is needed")
    summary = evaluate(spark, samples, asked.system, asked.output, asked.replicates, asked.attack, {k: coerced(v) for k, v in pairs(asked.option).items()})
    for name, value in summary.items():
        print(f"{name}: {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
