"""Typed views of the tables: samples, conversations as trajectories, events as score streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = (
    "sample_id string, scenario_type string, turns array<struct<role: string, content: string>>, "
    "dataset_source string, harm_category string, should_block boolean, metadata map<string,string>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as single-turn samples; toxic ones should be blocked."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # Lengths are taken before the join, so that texts nobody asks for aren't shuffled. Labels grow with documents, but
    # their files are so small that Spark would broadcast millions of rows.
    return docs.withColumn("length", F.char_length("text")).join(labels.hint("shuffle_hash"), "doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"), "doc_id", F.lit("single_turn").alias("scenario_type"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("turns"), F.col("source").alias("dataset_source"),
        F.lit(None).cast("string").alias("harm_category"), (F.col("toxic") == 1).alias("should_block"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), "text", "length", "quality", "lang",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the fields of a trajectory: assistants are agents that think their first sentence, systems the environment."""
    t = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "system", "environment").otherwise(F.col("role"))
    agent = F.col("role") == "assistant"
    turn = F.struct(role.alias("role"), F.when(~agent, F.col("text")).alias("content"), F.when(agent, F.substring_index("text", ".", 1)).alias("thought"), F.when(agent, F.col("text")).alias("action"))
    return t.select("conv_id", F.col("turn").cast("long").alias("turn"), turn.alias("m"), "text")


def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scores: path is the user, t seconds, seq the tie-break; odd users count as unsafe (y), a stand-in label."""
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select(F.col("user_id").cast("string").alias("path"), seconds.alias("t"), F.col("event_id").alias("seq"), F.col("value").alias("raw"), "event_type", (F.col("user_id") % 2).cast("int").alias("y"))
