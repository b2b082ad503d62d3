"""Shared helpers: tables, checkpoints, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; one of our own only where there is none and all runs in one process, as in tests."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


def scratch_dir(spark: SparkSession) -> str:
    """A new name for tables in the shared checkpoint folder."""
    return f"{_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame, into: SparkSession | None = None) -> DataFrame:
    """Cut lineage by a table in the shared checkpoint folder; into: the session that goes on with it, df's own if none.

    A table has a size, so that small ones are broadcast, and nothing else of the plan that made
    it; Dataset.checkpoint hands on partitionings, which multiply in loops of joins until planning
    takes minutes. It is only taken for columns that Parquet can't have (void, names that differ by case).
    """
    spark = df.sparkSession
    folder = scratch_dir(spark)
    if any(kind == "void" for _, kind in df.dtypes) or len({c.lower() for c in df.columns}) < len(df.columns):
        if into is not None:
            raise ValueError("such columns can't be handed to another session")
        return df.checkpoint()
    df.write.parquet(folder)
    return (into or spark).read.schema(df.schema).parquet(folder)


def counted(df: DataFrame, what: str = "true") -> tuple[DataFrame, int]:
    """checkpoint, and the number of its rows for which what holds: counted as they are written, so that loops ask in no job of its own."""
    seen = Observation()
    out = checkpoint(df.observe(seen, F.count_if(F.expr(what)).alias("n")))
    return out, seen.get["n"]


def release(spark: SparkSession) -> None:
    """Have the driver collect what a loop's plans leave: Spark lets broadcasts, shuffle files and buffers go only when their handles are collected, which a driver with room to spare puts off."""
    spark._jvm.System.gc()


def ascii_lower(c):
    """A-Z only; `lower` is used where the text has no other letters, as it is faster."""
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(c):
    """Array of the runs of characters that are not space or \\x09-\\x0D; null and blank texts have none."""
    bare = F.trim(F.coalesce(c, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): component is the least node of its set.

    Contraction: in a round every node chooses the least of itself and its neighbours; choices are
    followed to their ends by doubling, and nodes that come to the same end become one. What
    each round chose is put together at the end. Minima are pre-aggregated, and joins are between
    written tables, whose hot keys (hubs) Spark can split. Null ends are ignored.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u <> v")
    links, left = counted(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    rounds = []
    while left:
        least = checkpoint(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        chosen, moved = least, True
        while moved:
            ahead, moved = counted(chosen.join(chosen.select(F.col("u").alias("m"), F.col("m").alias("r")), "m"), "m <> r")
            chosen = ahead.select("u", F.col("r").alias("m"))
        rounds.append(chosen)
        one, other = chosen.select("u", F.col("m").alias("p")), chosen.select(F.col("u").alias("v"), F.col("m").alias("q"))
        links, left = counted(links.join(one, "u").join(other, "v").where("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v")).distinct())
    if not rounds:
        return pairs.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    out = rounds.pop()
    while rounds:
        out = rounds.pop().join(out.select(F.col("u").alias("m"), F.col("m").alias("r")), "m", "left").select("u", F.coalesce("r", "m").alias("m"))
    return out.select(F.col("u").alias("node"), F.col("m").alias("component"))
