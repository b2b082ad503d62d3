"""Daily series: counting, gap filling, completeness, joining of channels.

A series is (keyword, channel, day, value); the clock `as_of` is a date given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS = 30
PUBLISH_LAG = 2
EARLIEST = "2016-01-01"


def daily_counts(events: DataFrame, keyword: Column, channel: Column, ts: Column) -> DataFrame:
    return events.groupBy(keyword.alias("keyword"), channel.alias("channel"), ts.cast("date").alias("day")).agg(F.count("*").cast("double").alias("value"))


def drop_incomplete(series: DataFrame, as_of: Column, partial: str | None = None) -> DataFrame:
    """Days before as_of only; rows whose `partial` column is true go too."""
    out = series.where(F.col("day") < as_of)
    return out.where(~F.coalesce(F.col(partial), F.lit(False))) if partial else out


def _spine(bounded: DataFrame) -> DataFrame:
    """Columns keyword, channel, points (day -> value), start, end -> one row a day, 0.0 where there is no point."""
    days = bounded.where("start <= end").select("keyword", "channel", "points", F.explode(F.sequence("start", "end")).alias("day"))
    return days.select("keyword", "channel", "day", F.coalesce(F.col("points")[F.col("day")], F.lit(0.0)).alias("value"))


def _points() -> Column:
    return F.map_from_entries(F.collect_list(F.struct("day", "value"))).alias("points")


def fill_search_series(series: DataFrame, as_of: Column, days: int = WINDOW_DAYS, lag: int = PUBLISH_LAG) -> DataFrame:
    """Zeros for days without a value, from the window's start to as_of - lag or the newest value if that is later.

    Series without any value in the window stay empty.
    """
    start = F.greatest(F.date_sub(as_of, days), F.lit(EARLIEST).cast("date"))
    grouped = series.where((F.col("day") >= start) & (F.col("day") <= as_of)).groupBy("keyword", "channel").agg(_points(), F.max("day").alias("newest"))
    return _spine(grouped.withColumn("start", start).withColumn("end", F.greatest(F.date_sub(as_of, lag), "newest")))


def series_completeness(meta: DataFrame, events: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """(keyword, channel, complete): all that exists was fetched, or an event before the cutoff was seen.

    meta: (keyword, channel, total, pageable); an unknown total or limit is incomplete.
    """
    old = events.groupBy("keyword", "channel").agg(F.bool_or(F.col("day") < F.date_sub(as_of, days)).alias("old"))
    return meta.join(old, ["keyword", "channel"], "left").select(
        "keyword", "channel", (F.coalesce(F.col("total") <= F.col("pageable"), F.lit(False)) | F.coalesce("old", F.lit(False))).alias("complete")
    )


def fill_mention_series(series: DataFrame, completeness: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Zeros from the cutoff to as_of; a cut-off collection starts the day after its oldest day, whose count is partial.

    One row of completeness for each (keyword, channel) to fill, with or without values.
    """
    cutoff = F.date_sub(as_of, days)
    grouped = series.where((F.col("day") >= cutoff) & (F.col("day") <= as_of)).groupBy("keyword", "channel").agg(_points(), F.min("day").alias("oldest"))
    out = completeness.join(grouped, ["keyword", "channel"], "left")
    start = F.when(F.col("complete") | F.col("oldest").isNull(), cutoff).otherwise(F.date_add("oldest", 1))
    empty = F.create_map().cast("map<date,double>")
    return _spine(out.select("keyword", "channel", F.coalesce("points", empty).alias("points"), start.alias("start"), as_of.alias("end")))


def merge_channels(series: DataFrame, channels: list[str], name: str = "merged") -> DataFrame:
    """Sum over the days that all the channels have; none where a channel is empty."""
    return (
        series.where(F.col("channel").isin(channels)).groupBy("keyword", "day")
        .agg(F.sum("value").alias("value"), F.countDistinct("channel").alias("n")).where(F.col("n") == len(set(channels)))
        .select("keyword", F.lit(name).alias("channel"), "day", "value")
    )
