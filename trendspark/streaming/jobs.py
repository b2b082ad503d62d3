"""Structured Streaming jobs with the semantics of the batch operators."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trendspark.operators import chunks

MANIFEST = "epoch bigint, folder string, compacted boolean"


def commit_chunks(batch: DataFrame, epoch: int, out: str, recursive: bool = True, nfc: bool = True) -> None:
    """Chunks of one micro-batch: the documents' chunks, then its line in the manifest, which is what makes them count.

    Of an id that comes several times, the last content by crawled_at (where there is such a column)
    counts. A document without chunks leaves an empty row, so that its older chunks go. The data folder
    of an epoch is replaced, and the manifest names an epoch once, so a repeated micro-batch changes nothing.
    """
    order = F.col("crawled_at") if "crawled_at" in batch.columns else F.lit(0)
    cols = [c for c in batch.columns if c != "_id"]
    last = batch.groupBy("_id").agg(F.max_by(F.struct(*cols), F.struct(order, F.xxhash64(*cols))).alias("r")).select("_id", "r.*")
    pieces = chunks.process_documents(last, recursive, nfc)
    whole = last.select(F.col("_id").alias("parent_id")).join(pieces, "parent_id", "left")
    whole.write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")
    _add_to_manifest(batch.sparkSession, out, epoch, f"{out}/data/epoch={epoch}", False)


def _add_to_manifest(spark: SparkSession, out: str, epoch: int, folder: str, compacted: bool) -> None:
    """One small folder a committed epoch; Spark's writer makes it whole or not at all."""
    line = spark.createDataFrame([(epoch, folder, compacted)], MANIFEST).coalesce(1)
    line.write.mode("overwrite").json(f"{out}/manifest/{'compact' if compacted else 'epoch'}-{epoch}")


def committed(spark: SparkSession, out: str) -> list[tuple[int, str]]:
    """(epoch, folder) that count now: the newest compaction, and the epochs after it. One line an epoch since."""
    lines = [(r["epoch"], r["folder"], r["compacted"]) for r in spark.read.schema(MANIFEST).json(f"{out}/manifest/*").collect()]
    base = max((x for x in lines if x[2]), default=None)
    return ([(base[0], base[1])] if base else []) + sorted((e, f) for e, f, c in lines if not c and (base is None or e > base[0]))


def clean_and_chunk(stream: DataFrame, out: str, checkpoint: str, recursive: bool = True, nfc: bool = True):
    """Chunks of newly arrived documents, exactly once; the newest version of an id replaces its older ones.

    Every micro-batch is committed by `commit_chunks`; `latest_chunks` reads what counts, and `compact_chunks` bounds it.
    """
    return stream.writeStream.foreachBatch(lambda batch, epoch: commit_chunks(batch, epoch, out, recursive, nfc)).option("checkpointLocation", checkpoint)


def _newest(spark: SparkSession, out: str, keep_gone: bool) -> DataFrame:
    """Of each document, the rows of the last committed epoch that had it."""
    parts = committed(spark, out)
    rows = None
    for epoch, folder in parts:
        one = spark.read.parquet(folder)
        one = one if "epoch" in one.columns else one.withColumn("epoch", F.lit(epoch))
        rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy("parent_id").agg(F.max("epoch").alias("epoch"))
    kept = rows.join(last, ["parent_id", "epoch"], "left_semi")
    return kept if keep_gone else kept.where("chunk is not null")


def latest_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks that count: of each document, those of the last committed micro-batch that had it. Reads the newest compaction and the epochs after it only."""
    return _newest(spark, out, False).drop("epoch")


def compact_chunks(spark: SparkSession, out: str) -> None:
    """Write what counts as one table, which the manifest then names instead of the epochs up to now; these folders may be cleared.

    Documents without chunks are left out: what they replaced is not read any more.
    """
    epoch = committed(spark, out)[-1][0]
    _newest(spark, out, False).write.mode("overwrite").parquet(f"{out}/compact/epoch={epoch}")
    _add_to_manifest(spark, out, epoch, f"{out}/compact/epoch={epoch}", True)


def first_of_id(stream: DataFrame, ts: str = "ts", delay: str = "2 days", key: str = "_id") -> DataFrame:
    """The first row of each id within the delay; a batch has no watermark, so there it is the first of all."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_mentions(stream: DataFrame, keyword: Column, channel: Column, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Counts of closed days; in append mode a day comes out once the watermark has passed its end."""
    day = F.window(ts, "1 day")
    g = stream.withWatermark(ts, delay).groupBy(day, keyword.alias("keyword"), channel.alias("channel")).agg(F.count("*").cast("double").alias("value"))
    return g.select("keyword", "channel", F.col("window.start").cast("date").alias("day"), "value")


def gate_against(stream: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a stream that a static table (rejects, hidden keywords) does not have."""
    known = table.select(*keys).distinct().withColumn("__known", F.lit(True))
    return stream.join(known, keys, "left").where("__known is null").drop("__known")


def _verdicts(times: list[int], recent: list[int], limit: int, span: int) -> list[bool]:
    """Of hits in order: accepted with fewer than limit accepted ones in the span before. recent is kept up to date, in order."""
    out = []
    for t in times:
        ok = sum(t - span < r <= t for r in recent) < limit
        if ok:
            insort(recent, t)
        out.append(ok)
    return out


def flag_bursts(stream: DataFrame, limit: int, seconds: float, key: str = "key", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """(key, ts, accepted): accepted with fewer than limit accepted hits in the last seconds; rejected hits don't count.

    In batch, rows of a key pass one task in order of time, which holds at most limit times. In a
    stream they are judged in order of time within a micro-batch; a row that comes later than others of its
    key, but within the delay, counts the accepted hits before it only, and changes no verdict given; rows
    later than the delay get none. The state of a key is the accepted times that rows within the
    delay can still count; once the watermark has passed the last of them, a timer removes it.
    """
    schema = f"{key} string, {ts} timestamp, accepted boolean"
    span = round(seconds * 1_000_000)
    rows = stream.select(F.col(key).cast("string").alias(key), F.col(ts).cast("timestamp").alias(ts))
    micros = lambda frame: (frame[ts].astype("datetime64[us]").astype("int64")).tolist()
    if not stream.isStreaming:

        def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, recent, any_yet = None, [], False
            for b in batches:
                out = []
                for k, t in zip(b[key], micros(b)):
                    if not any_yet or k != now:
                        now, recent, any_yet = k, [], True
                    recent = [r for r in recent if r > t - span]
                    out += _verdicts([t], recent, limit, span)
                yield b.assign(accepted=out)

        return rows.where(F.col(ts).isNotNull()).repartition(key).sortWithinPartitions(key, ts).mapInPandas(ordered, schema)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(frames).sort_values(ts)
        recent = list(state.get[0]) if state.exists else []
        accepted = _verdicts(micros(frame), recent, limit, span)
        mark = state.getCurrentWatermarkMs()
        recent = [r for r in recent if r > mark * 1000 - span]
        if recent:
            state.update((recent,))
            state.setTimeoutTimestamp(max((recent[-1] + span) // 1000 + 1, mark + 1))
        elif state.exists:
            state.remove()
        yield frame.assign(accepted=accepted)[[key, ts, "accepted"]]

    return rows.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(update, schema, "recent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
