"""Incremental runs over arriving items: repeats, late items, windows, keyed threads, sinks that may be repeated."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from briefloom.config import DAY_MS
from briefloom.storage import shared_folder


def plausible(stamp: Column, now: Column, days: int = 2) -> Column:
    """A time that is not more than ``days`` ahead; it is tested before the watermark, which such a time would move."""
    return stamp <= now + F.make_dt_interval(F.lit(days))


def first_seen(items: DataFrame, key: str, stamp: str, within: str = "7 days") -> DataFrame:
    """Items whose key did not arrive before, with state that is bounded by the watermark."""
    return items.withWatermark(stamp, within).dropDuplicatesWithinWatermark([key])


def new_against(items: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Stream-static anti join on stored keys; blank keys are always new."""
    known = stored.select(F.nullif(F.col(key), F.lit("")).alias("_known")).where(F.col("_known").isNotNull()).distinct().withColumn("_seen", F.lit(True))
    met = items.join(known, F.nullif(F.col(key), F.lit("")) == F.col("_known"), "left_outer")
    return met.where(F.col("_seen").isNull()).drop("_known", "_seen")


def tagged_late(items: DataFrame, stamp: str, now: Column, hours: Column, hot: Column) -> DataFrame:
    """Adds ``late``: older than the source's window and not hot; late items are counted, not lost."""
    oldest = now - F.make_dt_interval(F.lit(0), hours)
    return items.withColumn("late", ~F.coalesce(hot, F.lit(False)) & (F.col(stamp) <= oldest))


def cn_days(items: DataFrame, stamp: str) -> DataFrame:
    """Counts by day of UTC+8."""
    window = F.window(F.col(stamp), "1 day", startTime="16 hours")
    return items.groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.date_format(F.col("w.start") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd").alias("day"), "n", "total")


def sliding(items: DataFrame, stamp: str, size: str, step: str) -> DataFrame:
    return items.groupBy(F.window(F.col(stamp), size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(items: DataFrame, key: str, stamp: str, gap: str) -> DataFrame:
    window = F.session_window(F.col(stamp), gap)
    return items.groupBy(key, window.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def poll_due(last_ms: Column, tier: Column, now_ms: int) -> Column:
    """P0 accounts are asked every two hours, others every four."""
    return last_ms.isNull() | (F.lit(now_ms) - last_ms >= F.when(tier == "P0", 2).otherwise(4) * (DAY_MS // 24))


def threads(posts: DataFrame, key: str) -> DataFrame:
    """The newest state of each thread as its posts arrive: (key, posts, characters, last_turn); state is three numbers."""

    def merge(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, size, last = state.get if state.exists else (0, 0, -1)
        for frame in frames:
            n, size, last = n + len(frame), size + int(frame["text"].str.len().sum()), max(last, int(frame["turn"].max()))
        state.update((n, size, last))
        yield pd.DataFrame({key: [group[0]], "posts": [n], "characters": [size], "last_turn": [last]})

    return posts.groupBy(key).applyInPandasWithState(merge, f"{key} long, posts long, characters long, last_turn long", "posts long, characters long, last_turn long", "update", GroupStateTimeout.NoTimeout)


def quiet_threads(posts: DataFrame, thread: str, stamp: str, place: str, text: str, quiet: str, late: str) -> DataFrame:
    """A thread as one item once it has been quiet: no post of it within ``quiet`` of its last, by the posts' own times.

    A post opens or extends a session of its thread, also between two sessions, which it joins. The watermark, ``late`` behind
    the newest time, closes sessions: they are emitted once, with their posts in order, and their state goes, so that what is
    held follows the posts of the last ``quiet`` and ``late``, not all threads. A post that comes after its session was closed
    but before the watermark makes a new row of its thread, which ``merge_sessions`` joins to the earlier one; posts behind the
    watermark are dropped. Posts without a thread or time are left out.
    """
    known = posts.where(F.col(thread).isNotNull() & F.col(stamp).isNotNull()).withWatermark(stamp, late)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(text).alias("text"))))
    closed = known.groupBy(thread, F.session_window(stamp, quiet).alias("_session")).agg(ordered.alias("posts"))
    return closed.select(thread, F.col("_session.start").alias("started"), F.col("_session.end").alias("quiet_at"), "posts")


def merge_sessions(closed: DataFrame, thread: str) -> DataFrame:
    """The sessions of each thread as one row: its posts in order, each place once."""
    one = F.array_sort(F.array_distinct(F.flatten(F.collect_list("posts"))))
    return closed.groupBy(thread).agg(F.min("started").alias("started"), F.max("quiet_at").alias("quiet_at"), one.alias("posts"))


def upserting(path: str, key: str, order: str):
    """A foreachBatch sink: the table at ``path`` keeps the newest row of each key, however often a batch is repeated.

    The new table is written to a folder of its own, whatever the batch's number, and named in a pointer file with a number
    of its own sequence. A reader never sees half a table, a repeated batch changes nothing, and a restart with a new
    checkpoint goes on from the table that is there. One query writes to a table at a time.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _last_version(spark, path)
        rows = batch if last is None else spark.read.parquet(f"{path}/{last['folder']}").unionByName(batch, allowMissingColumns=True)
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")
        folder = f"table-{uuid.uuid4().hex}"
        newest.write.parquet(f"{path}/{folder}")
        spark.createDataFrame([(1 + (last["version"] if last else 0), folder)], "version long, folder string").coalesce(1).write.mode("append").json(f"{path}/_versions")

    return write


def _last_version(spark, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema("version long, folder string").json(f"{path}/_versions").orderBy(F.desc("version")).first()


def read_upserted(spark, path: str) -> DataFrame | None:
    """The newest finished version of an upserted table; None before the first."""
    last = _last_version(spark, path)
    return None if last is None else spark.read.parquet(f"{path}/{last['folder']}")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a fresh folder of ``spark.checkpoint.dir``, and reads its rows back.

    A batch has a folder of its own, which a repeated batch overwrites; the driver holds no rows.
    """
    spark, columns = stream.sparkSession, stream.columns
    path = f"{shared_folder(spark)}/briefloom/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*columns)
