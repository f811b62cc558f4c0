"""Reports: contribution of sources, funnels, cohorts, samples, statistics of a brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contribution(entries: DataFrame, sources: DataFrame, key: str, stamp: str) -> DataFrame:
    """Counts by source against the configured sources, both ways: share, rank, orphans and sources without output."""
    counts = entries.groupBy(key).agg(F.count("*").alias("n"), F.max(stamp).alias("last_ms"))
    known = sources.select(key, F.lit(True).alias("known"))
    met = counts.join(known, key, "full_outer").select(key, F.coalesce("n", F.lit(0)).alias("n"), "last_ms", F.coalesce("known", F.lit(False)).alias("in_param"))
    total = met.agg(F.sum("n").alias("total"))
    return met.crossJoin(F.broadcast(total)).select(key, "n", "last_ms", "in_param", (100.0 * F.col("n") / F.nullif(F.col("total"), F.lit(0))).alias("share")).withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"))))  # one row with one number is broadcast; sources are a small configuration table


def source_statistics(attempted: DataFrame, cleaned: DataFrame, final: DataFrame, window: DataFrame, key: str) -> DataFrame:
    """Per attempted source: cleaned, final, what dedup took (never below 0), and what only its age dropped."""
    count = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    out = attempted.select(key).distinct()
    for rows, name in ((cleaned, "cleaned"), (final, "final"), (window, "window_drops")):
        out = out.join(count(rows, name), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("dedup", F.greatest(F.col("cleaned") - F.col("final"), F.lit(0)))


def samples(tagged: DataFrame, reason: str, most: int, order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(reason).orderBy(*order))
    return tagged.where(F.col(reason).isNotNull()).withColumn("nth", rank).where(F.col("nth") <= most)


def top_values(rows: DataFrame, values: Column, most: int) -> DataFrame:
    """The most frequent items of an array column; equal counts by name."""
    return rows.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def enum_rank(value: Column, order: tuple[str, ...]) -> Column:
    """The place in a list of values; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(order) + 1).otherwise(place)


def precision_recall(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    hit = F.count_if(predicted & actual)
    return rows.agg((hit / F.nullif(F.count_if(predicted), F.lit(0))).alias("precision"), (hit / F.nullif(F.count_if(actual), F.lit(0))).alias("recall"))
