"""Briefs: their entries in order, time windows at publication, upsert by date, the newest ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.config import HOUR_MS


def brief_entries(briefs: DataFrame, entries: DataFrame, ids: str, entry_id: str) -> DataFrame:
    """A brief's ids (a JSON array) in order, with the entries that still exist."""
    listed = briefs.select("date", F.posexplode(F.from_json(F.col(ids), "array<string>")).alias("place", "_id"))
    return listed.join(entries, F.col("_id") == F.col(entry_id).cast("string")).drop("_id")


def in_brief_window(published_ms: Column, day_end_ms: Column, hours: Column) -> Column:
    """Within the source's hours before the end of the day; an unknown source passes, an undated item does not."""
    reach = F.least(F.lit(168), F.greatest(F.lit(1), hours)) * HOUR_MS
    return F.coalesce(F.when(hours.isNull(), published_ms.isNotNull()).otherwise(published_ms.between(day_end_ms - reach, day_end_ms)), F.lit(False))


def upsert_briefs(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Briefs by date: fresh content replaces stored content; the send state of a stored brief stays."""
    new = fresh.select("date", *[F.col(c).alias(f"_{c}") for c in fresh.columns if c != "date"])
    met = stored.join(new, "date", "full_outer")
    taken = [F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in new.columns else F.col(c) for c in stored.columns if c not in ("date", "send_status")]
    return met.select("date", *taken, F.coalesce("send_status", F.lit("待发送")).alias("send_status"))


def newest(briefs: DataFrame, most: int = 7) -> DataFrame:
    return briefs.orderBy(F.desc("date")).limit(most)


def with_current(history: DataFrame, current: DataFrame, most: int = 7) -> DataFrame:
    """The current brief and the stored ones of other dates, newest first."""
    others = history.join(current.select("date"), "date", "left_anti")
    return newest(current.unionByName(others), most)


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with changed cells; a null in a change leaves the cell, and changes without a row are ignored."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    met = table.join(new, key, "left")
    return met.select(key, *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in new.columns else F.col(c) for c in table.columns if c != key])


def without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def next_send_state(state: Column, delivered: Column, failed: Column, force: Column) -> Column:
    """A sent brief stays sent unless forced; else all delivered is sent, any failure is failed."""
    return F.when((state == "已发送") & ~force, "已发送").when(failed > 0, "失败").when(delivered > 0, "已发送").otherwise(state)
