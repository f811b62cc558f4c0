"""Pictures over rows: each picture once in a brief, and media of entries filled from their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.article import stripped
from briefloom.storage import written


def picture_key(link: Column) -> Column:
    """An address without parameters and fragment, in lower case; empty for null and empty ones."""
    return F.lower(F.substring_index(F.substring_index(stripped(link), "?", 1), "#", 1))


def one_picture_each(rows: DataFrame, by: list[str], rank: str, own: str, cover: str) -> DataFrame:
    """Adds ``image_url``: each row's own picture unless an earlier row of its group shows it, else its cover, else nothing.

    A walk in order of ``rank`` would give each row the first of its two pictures that is not taken yet. Here all rows ask at
    once for the first that they were not refused, each picture goes to the earliest row that asks, and the others ask for
    their next one. As all pictures prefer earlier rows, both end with the same choice. A round is one aggregate of small
    keys with partial sums, so a group may hold any share of the rows and a picture be asked for by any of them; rounds follow the
    longest chain of rows that hand a picture on.

    ``rank`` tells the rows of a group apart. Null and empty addresses ask for nothing; null group columns are a group.
    """
    asks = F.filter(F.array(own, cover), lambda u: picture_key(u) != "")
    rows = rows.withColumns({"_grp": F.struct(*by), "_asks": asks})
    state = written(rows.select(F.col("_grp").alias("grp"), F.col(rank).alias("place"), F.transform("_asks", picture_key).alias("keys"), F.lit(0).alias("at")), "asked")
    while True:
        asked = state.withColumn("key", F.get("keys", F.col("at")))
        held = asked.where("key IS NOT NULL").groupBy("grp", "key").agg(F.min("place").alias("first"))
        tried = asked.join(held, ["grp", "key"], "left").withColumn("lost", F.coalesce(F.col("place") != F.col("first"), F.lit(False)))
        state = written(tried.select("grp", "place", "keys", (F.col("at") + F.col("lost").cast("int")).alias("at"), "lost"), "asked")
        if state.where("lost").isEmpty():
            break
        state = state.drop("lost")
    got = state.select(F.col("grp").alias("_grp"), F.col("place").alias(rank), F.col("at").alias("_at"))
    met = rows.join(got, ["_grp", rank])
    return met.withColumn("image_url", F.coalesce(F.get("_asks", F.col("_at")), F.lit(""))).drop("_grp", "_asks", "_at")
