"""Writers: tables, schema growth, seeds, CSV and JSON files, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def with_columns_of(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with every column of ``schema``; missing ones are null and others are kept behind."""
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in rows.columns]
    known = [c for c in schema.names if c in rows.columns]
    return rows.select("*", *more).select(*[c for c in schema.names if c in known or c not in rows.columns], *[c for c in rows.columns if c not in schema.names])


def seed(spark: SparkSession, rows: DataFrame, path: str) -> bool:
    """Writes rows where there is no table or an empty one; tells whether it did."""
    if exists(spark, path) and not spark.read.parquet(path).isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def split_for_upsert(rows: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows to update) against a stored table."""
    keys = stored.select(key).distinct()
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header and quotes where needed; parts are as many as the rows' partitions."""
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def payload(title: Column, url: Column, body: Column, source: Column, most: int = 4000) -> Column:
    """The JSON that a webhook gets for a new item."""
    return F.to_json(F.struct(title.alias("title"), url.alias("url"), F.left(body, F.lit(most)).alias("content"), source.alias("source")))


def unique_slugs(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``slug``; equal slugs get -2, -3 and so on in order. Names without Latin letters share ``source``."""
    from pyspark.sql import Window

    from briefloom.functions.url import slug

    base = F.coalesce(F.nullif(slug(F.col(name)), F.lit("")), F.lit("source"))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    return rows.withColumn("_base", base).withColumn("slug", F.when(n == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", n.cast("string")))).drop("_base")
