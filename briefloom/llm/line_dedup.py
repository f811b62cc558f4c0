"""Line dedup by overlapping windows of three lines, with DataFrame functions only.

Every line is hashed once to 128 bits, and every run of three consecutive lines to 128 bits of its lines' hashes. A
window that is not the first of its kind, in the order of document id and place, is removed: the places that removed
windows cover are merged, and the lines at them go. A document of fewer than three lines has no window; windows of
blank lines only are not counted.

The first occurrence of a window is an aggregate with a partial step in each task, and the join that finds the later
ones carries ids and hashes only, so Spark may split a hot window's partition.

Defined cases: a null text stays null with no lines; an empty text is one empty line; null ids come before all others;
rows that repeat an id and its text are cut alike, as one document; a repeated id with another text is a document of
its own; other columns are passed on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import read_table

LINES = 3


def _windows(rows: DataFrame) -> DataFrame:
    """(id, text_hash, at, k1, k2) of every counted window of rows with (id, text_hash, lines)."""
    hashes = rows.where(F.size("lines") >= LINES).select(
        "id",
        "text_hash",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("b"),
        F.transform("lines", lambda x: F.trim(x) == "").alias("blank"),
    )

    def window(i):
        at = [i + k for k in range(LINES)]
        k1, k2 = (F.xxhash64(*[F.get(side, x) for x in at]) for side in ("a", "b"))
        blank = F.get("blank", at[0])
        for x in at[1:]:
            blank = blank & F.get("blank", x)
        return F.struct(i.alias("at"), k1.alias("k1"), k2.alias("k2"), blank.alias("blank"))

    starts = F.sequence(F.lit(0), F.size("a") - LINES)
    return hashes.select("id", "text_hash", F.inline(F.transform(starts, window))).where(~F.col("blank")).drop("blank")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (the row of ``docs``), ``text`` without removed lines, ``n_lines`` and ``n_removed``."""
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    key = [order.alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash")]
    rows = docs.select(F.struct("*").alias("_row"), *key)
    keys = docs.select(*key, F.split(F.col(text_col), "\n").alias("lines"))
    place = F.struct("id", "text_hash", "at")
    firsts = _windows(keys).groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = _windows(keys).join(firsts, ["k1", "k2"]).where(place != F.col("first"))
    covered = later.groupBy("id", "text_hash").agg(F.collect_set("at").alias("starts"))
    met = rows.join(covered, ["id", "text_hash"], "left").withColumn("lines", F.split(F.col("_row").getField(text_col), "\n"))
    places = F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(LINES)])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), places)
    text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return met.select(
        "_row",
        F.when(F.col("starts").isNull(), F.col("_row").getField(text_col)).otherwise(text).alias("text"),
        n_lines.alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("lines") - F.size(kept)).cast("long").alias("n_removed"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut from the text; all rows stay."""
    out = dedup_lines(docs, id_col, text_col)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


LINE_DEDUP_SQL = """
WITH l AS (
  SELECT doc_id, len(string_split(text, chr(10))) AS n_lines,
         unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
), w AS (
  SELECT doc_id, pos, line,
         lead(line, 1) OVER d AS line2, lead(line, 2) OVER d AS line3
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS r
    FROM w WHERE line3 IS NOT NULL AND trim(line || line2 || line3) <> ''
  ) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)
), kept AS (
  SELECT l.doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed,
         string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
