"""Merkle manifest of a table: a tree of SHA-256 digests for each group of rows, one over the groups, and proofs for rows.

Rows are digested once, by Spark. Their places within a group come from a sort by ranges: a range's rows are numbered
where they lie, and the counts of the ranges before it are added. Places are cut into aligned buckets of ``FAN**DEPTH``
leaves, each of which is a whole subtree, whatever the size of its group. A bucket goes as an Arrow table into DuckDB,
which runs one ordered ``string_agg`` and ``sha256`` for each level. Spark combines the buckets' roots, one row a bucket,
and joins the outer proofs back to the buckets; DuckDB then states the proofs of a bucket's rows.

A proof lists, from the leaf up, the digests before and after one's own in each run. Folding a leaf with its proof gives
the root if the leaf is the one that was digested; that is a Column expression and needs no Python.

Defined cases: a null group is a group of its own and the first one; null ids come first in their group, equal ids in the
order of their digests, and rows that are equal in all digested columns are leaves beside one another; a null column is
digested as such, apart from empty text; texts have any length; a group of one row has its leaf as root, and so has a
table of one group; an empty table gives no rows; columns that are not named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.llm.common import discard, read_table, written

#: Nodes of a run, and levels of a bucket, which bound what one task holds: 4,096 leaves.
FAN, DEPTH = 8, 4
#: Rows of a range's places; a place is the range's number times this, and the row's number in it.
RANGE_ROWS = 1 << 33


def field(value: Column) -> Column:
    """What a digest takes of a value: ``-`` for null, else its bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(digest: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(F.arrays_zip(before.alias("b"), after.alias("a")), digest, lambda h, s: F.sha2(F.concat(s["b"], h, s["a"]), 256))


def siblings(before: Column, after: Column) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "")


def levels(n: int, fan: int = FAN) -> int:
    """Levels above ``n`` leaves until one node remains."""
    count = 0
    while n > 1:
        n, count = -(-n // fan), count + 1
    return count


def group_key(value: Column) -> Column:
    """Text that sorts by bytes as the group does, null first."""
    return F.when(value.isNull(), "0").otherwise(F.concat(F.lit("1"), value.cast("string")))


def in_places(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``i``, the place within the group, and ``n``, the group's rows, without a window over all rows."""
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "places")
    ranges = F.shiftright("_place", RANGE_ROWS.bit_length() - 1).alias("_range")
    counts = placed.groupBy(group, ranges).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    earlier = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "_range", (earlier - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    met = placed.withColumn("_range", ranges).join(counts, [group, "_range"])
    return met.select(*rows.columns, (F.col("_place") + F.col("_shift")).alias("i"), "n")


@cache
def engine() -> duckdb.DuckDBPyConnection:
    """One in-memory DuckDB a worker."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def level_queries(count: int, fan: int) -> str:
    """Tables l0 to l``count`` of (i, h): the leaves and the nodes of each level above."""
    parts = ["l0 AS MATERIALIZED (SELECT i, h FROM leaves)"]
    for k in range(count):
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT i // {fan} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l{k} GROUP BY ALL)")
    return "WITH " + ", ".join(parts)


def proof_query(count: int, fan: int) -> str:
    """(i, before, after) of every leaf of a bucket, within the bucket."""
    run = f"(PARTITION BY i // {fan} ORDER BY i ROWS BETWEEN"
    sides = {"b": f"{run} UNBOUNDED PRECEDING AND 1 PRECEDING)", "a": f"{run} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"}
    tables = "".join(f", s{k} AS MATERIALIZED (SELECT i, " + ", ".join(f"coalesce(string_agg(h, '') OVER {w}, '') AS {name}" for name, w in sides.items()) + f" FROM l{k})" for k in range(count))
    lists = {name: "[" + ", ".join(f"s{k}.{name}" for k in range(count)) + "]::VARCHAR[]" for name in sides}
    joins = "".join(f" JOIN s{k} ON s{k}.i = l0.i // {fan**k}" for k in range(count))
    return f"{level_queries(count, fan)}{tables} SELECT l0.i, {lists['b']} AS before, {lists['a']} AS after FROM l0{joins}"


def bucket_levels(n: int, fan: int, depth: int) -> int:
    return min(depth, levels(n, fan))


def _bucket_roots(rows: DataFrame, fan: int, depth: int) -> DataFrame:
    """(grp, n, i, h): the root of every bucket; ``n`` is the number of the group's nodes on that level."""

    def root(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        count = bucket_levels(n, fan, depth)
        leaves = table.select(["i", "h"])
        con = engine()
        con.register("leaves", leaves)
        ((h,),) = con.sql(f"{level_queries(count, fan)} SELECT h FROM l{count}").fetchall()
        con.unregister("leaves")
        nodes = {"grp": table["grp"][:1], "n": pa.array([-(-n // fan**count)], pa.int64()), "i": table["bucket"][:1], "h": pa.array([h])}
        return pa.table(nodes).select(["grp", "n", "i", "h"])

    return rows.select("grp", "bucket", "n", "i", "h").groupBy("grp", "bucket").applyInArrow(root, "grp string, n long, i long, h string")


def climb(nodes: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Paths (grp, node, before, after) of nodes (grp, n, i, h) up to their group's top, and the tops (grp, top).

    A run is a group of at most ``fan`` rows. Only the highest number of nodes of a group comes to the driver.
    """
    most = nodes.agg(F.max("n")).first()[0] or 1
    none = F.array().cast("array<string>")
    paths = nodes.select("grp", F.col("i").alias("node"), F.col("i").alias("at"), none.alias("before"), none.alias("after"))
    for _ in range(levels(most, fan)):
        runs = nodes.where("n > 1").groupBy("grp", F.expr(f"i div {fan}").alias("up")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "h"))).alias("run"))
        side = lambda test: F.array_join(F.transform(F.filter("run", test), lambda s: s["h"]), "")
        met = paths.withColumn("up", F.expr(f"at div {fan}")).join(runs.select("grp", "up", "run"), ["grp", "up"], "left")
        longer = {name: F.when(F.col("run").isNull(), F.col(name)).otherwise(F.concat(F.col(name), F.array(side(test)))) for name, test in (("before", lambda s: s["i"] < F.col("at")), ("after", lambda s: s["i"] > F.col("at")))}
        paths = met.withColumns(longer).select("grp", "node", F.when(F.col("run").isNull(), F.col("at")).otherwise(F.col("up")).alias("at"), "before", "after")
        parents = runs.select("grp", F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.col("up").alias("i"), F.sha2(F.array_join(F.transform("run", lambda s: s["h"]), ""), 256).alias("h"))
        nodes = written(parents.unionByName(nodes.where("n = 1")), "nodes")
    return paths.drop("at"), nodes.select("grp", F.col("h").alias("top"))


def merkle_proofs(leaves: DataFrame, group: str, id_col: str, digest: str, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """The columns of ``leaves`` with ``subroot``, ``root`` and the proof of each row as ``before`` and ``after``."""
    columns = leaves.columns
    own = leaves.select(group_key(F.col(group)).alias("grp"), F.col(id_col).alias("id"), F.col(digest).alias("h"), F.struct(*columns).alias("row"))
    kept = written(own, "leaves")
    shape = kept.schema["row"].dataType.simpleString()
    placed = in_places(kept, "grp", ["id", "h"]).withColumn("bucket", F.expr(f"i div {fan**depth}"))
    discard(kept)  # the places hold all of it
    roots = written(_bucket_roots(placed, fan, depth), "buckets")
    paths, tops = climb(roots, fan)
    above = in_places(tops.select(F.lit("").alias("whole"), "grp", F.col("top").alias("h")), "whole", ["grp"])
    outer, root = climb(above.select(F.col("whole").alias("grp"), "n", "i", "h"), fan)
    ends = above.join(outer.select(F.col("node").alias("i"), F.col("before").alias("outer_before"), F.col("after").alias("outer_after")), "i").join(root.select(F.col("grp").alias("whole"), F.col("top").alias("root")), "whole")
    ends = ends.select("grp", F.col("h").alias("subroot"), "root", "outer_before", "outer_after")
    outside = paths.join(ends, "grp").select("grp", F.col("node").alias("bucket"), "subroot", "root", *[F.concat(x, f"outer_{x}").alias(x) for x in ("before", "after")])
    outside = written(outside, "outer")
    discard(roots)

    def proofs(bucket: pa.Table, above: pa.Table) -> pa.Table:
        n = bucket["n"][0].as_py() if bucket.num_rows else 0
        count = bucket_levels(n, fan, depth)
        con = engine()
        con.register("leaves", bucket.select(["i", "h"]))
        con.register("own", bucket.select(["i", "row"]))
        con.register("above", above)
        query = f"""SELECT own.row AS row, above.subroot AS subroot, above.root AS root, list_concat(p.before, above.before) AS before, list_concat(p.after, above.after) AS after
          FROM own JOIN ({proof_query(count, fan)}) p USING (i) CROSS JOIN above"""
        found = con.sql(query).to_arrow_table()
        for name in ("leaves", "own", "above"):
            con.unregister(name)
        return found

    sides = placed.select("grp", "bucket", "n", "i", "h", "row").groupBy("grp", "bucket").cogroup(outside.groupBy("grp", "bucket"))
    found = sides.applyInArrow(proofs, f"row {shape}, subroot string, root string, before array<string>, after array<string>")
    return found.select("row.*", "subroot", "root", "before", "after")


def manifest(leaves: DataFrame, group: str, id_col: str, digest: str, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(group, n_leaves, subroot, root): what is published of a table."""
    found = merkle_proofs(leaves.select(group, id_col, digest), group, id_col, digest, fan, depth)
    return found.groupBy(group).agg(F.count("*").alias("n_leaves"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and whether each holds after a third of the texts has been lower-cased."""
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    claimed = F.when(tampered & (lower_ascii(F.col("text")) != F.col("text")), leaf(*values[:-1], lower_ascii(F.col("text"))))
    leaves = read_table(spark, sf_dir, "documents").select("doc_id", "lang", leaf(*values).alias("leaf"), claimed.alias("claimed"))
    found = merkle_proofs(leaves, "lang", "doc_id", "leaf")
    folded = found.withColumn("folded_root", fold(F.coalesce("claimed", "leaf"), F.col("before"), F.col("after")))
    proof = F.sha2(siblings(F.col("before"), F.col("after")), 256).alias("proof_sha256")
    return folded.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""


def _tree_sql(name: str, base: str) -> str:
    """Nodes of all levels over ``base`` (grp, n, i, h); level 0 holds the leaves, n the nodes of the level."""
    return f"""{name} AS (
  SELECT grp, 0 AS lvl, n, i, h FROM {base}
  UNION ALL
  SELECT grp, lvl + 1, (any_value(n) + {FAN - 1}) // {FAN}, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY grp, lvl, i // {FAN})"""


MANIFEST_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS grp, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_leaf_sql(_LOWER_SQL)} ELSE {_leaf_sql("text")} END AS claimed
  FROM documents
), base AS (
  SELECT grp, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, claimed, doc_id FROM docs
), {_tree_sql("inside", "base")}, tops AS (
  SELECT '' AS grp, count(*) OVER () AS n, row_number() OVER (ORDER BY grp) - 1 AS i, h, grp AS own FROM inside WHERE n = 1
), {_tree_sql("outside", "tops")}, trees AS (
  SELECT 0 AS side, * FROM inside UNION ALL SELECT 1, * FROM outside
), runs AS (
  SELECT side, grp, lvl, i // {FAN} AS up, list({{'i': i, 'h': h}} ORDER BY i) AS run FROM trees WHERE n > 1 GROUP BY ALL
), walk AS (
  SELECT doc_id, h AS leaf, grp AS own, 0 AS side, grp, 0 AS lvl, i, claimed AS cur, '' AS proof, n FROM base
  UNION ALL
  SELECT w.doc_id, w.leaf, w.own, coalesce(r.side, 1), coalesce(r.grp, ''), CASE WHEN r.up IS NULL THEN 0 ELSE w.lvl + 1 END, coalesce(r.up, t.i),
    CASE WHEN r.up IS NULL THEN w.cur ELSE sha256(array_to_string(list_transform(r.run, lambda s: CASE WHEN s.i = w.i THEN w.cur ELSE s.h END), '')) END,
    w.proof || CASE WHEN r.up IS NULL THEN '' ELSE array_to_string(list_transform(list_filter(r.run, lambda s: s.i <> w.i), lambda s: s.h), '') END,
    CASE WHEN r.up IS NULL THEN t.n ELSE (w.n + {FAN - 1}) // {FAN} END
  FROM walk w LEFT JOIN runs r ON w.n > 1 AND r.side = w.side AND r.grp = w.grp AND r.lvl = w.lvl AND r.up = w.i // {FAN}
    LEFT JOIN tops t ON t.own = w.own
  WHERE w.n > 1 OR w.side = 0
)
SELECT w.doc_id, w.leaf, t.h AS subroot, o.h AS root, sha256(w.proof) AS proof_sha256, w.cur AS folded_root, w.cur = o.h AS verified
FROM walk w JOIN tops t ON t.own = w.own JOIN outside o ON o.n = 1 WHERE w.side = 1 AND w.n = 1
"""
