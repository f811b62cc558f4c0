"""Exact top-k search by inner product: no-random-access aggregation of sorted lists, in blocks.

Vectors are dealt into blocks of rows. A block sorts each dimension once. For a block of queries, each dimension's list
is read from the end that its query component favours, in lock step and to doubling depths. What a row is known to score
so far, with the worst of each unread list, is its lower bound; with the list's last read value instead, its upper
bound. A query is done in a block when the upper bounds of all rows but those that are still open fall below its k-th
lower bound; the open rows are then few, and their final scores are resolved from their remaining components. The best
k of each block meet in a window per query, so the merged result is exact.

Scores are integers: each component is ``floor(256 * x)``, and sums are exact in float64 up to 2**53.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
null id; vectors of different lengths are not compared; a query never meets rows with its own id; equal scores go to
the smaller id; repeated ids each count as a row, and as one query by the least of their vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.llm.common import read_table

#: Rows of a block and queries of a block; both bound what one task holds.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 512


def quantised(vector: Column) -> Column:
    """Integer components, null for a vector that takes no part."""
    parts = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, parts)


class SortedBlock:
    """A block's vectors with the rank of every component in its dimension's list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        at = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, at, axis=0)
        self.rank = np.empty_like(at)
        np.put_along_axis(self.rank, at, np.arange(len(ids))[:, None], axis=0)

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all rows for queries split into positive and negative components."""
        n = len(self.ids)
        high, low = self.rank >= n - depth, self.rank < depth  # read so far, from the top and from the bottom
        known = up @ (self.vectors * high).T + down @ (self.vectors * low).T
        first, last = self.sorted[0], self.sorted[-1]  # the worst of a list read from the top, and from the bottom
        top, bottom = self.sorted[n - depth], self.sorted[depth - 1]
        lower = known + (up * first).sum(1)[:, None] - (up * first) @ high.T + (down * last).sum(1)[:, None] - (down * last) @ low.T
        upper = known + (up * top).sum(1)[:, None] - (up * top) @ high.T + (down * bottom).sum(1)[:, None] - (down * bottom) @ low.T
        return lower, upper

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id, and the ids and scores of its k best rows here by score, then id."""
        n, queries = len(self.ids), queries.astype(np.float64)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        waiting, depth = np.arange(len(queries)), min(n, max(k, n // 16, 1))
        while len(waiting):
            lower, upper = self.bounds(up[waiting], down[waiting], depth)
            own = self.ids[None, :] == query_ids[waiting][:, None]
            lower[own] = upper[own] = -np.inf
            place = min(k, n) - 1
            bar = -np.partition(-lower, place, axis=1)[:, place]
            open_rows = (upper >= bar[:, None]) & ~own
            done = (open_rows.sum(1) <= 4 * k) | (depth == n)
            for i in np.flatnonzero(done):
                rows = np.flatnonzero(open_rows[i])
                scores = self.vectors[rows] @ queries[waiting[i]]
                pick = np.lexsort((self.ids[rows], -scores))[:k]
                yield query_ids[waiting[i]], self.ids[rows[pick]], scores[pick]
            waiting, depth = waiting[~done], min(n, depth * 2)


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Deals rows into blocks of about ``size``: (dim, block number, ids, components one after another)."""
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    blocks = F.lit(1)
    for dim, n in counts.items():
        blocks = F.when(F.col("dim") == dim, F.lit(max(1, -(-n // size)))).otherwise(blocks)
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "parts"), blocks).cast("int"))
    grouped = dealt.groupBy("dim", name).agg(F.collect_list(F.struct("id", "parts")).alias("rows"))
    return grouped.select("dim", name, F.col("rows.id").alias(f"{name}_ids"), F.flatten("rows.parts").alias(f"{name}_parts"))


def top_k(vectors: DataFrame, query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of each query's ``k`` best rows; ``query`` picks the query rows of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("parts"), F.coalesce(query, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("parts").isNotNull()).withColumn("dim", F.size("parts"))
    data = _blocks(rows, BLOCK_ROWS, "block")
    once = rows.where("asked").groupBy("id").agg(F.min(F.struct("dim", "parts")).alias("least")).select("id", "least.*")
    asked = _blocks(once, BLOCK_QUERIES, "query")
    # A stated query set against all rows: each block of queries goes to each block of rows of its dimension.
    met = data.join(asked, "dim").repartition(F.col("dim"), F.col("block"), F.col("query"))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, block = None, None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if last != (row.dim, row.block):
                    ids = np.asarray(row.block_ids, np.int64)
                    last, block = (row.dim, row.block), SortedBlock(ids, np.asarray(row.block_parts, np.int64).reshape(len(ids), -1))
                query_ids = np.asarray(row.query_ids, np.int64)
                queries = np.asarray(row.query_parts, np.int64).reshape(len(query_ids), -1)
                found = list(block.best(query_ids, queries, k))
                if found:
                    yield pd.DataFrame({"query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]), "id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found]).astype(np.int64)})

    found = met.mapInPandas(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def top_k_query(spark: SparkSession, sf_dir: str, k: int = 5, every: int = 50) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % every == 0, k)
