"""Selection of the daily set under interacting quotas, its repair for a least number of videos, and the final rank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.config import Quotas

PRIORITY_RANK = {"P0": 0, "P1": 1, "P2": 2}


def priority_rank(priority: Column) -> Column:
    out = F.lit(3)
    for name, rank in PRIORITY_RANK.items():
        out = F.when(priority == name, rank).otherwise(out)
    return out


def pick(pool: list[dict], quotas: Quotas, non_p0: int) -> list[int]:
    """Places of the picked items of an ordered pool: an item is skipped when any quota that it would use is full."""
    limits = {"论文": quotas.papers, "视频": quotas.videos, "播客": quotas.podcasts, "Github热榜": quotas.repos, "arxiv": quotas.arxiv, "P0": max(0, quotas.total - min(quotas.reserve, non_p0))}
    used: dict[str, int] = {}
    out: list[int] = []
    for i, item in enumerate(pool):
        if len(out) >= quotas.total:
            break
        wanted = [k for k in (item["content_type"], "arxiv" if item["is_arxiv"] else None, "P0" if item["priority"] == "P0" else None) if k in limits]
        source = f"source:{item['source_id']}"
        if any(used.get(k, 0) >= limits[k] for k in wanted) or used.get(source, 0) >= quotas.per_source:
            continue
        for k in (*wanted, source):
            used[k] = used.get(k, 0) + 1
        out.append(i)
    return out


def select_candidates(items: DataFrame, quotas: Quotas, id_col: str = "doc_id") -> DataFrame:
    """The greedy selection over all items in the order priority, quality (arXiv at .7), time, id; adds ``pick``.

    Items need: id, source_id, priority, content_type, is_arxiv, quality, published_ms. The walk itself is sequential,
    so it gets a pool of bounded size: items of one source and one class are alike to all quotas, so only the first
    ``per_source`` of them can be picked; and of a class at most ``total`` are picked and at most as many skipped for a
    full source, so only the first twice ``total`` can be. The pool's size depends on the quotas alone.
    """
    effective = F.col("quality") * F.when(F.col("is_arxiv"), 0.7).otherwise(1.0)
    order = [F.col("_rank"), F.desc("_effective"), F.desc("published_ms"), F.col(id_col)]
    rows = items.withColumn("_rank", priority_rank(F.col("priority"))).withColumn("_effective", F.coalesce(effective, F.lit(0.0)))
    classes = ["content_type", "is_arxiv", "priority"]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source_id", *classes).orderBy(*order))).where(F.col("_n") <= quotas.per_source)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*classes).orderBy(*order))).where(F.col("_n") <= 2 * quotas.total)
    others = items.agg(F.count_if(F.col("priority") != "P0").alias("_non_p0"))
    names = items.columns

    def walk(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["_rank", "_effective", "published_ms", id_col], ascending=[True, False, False, True], kind="stable")
        places = pick(pool.to_dict("records"), quotas, int(pool["_non_p0"].iloc[0]))
        out = pool.iloc[places][names].copy()
        out["pick"] = range(1, len(out) + 1)
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", pick long"
    return rows.crossJoin(F.broadcast(others)).withColumn("_pool", F.lit(1)).groupBy("_pool").applyInPandas(walk, schema)  # one row of one number is broadcast


def balance(ranked: DataFrame, most: int, kind: Column, least: int, rank: str) -> DataFrame:
    """The first ``most`` rows by rank with at least ``least`` of a kind, as far as there are any; adds ``place``.

    The best ``least`` of the kind have a place in any case, the others compete for what is left; rank order stays.
    """
    nth = F.row_number().over(Window.partitionBy("_kind").orderBy(rank))
    rows = ranked.withColumn("_kind", F.coalesce(kind, F.lit(False))).withColumn("_sure", F.col("_kind") & (nth <= min(least, most)))
    chosen = rows.orderBy(F.desc("_sure"), rank).limit(most)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(rank)).cast("long")).drop("_kind", "_sure")


def final_order(quality: str, weight: Column, parts: list[str], tie: str) -> list:
    """Sort columns of the final rank: quality, then the weighted parts, all descending, then a tie breaker."""
    return [F.desc(F.coalesce(F.col(quality), F.lit(0.0)) * weight), *[F.desc(F.coalesce(F.col(p), F.lit(0)) * weight) for p in parts], F.col(tie)]


def capped_with_carry(rows: DataFrame, group: str, already: DataFrame, most: Column, order: list) -> DataFrame:
    """Rows of a group up to its cap, counting what the group has stored already: (group, stored) in ``already``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    met = rows.join(already, group, "left").withColumn("_place", F.coalesce("stored", F.lit(0)) + rank)
    return met.where(F.col("_place") <= most).drop("_place", "stored")


def repo_list(repos: DataFrame, most: int, order: list, is_new: Column) -> DataFrame:
    """The first repositories by score, of which at most three tenths, and one at least, are new."""
    nth = F.row_number().over(Window.partitionBy("_new").orderBy(*order))
    rows = repos.withColumn("_new", F.coalesce(is_new, F.lit(False))).withColumn("_nth", nth)
    return rows.where(~F.col("_new") | (F.col("_nth") <= max(1, round(0.3 * most)))).orderBy(*order).limit(most).drop("_new", "_nth")
