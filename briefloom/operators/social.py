"""Social posts: threads become one item, hard filters name a reason, scores route, caps bound what an account gets."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import scoring
from briefloom.functions.article import stripped

# Kinds of references, and the counts that engagement is made of.
REFERENCES = {"retweet": "retweeted", "reply": "replied_to", "quote": "quoted"}
ENGAGEMENT = ("likes", "replies", "reposts", "quotes", "bookmarks")


# What stands between the posts of a thread, and the longest title with the mark of a longer one.
BETWEEN_POSTS, TITLE_CHARS, TITLE_CUT = "\n\n---\n\n", 117, "..."


def thread_item(posts: Column) -> dict[str, Column]:
    """What an item says of a thread, from its posts as an array of (place, is_root, id, text, created, ...) in their order.

    Texts are stripped, and blank ones left out; the title is the first text on one line. The root is the post that the
    conversation is named after, or else the first.
    """
    texts = F.filter(F.transform(posts, lambda p: stripped(p["text"])), lambda t: t != "")
    line = stripped(F.regexp_replace(F.get(texts, F.lit(0)), r"(?U)\s+", " "))
    roots = F.filter(posts, lambda p: F.coalesce(p["is_root"], F.lit(False)))
    root = F.coalesce(F.get(roots, F.lit(0)), F.get(posts, F.lit(0)))
    return {
        "title": F.concat(F.left(line, F.lit(TITLE_CHARS)), F.when(F.length(line) > TITLE_CHARS, TITLE_CUT).otherwise("")),
        "body": F.array_join(texts, BETWEEN_POSTS),
        "thread_count": F.size(posts).cast("long"),
        "root_id": root["id"],
        "published_raw": root["created"],
    }


def merge_threads(posts: DataFrame, thread: str, place: str, text: str, post_id: str | None = None, created: str | None = None, references: str | None = None, edits: str | None = None, sums: list[str] = ()) -> DataFrame:
    """One row a thread, with its texts in order; threads without any text are left out.

    A post without a thread is one of its own, under its id.

    ``post_id`` names the id that the thread of a root carries (default: the place); ``references`` is an array of the kinds of
    posts that a post refers to, ``edits`` an array of ids with the first version of a post in front; ``sums`` are added up,
    null as nothing. With likes, replies, reposts, quotes and bookmarks among them, ``engagement`` weighs them.
    """
    own = F.col(post_id or place)
    posts = posts.withColumn("_thread", F.coalesce(F.when(F.col(thread).cast("string") != "", F.col(thread)), own.cast(posts.schema[thread].dataType)))
    name = F.col("_thread").cast("string")
    columns = {"place": F.col(place), "is_root": own.cast("string") == name, "id": own, "text": F.col(text), "created": F.col(created) if created else F.lit(None).cast("string")}
    columns["first_id"] = F.coalesce(F.nullif(F.get(F.col(edits), F.lit(0)).cast("string"), F.lit("")), own.cast("string")) if edits else own.cast("string")
    kinds = F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(references), F.array().cast("array<string>"))))) if references else F.array().cast("array<string>")
    rows = posts.where(name.isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct(*[c.alias(k) for k, c in columns.items()])))
    merged = rows.groupBy(F.col("_thread").alias(thread)).agg(ordered.alias("_posts"), kinds.alias("_kinds"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums])
    item = thread_item(F.col("_posts"))
    roots = F.filter("_posts", lambda p: F.coalesce(p["is_root"], F.lit(False)))
    first_id = F.coalesce(F.get(roots, F.lit(0)), F.get("_posts", F.lit(0)))["first_id"]
    flags = {f"is_{kind}": F.array_contains("_kinds", value) for kind, value in REFERENCES.items()} if references else {}
    weighed = {"engagement": scoring.engagement(*map(F.col, ENGAGEMENT))} if set(ENGAGEMENT) <= set(sums) else {}
    out = merged.select(thread, *[c.alias(k) for k, c in item.items()], first_id.alias("canonical_id"), *[c.alias(k) for k, c in flags.items()], *sums, *[c.alias(k) for k, c in weighed.items()])
    return out.where("body <> ''")


def hard_reason(text: Column, body: Column, is_retweet: Column, is_reply: Column, thread: Column, has_media: Column, exclude_replies: Column, least_chars: Column) -> Column:
    """retweet, lone reply, noise without signal or evidence, short without evidence; else null."""
    strong = text.rlike(scoring.STRONG)
    evidence = text.rlike(scoring.LINKED) | F.coalesce(has_media, F.lit(False)) | (thread > 1)
    return (
        F.when(F.coalesce(is_retweet, F.lit(False)), "retweet")
        .when(F.coalesce(exclude_replies, F.lit(True)) & F.coalesce(is_reply, F.lit(False)) & (thread <= 1), "reply")
        .when(text.rlike(scoring.NOISE) & ~strong & ~evidence, "noise")
        .when((F.length(F.trim(body)) < F.coalesce(F.nullif(least_chars, F.lit(0)), F.lit(30))) & ~evidence, "short")
    )


def route(score: Column, direct: int = 70, borderline: int = 45) -> Column:
    return F.when(score >= direct, "direct").when(score >= borderline, "borderline").otherwise("low")


def newest_id(ids: Column) -> Column:
    """The greatest of numeric ids that are kept as text."""
    return F.max(ids.try_cast("decimal(20,0)")).cast("string")


def nearest(items: DataFrame, corpus: DataFrame, block: int = 256, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, similarity) of the corpus text that is most alike by sequence ratio, other than the item's own; null without one.

    The items are a stated set. Blocks of items meet blocks of distinct corpus texts; a block states one number an item. In a
    block, the characters that two texts have in common bound their ratio, for all pairs at once; an item is compared in the
    order of its bounds and only while a bound is above what it has found. Items of null or blank text have no similarity.
    """
    short = F.left(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "), F.lit(800))
    texts = corpus.select(F.col(id_col).alias("own"), short.alias("t")).where(F.coalesce("t", F.lit("")) != "")
    texts = texts.groupBy("t").agg(F.slice(F.collect_set("own"), 1, 2).alias("owners"))  # a text of two rows is not an item's own only
    asked = items.select(F.col(id_col).alias("id"), short.alias("t"))
    known = asked.where(F.coalesce("t", F.lit("")) != "")
    counts = [max(1, -(-rows.count() // block)) for rows in (known, texts)]
    deal = lambda rows, n: F.pmod(F.xxhash64("t"), F.lit(n)).cast("int")
    left = known.withColumns({"x": deal(known, counts[0]), "y": F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1)))})
    right = texts.withColumns({"y": deal(texts, counts[1]), "x": F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1)))})

    def best(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = [_most_alike(i, t, others, bounds) for i, t, bounds in zip(some["id"], some["t"], _ratio_bounds(list(some["t"]), list(others["t"])), strict=True)]
        return pd.DataFrame({"id": some["id"], "similarity": found})

    kind = items.schema[id_col].dataType.simpleString()
    met = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(best, f"id {kind}, similarity double")
    most = met.groupBy("id").agg(F.max("similarity").alias("similarity"))
    return asked.select("id").distinct().join(most, "id", "left")


def _ratio_bounds(some: list[str], others: list[str]) -> np.ndarray:
    """For each text and each other one, a number that their ratio does not exceed."""
    place = {c: k for k, c in enumerate(sorted(set("".join(some)) | set("".join(others))))}
    counts = []
    for texts in (some, others):
        table = np.zeros((len(texts), len(place)), np.int16)
        for row, text in zip(table, texts, strict=True):
            for c, n in Counter(text).items():
                row[place[c]] = n
        counts.append(table)
    sizes = [np.array([max(1, len(t)) for t in texts]) for texts in (some, others)]
    common = np.array([np.minimum(row, counts[1]).sum(1) for row in counts[0]]).reshape(len(some), len(others))
    return 2 * common / (sizes[0][:, None] + sizes[1][None, :])


def _most_alike(own: object, text: str, others: pd.DataFrame, bounds: np.ndarray) -> float | None:
    top = None
    for k in np.argsort(-bounds, kind="stable"):
        if top is not None and bounds[k] <= top:
            break
        owners = others["owners"].iloc[k]
        if len(owners) > 1 or list(owners) != [own]:
            top = max(top or 0.0, SequenceMatcher(None, text, others["t"].iloc[k]).ratio())
    return top
