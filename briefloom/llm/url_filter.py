"""URL filter: rules first, then the ratio of two character language models.

A rule names a host and a path. It fits its host and all subdomains when the URL's path starts with the rule's path; of
the rules that fit, the longest one decides. URLs without a rule are judged by two smoothed variable-order Markov models
over the bytes of host and path: one learns from URLs that a rule allows, the other from those that a rule blocks. The
verdict is the length-normalised difference of their log-likelihoods against a threshold that is calibrated on a fifth
of the ruled URLs, which the models do not learn from.

The models count all n-grams of all ruled URLs (per task first, then by n-gram) and keep an n-gram once it makes up at
least ``share`` of its class's n-grams of that length and occurs twice. At most 1 / share n-grams of a length can do so,
whatever the input, which bounds what is sent to the driver and to the tasks.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and is judged by the models;
without any ruled URL both models are uniform and every URL is allowed; repeated rows each get a row; an empty table
gives no rows; columns other than the id and the URL are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import byte_texts, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
#: A rule list longer than this belongs into a joined table, not into one expression.
MOST_RULES = 1000
#: Bins of the score's histogram, from -SPAN to SPAN nats a byte.
BINS, SPAN = 400, 4.0

Rule = tuple[str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substr(text, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null without one; of equal rules the first counts."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} go into one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


class MarkovModel:
    """Witten-Bell smoothing from the longest known context down to a uniform choice among 257 symbols."""

    def __init__(self, counts: dict[str, int], order: int):
        self.order = order
        self.counts = counts
        self.totals: dict[str, int] = defaultdict(int)
        self.kinds: dict[str, int] = defaultdict(int)
        for gram, n in counts.items():
            self.totals[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1
        self.memo: dict[str, float] = {}

    def probability(self, context: str, symbol: str) -> float:
        while context and context not in self.totals:
            context = context[1:]
        p, at = 1 / 257, len(context)
        for start in range(at, -1, -1):
            ctx = context[start:]
            if total := self.totals.get(ctx, 0):
                kinds = self.kinds[ctx]
                p = (self.counts.get(ctx + symbol, 0) + kinds * p) / (total + kinds)
        return p

    def log_likelihood(self, text: str) -> float:
        total, padded, memo = 0.0, START + text + END, self.memo
        for i in range(1, len(padded)):
            gram = padded[max(0, i - self.order) : i + 1]
            value = memo.get(gram)
            if value is None:
                if len(memo) > 500_000:
                    memo.clear()
                value = memo[gram] = math.log(self.probability(gram[:-1], gram[-1]))
            total += value
        return total


def grams(text: str, order: int) -> Iterator[str]:
    """All n-grams of 1 to order + 1 symbols, without those that end in the start mark."""
    padded = START + text + END
    for i in range(1, len(padded)):
        for n in range(min(order, i) + 1):
            yield padded[i - n : i + 1]


def _symbols(text: bytes) -> str:
    return text.decode("latin-1")


def count_grams(labelled: DataFrame, order: int, share: float) -> dict[str, dict[str, int]]:
    """Kept n-grams by verdict, from all rows of (verdict, body)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            for verdict, body in zip(batch["verdict"].to_pylist(), byte_texts(batch["body"]), strict=True):
                found[verdict].update(grams(_symbols(body), order))
            for verdict, counter in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([verdict] * len(counter)), pa.array(list(counter)), pa.array(list(counter.values()), pa.int64())], ["verdict", "gram", "n"])

    counts = labelled.mapInArrow(count, "verdict string, gram string, n long").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("size", F.length("gram")).persist()
    totals = {(r["verdict"], r["size"]): r["n"] for r in counts.groupBy("verdict", "size").agg(F.sum("n").alias("n")).collect()}
    least = F.lit(2)
    for (verdict, size), n in totals.items():
        least = F.when((F.col("verdict") == verdict) & (F.col("size") == size), F.lit(max(2, math.ceil(share * n)))).otherwise(least)
    out: dict[str, dict[str, int]] = {"allow": {}, "block": {}}
    for row in counts.where(F.col("n") >= least).select("verdict", "gram", "n").toLocalIterator():
        out[row["verdict"]][row["gram"]] = row["n"]
    counts.unpersist()
    return out


def with_scores(rows: DataFrame, models, order: int) -> DataFrame:
    """Adds ``score``, nats a byte in favour of allowing, to rows of (_key, body)."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow, block = (MarkovModel(models.value[v], order) for v in ("allow", "block"))
        for batch in batches:
            values = [(allow.log_likelihood(s) - block.log_likelihood(s)) / (len(s) + 1) for s in map(_symbols, byte_texts(batch["body"]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(score, f"{fields}, score double")


def calibrated_threshold(scored: DataFrame) -> float:
    """The bin edge with the least sum of both classes' error shares on rows of (verdict, score); 0 if a class is missing."""
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))))).cast("int")
    counts: dict[str, list[int]] = {"allow": [0] * BINS, "block": [0] * BINS}
    for row in scored.groupBy("verdict", at.alias("at")).count().collect():
        counts[row["verdict"]][row["at"]] = row["count"]
    allowed, blocked = sum(counts["allow"]), sum(counts["block"])
    if not allowed or not blocked:
        return 0.0
    errors, lost, passed = [], 0, blocked
    for i in range(BINS + 1):
        errors.append(lost / allowed + passed / blocked)
        if i < BINS:
            lost, passed = lost + counts["allow"][i], passed - counts["block"][i]
    least = min(errors)
    best = [i for i, e in enumerate(errors) if e == least]
    return best[len(best) // 2] * (2 * SPAN / BINS) - SPAN


def filter_urls(pages: DataFrame, rules: list[Rule], order: int = 5, share: float = 1e-5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Id, host, path, rule, verdict and score (null where a rule decides). The models are learnt when this is called."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("_key"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = parts.withColumns({"rule": rule, "verdict": verdict}).withColumn("body", F.concat("host", "path"))
    ruled = rows.where(F.col("verdict").isNotNull()).select("verdict", "body")
    held_out = F.pmod(F.xxhash64("body"), F.lit(5)) == 0
    models = spark.sparkContext.broadcast(count_grams(ruled.where(~held_out), order, share))
    threshold = calibrated_threshold(with_scores(ruled.where(held_out), models, order))
    open_rows = with_scores(rows.where(F.col("verdict").isNull()), models, order)
    judged = open_rows.withColumn("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    done = rows.where(F.col("verdict").isNotNull()).withColumn("score", F.lit(None).cast("double"))
    return done.unionByName(judged).select(F.col("_key").alias(id_col), "host", "path", "rule", "verdict", "score")


def url_filter_query(spark: SparkSession, sf_dir: str, rules: list[Rule]) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), rules)
