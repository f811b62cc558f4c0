"""Benchmark decontamination: BM25 retrieval by block-max WAND, then overlap of question and answer.

The index holds the test items: for each term its postings in the order of items, in blocks with their highest impact.
An impact is a term's BM25 weight in an item as a share of the item's score for its own terms, so one threshold on the
share serves items of all lengths. The training texts are the queries: each text is cut into passages of two cells, a
cell being as long as the longest item, so that every run of an item's length lies within a passage.

Pivot test for all passages at once. Each item's terms are taken from the highest impact on until those left sum up to
less than half the threshold; these are its leading terms. A passage's score for an item is at most the impacts of its
leading terms there plus what is left, so passages without an item that can reach the threshold that way are done. The
others are searched by block-max WAND, one item after another, and every item at or above the threshold is retrieved.

A retrieved pair of document and item is verified on the whole text: of the five-word shingles of the item's question,
and of those of its answer, a share of ``OVERLAP`` or more must occur. The answer is an item's last line, or the last
sentence of a single line; a part of fewer than five words has its word sequence as its only shingle.

The index is broadcast in shards of at most ``SHARD_TERMS`` postings, each of which meets all texts, so its size has a
bound whatever the number of items.

Defined cases: words are split at white space and ASCII punctuation, with A-Z lower-cased; texts and items that are null
or without words match nothing; equal items are one, and an id with several texts is several items; texts are used whole;
repeated documents each count; empty tables on either side give no rows; other columns do not matter.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import byte_texts, read_table, text_slices, tidy

K1, B = 1.2, 0.75
SHARE, OVERLAP, SHINGLE = 0.5, 0.8, 5
BLOCK, SHARD_TERMS = 16, 2_000_000

_TABLE = bytes.maketrans(string.punctuation.encode() + string.ascii_uppercase.encode(), b" " * len(string.punctuation) + string.ascii_lowercase.encode())


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def question_and_answer(text: str) -> tuple[str, str]:
    lines = [line for line in text.split("\n") if line.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    body = lines[0].strip() if lines else ""
    cut = body.rstrip(".!? ").rfind(". ")
    return (body[: cut + 1], body[cut + 1 :]) if cut >= 0 else (body, "")


def shingles_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} or ({tuple(words)} if words else set())


def overlap(part: list[bytes], text: list[bytes]) -> float:
    """Share of a part's shingles that occur in a text; 1 for a part without words."""
    wanted = shingles_of(part)
    if not wanted:
        return 1.0
    size = min(SHINGLE, len(part))
    return len(wanted & {tuple(text[i : i + size]) for i in range(len(text) - size + 1)}) / len(wanted)


class BlockMaxIndex:
    """Postings of normalised impacts in blocks; items are numbered from 0."""

    def __init__(self, postings: Iterable[tuple[int, bytes, int, int, int]], n_items: int, mean_length: float, total_items: int):
        """``postings``: item, term, times in the item, the item's length, number of items with the term."""
        raw: dict[int, dict[bytes, float]] = defaultdict(dict)
        for item, term, times, length, holders in postings:
            idf = math.log(1 + (total_items - holders + 0.5) / (holders + 0.5))
            raw[item][term] = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * length / mean_length))
        self.n_items = n_items
        self.lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.leading: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.rest = np.zeros(n_items)
        for item in sorted(raw):
            total = sum(raw[item].values())
            left = 1.0
            for term, weight in sorted(raw[item].items(), key=lambda x: (-x[1], x[0])):
                impact = weight / total
                self.lists[term].append((item, impact))
                if left >= SHARE / 2:
                    self.leading[term].append((item, impact))
                    left -= impact
            self.rest[item] = left
        self.most = {t: max(w for _, w in p) for t, p in self.lists.items()}
        #: By term: the last item and the highest impact of each block.
        self.blocks = {t: [(p[i : i + BLOCK][-1][0], max(w for _, w in p[i : i + BLOCK])) for i in range(0, len(p), BLOCK)] for t, p in self.lists.items()}

    def search(self, terms: Iterable[bytes], least: float) -> dict[int, float]:
        """All items with a score of ``least`` or more for a set of terms, by block-max WAND."""
        # A cursor: [item, place in the list, place in the blocks, term]; rounding must not lose an item at the bar.
        cursors = [[self.lists[t][0][0], 0, 0, t] for t in sorted(set(terms)) if t in self.lists]
        found, bar = {}, least - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, cursor in enumerate(cursors):
                bound += self.most[cursor[3]]
                if bound >= bar:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, ends = 0.0, []
            for cursor in cursors[: pivot + 1]:
                blocks = self.blocks[cursor[3]]
                while cursor[2] < len(blocks) and blocks[cursor[2]][0] < item:
                    cursor[2] += 1
                if cursor[2] < len(blocks):
                    bound += blocks[cursor[2]][1]
                    ends.append(blocks[cursor[2]][0])
            if bound < bar:
                # No item up to the first block's end can reach the bar; the next list may begin before that.
                to = min([e + 1 for e in ends] + [c[0] for c in cursors[pivot + 1 : pivot + 2]] or [item + 1])
                self._advance(cursors[: pivot + 1], max(to, item + 1))
            elif cursors[0][0] == item:
                score = sum(self.lists[c[3]][c[1]][1] for c in cursors[: pivot + 1])
                if score >= bar:
                    found[item] = score
                self._advance(cursors[: pivot + 1], item + 1)
            else:
                self._advance([c for c in cursors[:pivot] if c[0] < item], item)
            cursors = [c for c in cursors if c[1] < len(self.lists[c[3]])]
        return found

    def _advance(self, cursors: list[list], item: int) -> None:
        for cursor in cursors:
            postings, blocks = self.lists[cursor[3]], self.blocks[cursor[3]]
            while cursor[2] < len(blocks) and blocks[cursor[2]][0] < item:
                cursor[2] += 1
            at = max(cursor[1], cursor[2] * BLOCK)
            while at < len(postings) and postings[at][0] < item:
                at += 1
            cursor[1] = at
            cursor[0] = postings[at][0] if at < len(postings) else -1


class PassageFilter:
    """The pivot test over the passages of many texts at once."""

    def __init__(self, index: BlockMaxIndex, cell: int):
        self.index, self.cell = index, cell
        self.ids = {t: i for i, t in enumerate(index.leading)}
        lists = list(index.leading.values())
        self.sizes = np.array([len(p) for p in lists] or [0], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.items = np.array([i for p in lists for i, _ in p], np.int64)
        self.impacts = np.array([w for p in lists for _, w in p])

    def open_passages(self, texts: list[list[bytes]]) -> list[tuple[int, int]]:
        """(text, cell) of passages in which some item may reach the threshold."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for words in texts for w in words), np.int64)
        counts = np.array([len(w) for w in texts], np.int64)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        text = np.searchsorted(np.cumsum(counts), at, side="right")
        cell = (at - (np.cumsum(counts) - counts)[text]) // self.cell
        passages = np.maximum(-(-counts // self.cell) - 1, 1)  # of each text; passage j holds cells j and j + 1
        first = np.cumsum(passages) - passages
        term = ids[at]
        n = self.sizes[term]
        post = np.repeat(self.begins[term], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        text, cell = np.repeat(text, n), np.repeat(cell, n)
        item, impact = self.items[post], self.impacts[post]
        both = [(cell, cell < passages[text]), (cell - 1, cell > 0)]
        key = np.concatenate([((first[text] + c) * self.index.n_items + item)[ok] for c, ok in both])
        mass = np.concatenate([impact[ok] for _, ok in both])
        keys, inverse = np.unique(key, return_inverse=True)
        reach = np.bincount(inverse, mass) + self.index.rest[keys % self.index.n_items]
        place = np.unique(keys[reach >= SHARE - 1e-9] // self.index.n_items)
        text = np.searchsorted(np.cumsum(passages), place, side="right")
        return list(zip(text.tolist(), (place - first[text]).tolist(), strict=True))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct items with words: (item_id, text, terms, shard key)."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [terms_of(t) for t in byte_texts(batch["text"])]
            keep = pa.array([bool(t) for t in terms])
            counts = [Counter(t) for t in terms if t]
            yield pa.RecordBatch.from_arrays(
                [*batch.filter(keep).columns, pa.array([sum(c.values()) for c in counts], pa.int64()), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                ["item_id", "text", "length", "terms", "times"],
            )

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"item_id {kind}, text string, length long, terms array<binary>, times array<long>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Id, item_id, score (the best passage's share), question_overlap and answer_overlap of every verified pair."""
    spark = docs.sparkSession
    items = _items(benchmark, item_col, item_text_col).persist()
    totals = items.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest"), F.sum(F.size("terms")).alias("terms")).first()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    id_kind, item_kind = rows.schema["_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out_schema = f"_id {id_kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], out_schema)
    shards = -(-(totals["terms"] or 0) // SHARD_TERMS)
    holders = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("holders"))
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        texts = sorted(((r["item_id"], r["text"]) for r in part.select("item_id", "text").toLocalIterator()), key=str)
        number = {key: i for i, key in enumerate(texts)}
        pairs = part.select("item_id", "text", "length", F.explode(F.arrays_zip("terms", "times")).alias("p")).select("item_id", "text", "length", F.col("p.terms").alias("term"), F.col("p.times").alias("times"))
        postings = [(number[r["item_id"], r["text"]], bytes(r["term"]), r["times"], r["length"], r["holders"]) for r in pairs.join(holders, "term").toLocalIterator()]
        index = BlockMaxIndex(postings, len(texts), totals["mean"], totals["n"])
        parts = [tuple(terms_of(p.encode()) for p in question_and_answer(text)) for _, text in texts]
        shared = spark.sparkContext.broadcast((index, [i for i, _ in texts], parts, max(16, totals["longest"])))
        found = found.unionByName(rows.mapInArrow(tidy(_searcher(shared)), out_schema))
    items.unpersist()
    return found.withColumnRenamed("_id", id_col)


def _searcher(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names, parts, cell = shared.value
        passages = PassageFilter(index, cell)
        for batch in text_slices(batches, "text", 2 << 20):
            texts = [terms_of(t) for t in byte_texts(batch["text"])]
            best: dict[tuple[int, int], float] = {}
            for text, at in passages.open_passages(texts):
                for item, score in index.search(texts[text][at * cell : (at + 2) * cell], SHARE).items():
                    best[text, item] = max(score, best.get((text, item), 0.0))
            rows = []
            for (text, item), score in best.items():
                question, answer = (overlap(p, texts[text]) for p in parts[item])
                if question >= OVERLAP and answer >= OVERLAP:
                    rows.append((text, names[item], score, question, answer))
            if rows:
                text, item, *values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch["_id"].take(pa.array(text)), pa.array(item), *[pa.array(v, pa.float64()) for v in values]], ["_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item, with the columns of ``docs``; rows with a null id stay."""
    leaks = find_leaks(docs, benchmark, id_col).select(F.col(id_col).alias("_leak")).where(F.col("_leak").isNotNull()).distinct()
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_leak"))
    return packed.join(leaks, "_leak", "left_anti").select("_row.*")


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
