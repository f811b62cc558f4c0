"""Language identification: words first, then shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word falls back to its character n-grams of five
symbols, and if none of them is known to four, three, two and one; the mean of the known ones is added. The language
with the highest sum wins; its score is the softmax of the mean word evidence, counted for at most ``EVIDENCE`` words.

The model is fitted on a bounded sample of labelled rows: ``sample`` rows a language on average, picked by a hash of the
id. All of the sample's words and n-grams that occur twice are kept, so the sample bounds the model.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0, as is every text when no row is
labelled; evidence for none of the languages gives the first language by name with 1 / number of languages; equal sums
go to the first name; texts are used whole; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import crc_bucket, read_table, text_slices, tidy

WORD = re.compile(r"[^\W\d_]+")
LONGEST, EVIDENCE, SMOOTHING, MEMO_WORDS, SLICE = 5, 12, 0.5, 250_000, 2 << 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class BackoffModel:
    """Log frequencies by language: words and n-grams name rows of one matrix."""

    def __init__(self, languages: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray):
        self.languages, self.words, self.grams, self.table = languages, words, grams, table

    @classmethod
    def fit(cls, counts: Iterable[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]) -> BackoffModel:
        """``counts``: (language, kind, item, n) with kind 0 for words and else the n-gram's length."""
        languages = sorted({language for language, _ in totals})
        place = {language: i for i, language in enumerate(languages)}
        rows: tuple[dict[str, int], dict[str, int]] = ({}, {})
        cells, kinds = [], []
        for language, kind, item, n in counts:
            at = rows[kind > 0].setdefault(item, len(kinds))
            if at == len(kinds):
                kinds.append(kind)
            cells.append((at, place[language], n))
        table = np.zeros((len(kinds), len(languages)))
        if cells:
            at, language, n = zip(*cells, strict=True)
            table[list(at), list(language)] = n
        kinds = np.array(kinds, np.int64)
        for kind in set(kinds.tolist()):
            own = kinds == kind
            size = np.array([totals.get((language, kind), 0) for language in languages]) + SMOOTHING * (own.sum() + 1)
            table[own] = np.log((table[own] + SMOOTHING) / size)
        return cls(languages, *rows, table)

    def evidence(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word, or the mean of its longest known n-grams; None without evidence."""
        if (known := self.words.get(word)) is not None:
            return self.table[known]
        for n in range(LONGEST, 0, -1):
            rows = [row for g in grams_of(word, n) if (row := self.grams.get(g)) is not None]
            if rows:
                return self.table[rows].mean(axis=0)
        return None


class Predictor:
    """Scores batches of texts; remembers the evidence of a bounded number of words as rows of one matrix."""

    def __init__(self, model: BackoffModel):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        width = len(self.model.languages)
        # Rows 0 and 1 hold words without a letter and words without evidence.
        self.table, self.used = np.zeros((1 << 16, width + 1)), 2

    def learn(self, words: set[str]) -> None:
        for word in words:
            if not any(map(str.isalpha, word)):
                self.row[word] = 0
            elif (found := self.model.evidence(word)) is None:
                self.row[word] = 1
            else:
                if self.used == len(self.table):
                    self.table = np.vstack([self.table, np.zeros_like(self.table)])
                self.table[self.used, :-1], self.table[self.used, -1] = found, 1
                self.row[word], self.used = self.used, self.used + 1

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        split = [words_of(t) for t in texts]
        if len(self.row) > MEMO_WORDS:
            self.reset()
        self.learn(set().union(*split).difference(self.row))
        sizes = np.array([len(w) for w in split])
        rows = np.fromiter((r for words in split for r in map(self.row.__getitem__, words)), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        sums = np.zeros((len(texts), self.table.shape[1]))
        filled = np.flatnonzero(sizes)
        letters = np.zeros(len(texts), bool)
        if len(filled):
            sums[filled] = np.add.reduceat(self.table[rows], starts[filled], axis=0)
            letters[filled] = np.maximum.reduceat(rows, starts[filled]) > 0
        if not self.model.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        totals, n = sums[:, :-1], sums[:, -1]
        best = np.argmax(totals, axis=1)
        scaled = totals * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        scaled -= scaled.max(axis=1, keepdims=True)
        score = 1 / np.exp(scaled).sum(axis=1)
        return [self.model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def fit_language_model(labelled: DataFrame, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BackoffModel:
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    part = F.lit(1.0)
    for language, n in sizes.items():
        part = F.when(F.col("_lang") == language, F.lit(min(1.0, sample / n))).otherwise(part)
    picked = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < part * 1_000_000)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text", SLICE):
            words: dict[str, Counter] = defaultdict(Counter)
            for language, text in zip(batch["_lang"].to_pylist(), batch["_text"].to_pylist(), strict=True):
                words[language].update(words_of(text))
            for language, counter in words.items():
                tables = {0: counter} | {n: Counter() for n in range(1, LONGEST + 1)}
                for word, times in counter.items():
                    for n in range(1, LONGEST + 1):
                        for gram in grams_of(word, n):
                            tables[n][gram] += times
                for kind, table in tables.items():
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(table)), pa.array([kind] * len(table), pa.int32()), pa.array(list(table)), pa.array(list(table.values()), pa.int64())], ["lang", "kind", "item", "n"])

    counts = picked.mapInArrow(tidy(count), "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).persist()
    totals = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    model = BackoffModel.fit(counts.where("n > 1").select("lang", "kind", "item", "n").toLocalIterator(), totals)
    counts.unpersist()
    return model


def predict_languages(rows: DataFrame, model: BackoffModel, column: str, field: int | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``rows``, which must not have columns of these names; texts are in ``column``, or in that field of it."""
    shared = rows.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams, model.table))  # bounded by the model's sample

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = None
        for batch in text_slices(batches, column, SLICE, field):
            predictor = predictor or Predictor(BackoffModel(*shared.value))
            texts = batch[column] if field is None else pc.struct_field(batch[column], [field])
            names, scores = predictor.predict([t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(tidy(predict), f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return crc_bucket(id_col, 4) == 2


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Id, held_out, lang_pred and score of every row; learns from rows that are not held out."""
    model = fit_language_model(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    scored = predict_languages(rows, model, "_text")
    return scored.select(F.col("_id").alias(id_col), "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more, with the columns of ``docs``."""
    model = fit_language_model(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    scored = predict_languages(docs.select(F.struct("*").alias("_row")), model, "_row", docs.columns.index(text_col))
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))
