"""The corpus pipeline: documents in, encoded documents out.

Each stage reads what the stage before it wrote, works on all of it, and passes on the columns of ``documents``; the
last one returns the piece ids and the text that they decode to. Rows leave where a stage's decision says so: texts in no
known language, all but one of each group of near copies, and texts that hold a benchmark item. Repeated lines leave their
texts.

Defined cases: rows with a null or empty text, or one without letters, leave with the first stage; rows with a null id
stay where their text may stay; of rows with equal id and text one stays; stages decide by the row's text, not by its id
alone; an empty table gives no rows; columns beyond id, text, lang and source are passed on up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from briefloom.llm.common import fresh_path, read_table
from briefloom.llm.decontamination import without_leaks
from briefloom.llm.jaccard_join import one_of_each
from briefloom.llm.language_id import keep_identified
from briefloom.llm.line_dedup import without_repeated_lines
from briefloom.llm.registry import tokenizer_file
from briefloom.llm.sentencepiece_codec import encode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, tokenizer_file("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"), decoded=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language ID, WAND retrieval and BPE have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
