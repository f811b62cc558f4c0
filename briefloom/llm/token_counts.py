"""Token counts through a digest cache.

A text's key is the SHA-256 of its content with runs of white space made one blank (the tokenizer drops white space
between words, so the count is the same) and the SHA-256 of the tokenizer's file with the library's version. Keys that
the cache lacks are made distinct before the text moves, each such text is encoded once, and its count is appended.

Within a task, a text is encoded word by word with a bounded memo of words: between words the tokenizer drops white
space and joins nothing across it. Texts that hold one of the tokenizer's special strings are encoded whole.

Defined cases: a null text is empty and has 0 tokens; repeated rows are each counted; an empty table gives no rows and
leaves the cache as it was; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import byte_texts, fresh_path, text_slices

#: Words that one Python worker remembers at most; beyond it, it forgets all and starts again.
MEMO_WORDS = 400_000
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"

_loaded: dict[str, tuple] = {}


def tokenizer_digest(source: str) -> str:
    """Names a tokenizer by the content of its file and the version of the library that reads it."""
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}\0{source}".encode()).hexdigest()


class WordCounter:
    """Counts tokens of whole texts as the library does, remembering the counts of words."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, int] = {}

    def count(self, texts: list[bytes]) -> list[int]:
        split = [text.split() for text in texts]
        missing = set().union(*split).difference(self.memo)
        if len(self.memo) + len(missing) > MEMO_WORDS:
            self.memo.clear()
            missing = set().union(*split)
        self._learn(missing)
        count = self.memo.__getitem__
        out = [sum(map(count, words)) for words in split]
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = len(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False))
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Letters with a full stop or a comma behind are encoded without it: it is a token of its own."""
        cores: dict[str, list[tuple[bytes, int]]] = {}
        for word in words:
            text = word.decode("utf-8", "replace")
            mark = text[-1] in ".," and text[:-1].isalpha()
            cores.setdefault(text[:-1] if mark else text, []).append((word, int(mark)))
        for core, encoded in zip(cores, self.library.encode_batch_fast(list(cores), add_special_tokens=False), strict=True):
            for word, more in cores[core]:
                self.memo[word] = len(encoded) + more


def _counter(source: str, digest: str) -> WordCounter:
    if digest not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded.clear()
        _loaded[digest] = WordCounter(source)
    return _loaded[digest]


def content_digest(text: Column) -> Column:
    """32 bytes that name a text up to runs of ASCII white space."""
    return F.unhex(F.sha2(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), 256))


def count_tokens(docs: DataFrame, tokenizer_file: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_bytes, content_digest and n_tokens of every row of ``docs``; ``cache_path`` is a Parquet folder, made if missing.

    What the cache has is not encoded again. The function runs the encoding job at once, so that the cache is complete
    when it returns; the frame it returns reads the counts from the cache.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as file:
        source = file.read()
    digest = tokenizer_digest(source)
    shared = spark.sparkContext.broadcast(source)  # one tokenizer file, whatever the input

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), content_digest(text).alias("content_digest"))
    wanted = keyed.select("content_digest", "_text")
    if (cache := read_cache(spark, cache_path)) is not None:
        known = cache.where(F.col("tokenizer_digest") == digest).select("content_digest")
        wanted = wanted.join(known, "content_digest", "left_anti")
    misses = wanted.groupBy("content_digest").agg(F.first("_text").alias("_text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for part in text_slices(batches, "_text"):
            counter = counter or _counter(shared.value, digest)
            counts = counter.count(byte_texts(part["_text"]))
            yield pa.RecordBatch.from_arrays([part["content_digest"], pa.array([digest] * len(counts)), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == digest)
    if not counts.groupBy("content_digest").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        # Runs at the same time may append the same key. Without such keys the join below has plain sides, so that Spark
        # can split the partition of a text with very many copies.
        counts = counts.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = keyed.select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), "content_digest")
    out = rows.join(counts, "content_digest", "left")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "content_digest", "n_tokens")


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_count_query(spark: SparkSession, sf_dir: str, tokenizer_file: str, limit: int = 2048) -> DataFrame:
    """The query starts from an empty cache in a folder of its own, so that it always counts every text itself."""
    from briefloom.llm.common import read_table

    counted = count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file, fresh_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
