"""Language-model scoring with a weighted backoff automaton.

The model. Every n-gram of up to ``order`` words that occurs ``least`` times or more in the training texts is an arc, and
every one that is extended by such an arc is a state; all words, however rare, are arcs of the root. Counts are discounted
by one half, and what a state's arcs leave is the weight of its failure arc, which leads to the state without the first
word. An arc's probability is its discounted share plus that weight times the probability behind the failure arc, so
each state's probabilities sum to one. The number of states and arcs grows with the corpus, so the model is never in one
place: ``Automaton`` is its sequential form, for small models and tests.

Blocks. Each task cuts its texts into blocks of about ``BLOCK_BYTES``, whose words are numbered. A block keys its distinct
words by 64 bits of a digest, and longer n-grams by the leading bits of one, ``MORE_BITS`` more than number all tokens; of
the n-grams about one in 2**MORE_BITS shares a key with another one and is counted with it, words do not. Exchanges
between blocks and ranges of keys give a block what its texts need:

1. a block sends the training counts of its n-grams, a range adds them up and sends back the corpus counts. Words and
   pairs come first; a longer n-gram is only sent if both its parts are known to occur ``least`` times;
2. of the blocks that hold an n-gram, the first adds its discounted count, in halves, to its context; a range adds these
   up and sends back the sum, from which a block has the weight;
3. a block sums the logs along each text's path.

Defined cases: a null or empty text is the end mark alone; words are compared as bytes with A-Z lower-cased; a word
unseen in training has count 0; without training texts every token has probability 1 / (0.1 * (0 + 1)) * 0.1 = 1;
repeated rows each get a row; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import byte_texts, crc_bucket, mix64, read_table, text_slices, written
from briefloom.llm.exchange import ANSWERS, KEYS, Range, answered, asked, pack, unpack

END, START = b"", b" "  # no word is empty or holds a blank
SMOOTH, DISCOUNT = 0.1, 0.5
BLOCK_BYTES = 12 << 20
MORE_BITS = 24
CHAIN = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z and ASCII white space only


class Vocabulary:
    """Ids of the words that have root arcs; the start mark and all other words have an id of their own."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.ids = {w: i for i, w in enumerate(words)}
        self.other, self.start, self.size = len(words), len(words) + 1, len(words) + 2


class Automaton:
    """States, arcs and failure arcs of a backoff model; ``levels`` holds sorted keys and counts of kept n-grams."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray, n_texts: int, levels: list[tuple[np.ndarray, np.ndarray]], total: int, kinds: int):
        size = self.size = vocabulary.size
        scale = total + SMOOTH * (kinds + 1)
        root = np.log10((counts + SMOOTH) / scale)
        self.failure, self.weight = [0], [0.0]
        # The state of each kept n-gram that is extended, by (length, index).
        states: dict[tuple[int, int], int] = {}
        occurs = [np.concatenate([counts, [0, n_texts]]), *[c for _, c in levels]]
        spelled: list[list[tuple[int, ...]]] = [[(i,) for i in range(size)]]
        for keys, _ in levels:
            spelled.append([(*spelled[-1][k // size], int(k % size)) for k in keys.tolist()])
        index = {gram: (n + 1, i) for n, grams in enumerate(spelled) for i, gram in enumerate(grams)}
        for n, (keys, _) in enumerate(levels):
            for i in np.unique(keys // size).tolist():
                states[n + 1, i] = len(self.failure)
                self.failure.append(0)
                self.weight.append(0.0)

        def state_of(gram: tuple[int, ...]) -> int:
            while gram:
                at = states.get(index.get(gram, (0, 0)))
                if at is not None:
                    return at
                gram = gram[1:]
            return 0

        for (n, i), at in states.items():
            self.failure[at] = state_of(spelled[n - 1][i][1:])
        self.initial = state_of((vocabulary.start,))
        longest = len(levels)
        self.arcs: dict[int, tuple[int, float]] = {i: (state_of((i,)), float(p)) for i, p in enumerate(root)}
        for n, (keys, found) in enumerate(levels):
            shares: dict[int, float] = {}
            for k, c in zip(keys.tolist(), found.tolist(), strict=True):
                at = states[n + 1, k // size]
                shares[at] = shares.get(at, 0.0) + (c - DISCOUNT) / int(occurs[n][k // size])
            for at, share in shares.items():
                self.weight[at] = math.log10(1 - share)
            for k, c in zip(keys.tolist(), found.tolist(), strict=True):
                i, word = divmod(k, size)
                at = states[n + 1, i]
                p = (c - DISCOUNT) / int(occurs[n][i]) + 10 ** (self.weight[at] + self.step(self.failure[at], word)[1])
                gram = (*spelled[n][i], word)
                self.arcs[at * size + word] = (state_of(gram if n + 1 < longest else gram[1:]), math.log10(p))

    def step(self, state: int, word: int) -> tuple[int, float]:
        """The next state and the log10 probability of one word with a root arc."""
        total = 0.0
        while (arc := self.arcs.get(state * self.size + word)) is None:
            total += self.weight[state]
            state = self.failure[state]
        return arc[0], total + arc[1]


def digest(word: bytes) -> bytes:
    return blake2b(word, digest_size=8).digest()


def cut_blocks(batches: Iterable[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: the ids and training flags of its texts, their sizes in tokens, tokens and words' digests."""

    def block(number: int) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts], np.int64)
        digests = np.frombuffer(b"".join(map(digest, numbers)), np.uint64)
        keys = pa.concat_arrays(rows)
        blobs = [pack(x) for x in (np.concatenate(flags), sizes, np.concatenate(parts).astype(np.int32), digests)]
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        counts = [len(sizes), int(sizes.sum()), len(numbers)]
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), lists, *[pa.array([c], pa.int64()) for c in counts], *[pa.array([x], pa.binary()) for x in blobs]], BLOCK_NAMES)

    made, held, rows, flags, parts = 0, 0, [], [], []
    for batch in text_slices(batches, "text", BLOCK_BYTES):
        if not parts:
            numbers: dict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            get = numbers.__getitem__
            get(START)
        texts = byte_texts(batch["text"])
        for text in texts:
            words = [START, *words_of(text), END]
            parts.append(np.fromiter(map(get, words), np.int32, len(words)))
        rows.append(batch["id"])
        flags.append(batch["train"].to_numpy(zero_copy_only=False).astype(np.uint8))
        held += sum(map(len, texts))
        if held >= BLOCK_BYTES // 2:
            yield block(made)
            made, held, rows, flags, parts = made + 1, 0, [], [], []
    if parts:
        yield block(made)


BLOCK_NAMES = ["block", "ids", "n_texts", "n_tokens", "n_words", "train", "sizes", "tokens", "digests"]


class Block:
    """The distinct n-grams of a block's texts, by length, and where they end.

    ``places[k]`` has for each token the index of the n-gram of k + 1 words that ends there, or -1. Of each n-gram
    ``contexts[k]`` has the index of the one without the last word. ``counts[k]`` and ``first[k]`` have the corpus counts,
    and whether this block is the first that holds the n-gram.
    """

    def __init__(self, table: pa.Table, bits: int):
        row = {name: table[name][0].as_py() for name in BLOCK_NAMES if name != "ids"}
        self.number, self.bits = row["block"], bits
        self.ids = table["ids"].combine_chunks().flatten()
        self.sizes = unpack(row["sizes"], row["n_texts"], np.int64)
        self.train = unpack(row["train"], row["n_texts"], np.uint8).astype(bool)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.places = [unpack(row["tokens"], row["n_tokens"], np.int32).astype(np.int64)]
        self.keys = [unpack(row["digests"], row["n_words"], np.uint64)]
        self.contexts = [np.zeros(0, np.int64)]
        self.counts: list[np.ndarray] = []
        self.first: list[np.ndarray] = []

    def lengthen(self, least: int) -> None:
        """Adds the n-grams one word longer whose parts are kept; all pairs of words."""
        last, tokens, digests = self.places[-1], self.places[0], self.keys[0]
        if len(self.places) == 1:
            ends = np.flatnonzero(tokens != 0)  # the start mark is word 0
        else:
            good = (last >= 0) & np.append(self.counts[-1] >= least, False)[last]
            ends = np.flatnonzero(good[1:] & good[:-1]) + 1
        distinct, inverse = np.unique(last[ends - 1] * len(digests) + tokens[ends], return_inverse=True)
        context = distinct // len(digests)
        self.keys.append(mix64(self.keys[-1][context] * CHAIN + digests[distinct % len(digests)] + np.uint64(len(self.places) + 1)))
        place = np.full(len(tokens), -1, np.int64)
        place[ends] = inverse
        self.places.append(place)
        self.contexts.append(context)

    def ordered(self, level: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The (chosen) n-grams of a level in the order of their keys, and the keys."""
        at = np.arange(len(self.keys[level])) if chosen is None else np.flatnonzero(chosen)
        keys = self.keys[level][at]
        if level:
            keys = keys >> np.uint64(64 - self.bits)
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order]

    def ask(self, kind: int, level: int, ranges: int, numbers: np.ndarray, chosen: np.ndarray | None = None) -> pa.Table:
        at, keys = self.ordered(level, chosen)
        rows = asked(self.number, keys, self.bits if level else 64, ranges, {"numbers": numbers[at].astype(np.uint64)})
        return rows.append_column("kind", pa.array([kind] * len(rows), pa.int32()))

    def ask_counts(self, level: int, ranges: int) -> pa.Table:
        places = self.places[level]
        inside = np.repeat(self.train, self.sizes) & (places >= 0)
        return self.ask(level, level, ranges, np.bincount(places[inside], minlength=len(self.keys[level])))

    def receive(self, answers: pa.Table, levels: int, least: int) -> None:
        """Takes the corpus counts of so many levels, and adds the n-grams that they tell of."""
        for level in range(levels):
            if level:
                self.lengthen(least)
            found = np.zeros(len(self.keys[level]), np.uint64)
            found[self.ordered(level)[0]] = of_kind(answers, level)
            self.counts.append((found >> np.uint64(1)).astype(np.int64))
            self.first.append((found & np.uint64(1)).astype(bool))


def of_kind(answers: pa.Table, kind: int) -> np.ndarray:
    return answered(answers.filter(pa.array(answers["kind"].to_numpy() == kind)), np.uint64)


SENT = f"{KEYS}, numbers binary, kind int"
SENT_NAMES = ["block", "range", "n", "keys", "numbers", "kind"]
FOUND = f"{ANSWERS}, kind int, total long, kinds long"


def add_up(table: pa.Table, longest: int) -> pa.Table:
    """Of one range and kind: twice the sum of each key's counts, plus 1 for the first block that holds it; sums of weights alone."""
    own, kind, n = Range(table), table["kind"][0].as_py(), len(table)
    sums = own.sums("numbers", np.uint64)
    total = kinds = 0
    if kind == 0:
        words = sums[own.keys[own.order[own.starts]] != np.frombuffer(digest(START), np.uint64)[0]]
        total, kinds = int(words.sum()), int((words > 0).sum())
    found = own.spread(sums.astype(np.uint64))
    if kind < longest:
        found = found * np.uint64(2) + own.first()
    more = {"kind": pa.array([kind] * n, pa.int32()), "total": pa.array([total] + [0] * (n - 1), pa.int64()), "kinds": pa.array([kinds] + [0] * (n - 1), pa.int64())}
    return pa.table(own.answers(found) | more)


def score_texts(docs: DataFrame, training, order: int = 2, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all texts with a model of those where ``training`` holds; it keeps n-grams that occur ``least`` times.

    ``order`` is 2 or more. Returns id, n_tokens, n_known, train_tokens, base_score (words alone) and score (the
    automaton), log10.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(lambda batches: cut_blocks(batches, TaskContext.get().partitionId()), f"block long, ids array<{id_type}>, n_texts long, n_tokens long, n_words long, train binary, sizes binary, tokens binary, digests binary")
    blocks = written(cut, "blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    ranges, bits = max(1, math.ceil(tokens / (BLOCK_BYTES / 6))), min(64, tokens.bit_length() + MORE_BITS)

    def ask_first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(pa.Table.from_batches([batch.slice(i, 1)]), bits)
                block.lengthen(least)
                for level in range(2):
                    yield from block.ask_counts(level, ranges).select(SENT_NAMES).to_batches()

    def ask_longer(level: int):
        def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
            block = Block(table, bits)
            block.receive(answers, level, least)
            block.lengthen(least)
            return block.ask_counts(level, ranges).select(SENT_NAMES)

        return ask

    def ask_weights(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, bits)
        block.receive(answers, order, least)
        asks = []
        for n in range(1, order):
            mine = block.first[n] & (block.counts[n] >= least)
            # Twice a count less one half is an integer.
            halves = np.bincount(block.contexts[n][mine], 2 * block.counts[n][mine] - 1, len(block.keys[n - 1]))
            asks.append(block.ask(order + n - 1, n - 1, ranges, halves, block.counts[n - 1] >= least))
        return pa.concat_tables(asks).select(SENT_NAMES)

    def with_blocks(answers: DataFrame):
        return blocks.groupBy("block").cogroup(answers.groupBy("block"))

    def added(sent: DataFrame, name: str) -> DataFrame:
        return written(sent.groupBy("kind", "range").applyInArrow(lambda table: add_up(table, order), FOUND), name)

    known = added(blocks.mapInArrow(ask_first, SENT), "gram-counts")
    sums = known.agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).first()
    total = sums["total"] or 0
    scale = total + SMOOTH * ((sums["kinds"] or 0) + 1)
    for level in range(2, order):
        known = known.unionByName(added(with_blocks(known).applyInArrow(ask_longer(level), SENT), "gram-counts"))
    known = known.unionByName(added(with_blocks(known).applyInArrow(ask_weights, SENT), "discounted-counts"))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, bits)
        block.receive(answers, order, least)
        tokens = block.places[0]
        base = (block.counts[0] + SMOOTH) / scale
        path = base[tokens]
        base = np.log10(base)[tokens]
        for n in range(1, order):
            size = len(block.keys[n - 1])
            halves = np.zeros(size)
            halves[block.ordered(n - 1, block.counts[n - 1] >= least)[0]] = of_kind(answers, order + n - 1)
            weight = 1 - halves / np.maximum(2 * block.counts[n - 1], 1)
            kept = block.counts[n] >= least
            share = np.where(kept, (block.counts[n] - DISCOUNT) / np.maximum(block.counts[n - 1][block.contexts[n]], 1), 0.0)
            # The context of a token ends at the token before; without an arc from it, its failure arc is taken.
            before = np.concatenate([[-1], block.places[n - 1][:-1]])
            at = np.flatnonzero((before >= 0) & (tokens != 0))
            path[at] = path[at] * weight[before[at]]
            at = np.flatnonzero(block.places[n] >= 0)
            path[at] += share[block.places[n][at]]
        path = np.log10(path)
        seen = (block.counts[0] > 0)[tokens].astype(np.int64)
        for values in (base, path, seen):
            values[block.begins] = 0
        n_known, base, path = (np.add.reduceat(x, block.begins) for x in (seen, base, path))
        return pa.table({id_col: block.ids, "n_tokens": block.sizes - 1, "n_known": n_known, "train_tokens": np.full(len(path), total, np.int64), "base_score": base, "score": path})

    return with_blocks(known).applyInArrow(score, f"`{id_col}` {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_texts(docs, crc_bucket("doc_id", 10) != 0, order=3)
    return scored.select("doc_id", (crc_bucket("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
