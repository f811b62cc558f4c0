"""SentencePiece encoding and decoding over a shared-prefix trie of words.

A text is marked as the library does it: a blank in front, every blank written as the mark. It is cut into words between
two symbols that no piece joins, so before each run of marks and mostly beside punctuation; for a unigram model before
runs of marks only. The distinct words of a slice of texts that are not known yet are sorted, which is a depth-first walk
of their trie: a word takes over the forward states of the prefix that it shares with the word before it and only adds the
states of its own symbols. Arrow and numpy cut texts and put pieces together; Python sees a distinct word once a slice.

Unigram models. The forward state of a prefix is its best score with the piece that ends it, as in Viterbi's algorithm;
the pieces are traced back from the word's end.

BPE models. Their pieces have merge ranks and not probabilities, so the best sum of scores is not what the library gives.
The forward state is what BPE has in its place: the one piece that ends the encoding of the prefix. It is the piece whose
joint with the state at its start survives all merges, which two pieces decide between them. The walk, the reuse and the
trace back are the same. Words that begin with several marks are merged pair by pair from a heap, because the pieces of
blanks share one rank.

Symbols outside the vocabulary become their UTF-8 bytes.

Defined cases: a null or empty text has no pieces and decodes to the empty text; texts are used whole, whatever their
length; repeated rows each get a row; an empty table gives no rows; columns other than the id and the text are passed on
only where asked for; pieces that spell no valid UTF-8 decode with replacement characters.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import read_table, text_slices, tidy

MARK = "▁"
#: What the library takes off the least score for a symbol that no piece spells.
UNKNOWN_PENALTY = 10.0
NEVER = 1 << 60
MEMO_PAIRS, MEMO_WORDS, SLICE = 400_000, 250_000, 2 << 20


class PieceTexts:
    """The bytes of all pieces, which is all that decoding needs."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        spelled = [bytes([int(name[1:-1], 16)]) if library.is_byte(i) else name.encode() for i, name in enumerate(names)]
        self.spelled = pa.array(spelled, pa.binary())

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.fromiter(ids, np.int32)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].as_py()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of all piece ids, one text after another."""
        # The spelled pieces lie one behind another, so a text is what lies between its first and its last.
        _, begins, data = self.spelled.take(pa.array(ids, pa.int32())).buffers()
        cuts = np.frombuffer(begins, np.int32)[offsets] if len(ids) else np.zeros(len(offsets), np.int32)
        joined = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(cuts.tobytes()), data])
        joined = pc.replace_substring(joined, MARK.encode(), b" ")
        whole = pc.binary_replace_slice(joined, start=0, stop=1, replacement=b"")  # without the blank in front
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


class PieceTrie(PieceTexts):
    """Pieces of a BPE or unigram model with byte fallback and the forward walk over sorted words."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        self.text = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.bytes = {int(self.text[i][1:-1], 16): i for i in range(size) if library.is_byte(i)}
        super().__init__(model)
        self.score = {i: library.get_score(i) for i in plain}
        # Scores of a BPE model are the negative times of its merges, those of a unigram model log-probabilities.
        self.unigram = any(x != int(x) for x in self.score.values())
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        # A piece's rank is the time of its merge; single symbols are there from the start.
        self.rank = {} if self.unigram else {i: 0 if len(self.text[i]) == 1 else 1 - int(self.score[i]) for i in plain}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        for i in [] if self.unigram else plain:
            self._spines(i)
        # The vocabulary's trie: a node is the piece that ends there, or -1, and the nodes behind it by symbol.
        self.root: dict[str, list] = {}
        for piece, i in self.ids.items():
            if self.unigram or i in self.left:
                behind = self.root
                for symbol in piece[:-1]:
                    behind = behind.setdefault(symbol, [-1, {}])[1]
                behind.setdefault(piece[-1], [-1, {}])[0] = i
        # Last and first bytes of two symbols that a piece may join; a blank stands for the mark.
        self.joins = np.zeros((256, 256), bool)
        if self.unigram:
            self.joins[:] = True
            self.joins[:32, 32] = self.joins[33:, 32] = False
        else:
            for piece in self.ids:
                symbols = [c.encode() for c in piece.replace(MARK, " ")]
                self.joins[[c[-1] for c in symbols[:-1]], [c[0] for c in symbols[1:]]] = True
        self.fits: dict[int, bool] = {}
        # Pieces of known words as bytes of 32-bit numbers; words that were not asked for lately are in the older part.
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merged(self, word: str) -> list[str]:
        """Merges pair by pair, the best rank first and the leftmost of equals; a heap holds the pairs that can merge."""
        parts, n = list(word), len(word)
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[i], at, 2) for at in range(n - 1) if (i := self.ids.get(parts[at] + parts[at + 1])) is not None]
        heapify(heap)
        while heap:
            _, at, size = heappop(heap)
            other = behind[at]
            if not parts[at] or other >= n or len(parts[at]) + len(parts[other]) != size:
                continue  # one of the two has merged meanwhile
            parts[at], parts[other] = parts[at] + parts[other], ""
            behind[at] = behind[other]
            if behind[at] < n:
                before[behind[at]] = at
            for a, b in ((before[at], at), (at, behind[at])):
                if a >= 0 and b < n and (i := self.ids.get(parts[a] + parts[b])) is not None:
                    heappush(heap, (self.rank[i], a, len(self.text[i])))
        return [p for p in parts if p]

    def _spines(self, i: int) -> None:
        """The pieces at both edges of a piece while it is merged, each with the time of its end; none if out of reach."""
        parts, word = list(self.text[i]), self.text[i]
        left, right = [], []
        while len(parts) > 1:
            ranks = [self.rank[j] if (j := self.ids.get(a + b)) is not None else NEVER for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == NEVER:
                return
            at = ranks.index(least)
            if at == 0:
                left.append((parts[0], least))
            if at == len(parts) - 2:
                right.append((parts[-1], least))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.left[i], self.right[i] = [*left, (word, NEVER)], [*right, (word, NEVER)]

    def joint(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay apart when their symbols are encoded together."""
        xs, ys, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            both = self.ids.get(x + y)
            if both is not None and self.rank[both] < x_ends and self.rank[both] <= y_ends:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _fits(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:  # a symbol outside the vocabulary merges with nothing
            return True
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > MEMO_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.joint(a, b)
        return known

    def walk(self, words: list[str]) -> Iterator[list[int]]:
        """Piece ids of sorted words.

        ``states`` holds (piece, start) of every prefix of the current word, and ``open_at`` the places from which a
        piece may still reach beyond the prefix, with what follows there in the vocabulary's trie.
        """
        states: list[tuple[int, int]] = [(0, 0)]
        open_at: list[list[tuple[int, dict]]] = [[(0, self.root)]]
        last, root, fits, spell = "", self.root, self._fits, self.bytes
        for word in words:
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], open_at[shared + 1 :]
            reach = open_at[-1]
            for end, symbol in enumerate(word[shared:], shared + 1):
                state, before, reach = None, reach, []
                for start, behind in before:
                    if (node := behind.get(symbol)) is not None:
                        piece, further = node
                        if further:
                            reach.append((start, further))
                        if state is None and piece >= 0 and (start == 0 or fits(states[start][0], piece)):
                            state = (piece, start)
                reach.append((end, root))
                states.append(state or (-1 - ord(symbol), end - 1))
                open_at.append(reach)
            last, out, at = word, [], len(word)
            while at:
                piece, start = states[at]
                if piece >= 0:
                    out.append(piece)
                else:
                    out.extend(spell[b] for b in reversed(chr(-1 - piece).encode()))
                at = start
            out.reverse()
            yield out

    def walk_scores(self, words: list[str]) -> Iterator[list[int]]:
        """Piece ids of sorted words by the best sum of scores; ``best`` has that sum for every prefix of the current word."""
        states: list[tuple[int, int]] = [(0, 0)]
        best: list[float] = [0.0]
        open_at: list[list[tuple[int, dict]]] = [[(0, self.root)]]
        last, score = "", self.score
        for word in words:
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], best[shared + 1 :], open_at[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                symbol, reach, top, state, alone = word[end - 1], [], 0.0, None, False
                for start, behind in open_at[-1]:
                    if (node := behind.get(symbol)) is not None:
                        piece, further = node
                        reach.append((start, further))
                        if piece >= 0:
                            alone |= start == end - 1
                            total = best[start] + score[piece]
                            if state is None or total > top:
                                state, top = (piece, start), total
                if not alone and (state is None or best[end - 1] + self.unknown > top):
                    state, top = (-1 - ord(symbol), end - 1), best[end - 1] + self.unknown
                reach.append((end, self.root))
                states.append(state)
                best.append(top)
                open_at.append(reach)
            last = word
            yield self._traced(states, len(word))

    def _traced(self, states: list[tuple[int, int]], at: int) -> list[int]:
        out = []
        while at:
            piece, start = states[at]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.bytes[b] for b in reversed(chr(-1 - piece).encode()))
            at = start
        out.reverse()
        return out

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        if self.unigram:
            plain = sorted(words)
            return dict(zip(plain, self.walk_scores(plain), strict=True))
        plain = sorted(w for w in words if MARK + MARK not in w)
        out = dict(zip(plain, self.walk(plain), strict=True))
        for word in words if len(plain) < len(words) else []:
            if MARK + MARK in word:
                ids = out[word] = []
                for part in self.merged(word):
                    piece = self.ids.get(part)
                    ids += [piece] if piece is not None else [self.bytes[b] for b in part.encode()]
        return out

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of marked texts one after another, with blanks for marks, and the n + 1 offsets between texts."""
        plain = pc.replace_substring(pc.fill_null(texts, "").cast(pa.binary()), MARK.encode(), b" ")
        front = pc.if_else(pc.equal(pc.binary_length(plain), 0), pa.scalar(b""), pa.scalar(b" "))
        marked = pc.binary_join_element_wise(front, plain, pa.scalar(b""))
        _, ends, buffer = marked.buffers()
        ends = np.frombuffer(ends, np.int32)[marked.offset : marked.offset + len(marked) + 1]
        data = np.frombuffer(buffer, np.uint8, int(ends[-1])) if ends[-1] else np.zeros(0, np.uint8)
        starts = np.zeros(len(data) + 1, bool)
        if len(data):
            behind = data[1:]
            starts[1:-1] = ~self.joins.reshape(-1)[data[:-1].astype(np.uint16) << 8 | behind] & (behind & 0xC0 != 0x80)
        starts[ends] = True
        places = np.flatnonzero(starts)
        words = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32).tobytes()), buffer])
        return words, np.searchsorted(places, ends)

    def known(self, words: list[bytes]) -> list[bytes]:
        """The pieces of distinct words; only those that are in no part of the memo are walked."""
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        memo, older, out, new = self.memo, self.older, [], []
        for at, word in enumerate(words):
            ids = memo.get(word)
            if ids is None:
                ids = older.get(word)
                if ids is None:
                    new.append(at)
                else:
                    memo[word] = ids
            out.append(ids)
        names = [words[at].decode().replace(" ", MARK) for at in new]
        found = self.encode_words(names)
        for at, name in zip(new, names, strict=True):
            out[at] = memo[words[at]] = array("i", found[name]).tobytes()
        return out

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All piece ids one after another, and the n + 1 offsets between texts."""
        words, bounds = self.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        pieces = self.known(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        pool, rows = np.frombuffer(b"".join(pieces), np.int32), coded.indices.to_numpy()
        begins = np.cumsum(lengths) - lengths
        counts = lengths[rows]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.arange(ends[-1]) + np.repeat(begins[rows] - ends[:-1], counts)]
        return ids, ends[bounds]


@lru_cache(maxsize=1)
def worker_trie(model: bytes) -> PieceTrie:
    """The trie of a worker with the words that it knows, for all tasks that the worker runs; another model takes its place."""
    return PieceTrie(model)


def _pieces_and_texts(trie: PieceTrie, texts: pa.Array, decoded: bool) -> list[pa.Array]:
    ids, offsets = trie.encode(texts)
    pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
    return [pieces, pa.array(np.diff(offsets), pa.int64()), *([trie.decode_all(ids, offsets)] if decoded else [])]


def encode(docs: DataFrame, model_file: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns in ``keep`` with ``pieces`` (array of piece ids) and ``n_pieces`` of every row.

    ``decoded`` adds the text that the pieces decode to, as ``decode`` would, in the same pass.
    """
    with open(model_file, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # one model file, whatever the input
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    made = ["pieces", "n_pieces", *(["decoded"] if decoded else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text", SLICE):
            trie = worker_trie(shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_pieces_and_texts(trie, batch["_text"], decoded)], [*keep, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(tidy(run), ", ".join([*fields, *(f"{c} {t}" for c, t in zip(made, ("array<int>", "long", "string"), strict=False))]))


def decode(rows: DataFrame, model_file: str, pieces_col: str = "pieces") -> DataFrame:
    """Adds ``decoded`` to ``rows``, the text of each row's pieces."""
    with open(model_file, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceTexts(shared.value)
        for batch in batches:
            counts = np.asarray(pc.fill_null(pc.list_value_length(batch[pieces_col]), 0), np.int64)
            group = np.cumsum(counts) // (SLICE // 4)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, end - start)
                ids = part[pieces_col].flatten().to_numpy(zero_copy_only=False)
                texts = pieces.decode_all(ids, np.concatenate([[0], np.cumsum(counts[start:end])]))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(tidy(run), f"{fields}, decoded string")


def encode_query(spark: SparkSession, sf_dir: str, model_file: str) -> DataFrame:
    """Every document's pieces, and the text that they decode to."""
    return encode(read_table(spark, sf_dir, "documents"), model_file, decoded=True)
