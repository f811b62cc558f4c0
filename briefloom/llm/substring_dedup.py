"""Exact substring dedup with enhanced suffix arrays of anchored fragments.

Every byte that a repeated string of ``MIN`` bytes covers is removed, except where no equal string starts earlier (in a
smaller document id, or before it in the same document).

Which suffixes to sort. Equal windows of MIN bytes pick the same anchor: the least hash among their grams of GRAM bytes.
So two equal windows hold equal anchor grams at the same place, and only the surroundings of an anchor (the bytes that a
window around it can reach) have to be compared. Anchors meet by their gram's hash, in one shuffle of ids and places:

* anchors with equal surroundings are collapsed to the first one, in each task before the shuffle and again behind it;
  the windows around the others are repeats, and no text moves for them;
* a gram whose surroundings are all equal is done;
* for the others, the surroundings are cut from the texts as fragments and meet by the gram's hash again.

Per batch of fragments, a suffix array with its common-prefix lengths is built: ranks by doubling, then the tails of
suffixes that share MIN bytes. A stack scan over it walks the tree of common-prefix intervals; an interval of MIN bytes or more whose occurrences differ in the byte to the left
is a maximal repeat, and all its occurrences but the earliest are removed. An interval whose occurrences all follow the
same byte is part of the one that starts a byte earlier.

A gram with more than ``HOT`` different surroundings is not brought together: each of the windows around it becomes a key
of its own, which is collapsed in the tasks like the anchors above. So no group grows with the number of copies.

Defined cases: a null text is empty; ids are whole numbers, and null ids come before all others; rows that share an id
count as documents of their own, in the order of their texts, and equal rows are cut alike; texts are used whole; a text
that is cut inside a character keeps its other bytes (the kept bytes are a binary column); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.llm.common import mix64, read_table, text_bytes, text_slices, written

MIN, GRAM = 100, 32
LEFT = MIN - GRAM  # bytes in front of an anchor that a window around it can reach; behind its start it reaches MIN
SLICE = 2 << 20
#: Different surroundings of a gram that a slice of texts sends on as one group, and of one that is handled as a group.
SPREAD, HOT = 8, 4096
#: Bytes of fragments that are sorted together at least, where there are as many.
BATCH = 1 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

ANCHOR, SPAN, PROBE = 0, 1, 2
ROW = "kind int, key long, ctx long, doc long, copy int, a int, b int"


class Hasher:
    """Hashes of any stretch of a buffer as differences of sums, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        power = np.full(max(1, len(data)), BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)[: len(data)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
        back = np.full(len(data) + 1, INVERSE, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.back[starts])


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of each window of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        span += step
    return at[:n].astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of all windows within the texts of a buffer: text, place, hash, bytes in reach, hash of those."""
    hasher, n = Hasher(data), len(data)
    if n < MIN:
        found = np.zeros(0, np.int64)
    else:
        grams = hasher.of(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
        picked = leftmost_minimum(grams, LEFT + 1)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        inside = np.arange(n - MIN + 1) + MIN <= ends[: n - MIN + 1]
        found = np.unique(picked[inside])
    text = np.searchsorted(offsets, found, side="right") - 1
    left = np.minimum(LEFT, found - offsets[text])
    right = np.minimum(MIN, offsets[text + 1] - found)
    hashes = hasher.of(found, found + GRAM)
    around = mix64(hasher.of(found - left, found + right) ^ (left * 128 + right).astype(np.uint64))
    return {"text": text, "pos": found - offsets[text], "hash": hashes, "around": around, "left": left, "right": right}


def long_pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, bool] | None]]:
    """Buffers of about SLICE bytes: data, offsets, row of each text, and for a piece of a document where it begins and
    whether it is the last.

    A document longer than a slice comes in pieces that share twice MIN bytes, so that every window and what is in reach
    of its anchor is whole in the piece that owns the anchor.
    """
    data, offsets = text_bytes(batch[column])
    if len(data) <= SLICE or (np.diff(offsets) <= SLICE).all():
        yield data, offsets, np.arange(batch.num_rows), None
        return
    for row in range(batch.num_rows):
        begin, stop = int(offsets[row]), int(offsets[row + 1])
        for start in range(begin, max(begin + 1, stop - 2 * MIN), SLICE):
            end = min(stop, start + SLICE + 2 * MIN)
            yield data[start:end], np.array([0, end - start]), np.array([row]), (start - begin, end == stop)


def merged_spans(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins spans of a document that overlap or touch."""
    if not len(doc):
        return doc, copy, start, end
    order = np.lexsort((start, copy, doc))
    doc, copy, start, end = doc[order], copy[order], start[order], end[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])
    group = np.cumsum(other)
    reach = np.maximum.accumulate(end.astype(np.int64) + group * (1 << 33)) - group * (1 << 33)
    fresh = other.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], copy[at], start[at], reach[last]


def _batch(kind, key, ctx, doc, copy, a, b) -> pa.RecordBatch:
    n = len(doc)
    full = lambda v: v if isinstance(v, np.ndarray) else np.full(n, v)
    columns = [full(kind).astype(np.int32), full(key).astype(np.int64), full(ctx).astype(np.int64), doc.astype(np.int64), copy.astype(np.int32), full(a).astype(np.int32), full(b).astype(np.int32)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["kind", "key", "ctx", "doc", "copy", "a", "b"])


def span_rows(doc, copy, start, end) -> pa.RecordBatch:
    """Spans as rows of the common form; their key spreads them."""
    doc, copy, start, end = merged_spans(doc, copy, start, end)
    return _batch(SPAN, mix64(doc.astype(np.uint64) + start.astype(np.uint64)).view(np.int64), 0, doc, copy, start, end)


def collapse(key, ctx, doc, copy, pos, reach) -> Iterator[pa.RecordBatch]:
    """Of anchors (or windows) with equal key and surroundings only the first goes on; the others become spans.

    A key with more than SPREAD surroundings sends all but two of them on as probes, which need not meet by key here.
    """
    order = np.lexsort((pos, copy, doc, ctx, key))
    key, ctx, doc, copy, pos, reach = (x[order] for x in (key, ctx, doc, copy, pos, reach))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
    left, right = reach // 128, reach % 128
    later = ~fresh & (left + right >= MIN)
    yield span_rows(doc[later], copy[later], (pos - left)[later], (pos + right)[later])
    key, ctx, doc, copy, pos, reach = (x[fresh] for x in (key, ctx, doc, copy, pos, reach))
    change = np.ones(len(key), bool)
    change[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(change)
    size = np.diff(np.concatenate([begin, [len(key)]]))
    nth = np.arange(len(key)) - np.repeat(begin, size)
    many = np.repeat(size > SPREAD, size) & (nth >= 2)
    # Probes keep the gram in ctx; their own key spreads them.
    yield _batch(PROBE, mix64(key[many].view(np.uint64) + ctx[many].view(np.uint64)).view(np.int64), key[many], doc[many], copy[many], pos[many], reach[many])
    yield _batch(ANCHOR, key[~many], ctx[~many], doc[~many], copy[~many], pos[~many], reach[~many])


def anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            ids, copies = batch["doc"].to_numpy(), batch["copy"].to_numpy()
            for data, offsets, rows, piece in long_pieces(batch, "text"):
                found = anchors(data, offsets)
                row = rows[found["text"]]
                pos, left, right = found["pos"] + (piece[0] if piece else 0), found["left"], found["right"]
                if piece is not None:  # a piece owns the anchors from MIN behind its start to MIN behind the next one's
                    start, is_last = piece
                    own = ((pos >= start + MIN) | (start == 0)) & ((pos < start + SLICE + MIN) | is_last)
                    found = {k: v[own] for k, v in found.items()}
                    row, pos, left, right = row[own], pos[own], left[own], right[own]
                yield from collapse(found["hash"].view(np.int64), found["around"].view(np.int64), ids[row], copies[row], pos, left * 128 + right)

    return docs.mapInArrow(run, ROW)


def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, surroundings and place: later equals become spans, keys with several surroundings probes."""
    last_key = last_ctx = pending = None
    for batch in batches:
        columns = {n: batch[n].to_numpy() for n in batch.schema.names}
        other = columns["kind"] != ANCHOR
        if other.any():
            yield batch.filter(pa.array(other))
        key, ctx, doc, copy, a, b = (columns[n][~other] for n in ("key", "ctx", "doc", "copy", "a", "b"))
        if not len(key):
            continue
        new_key, fresh = np.ones(len(key), bool), np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        fresh[1:] = new_key[1:] | (ctx[1:] != ctx[:-1])
        goes_on = last_key is not None and key[0] == last_key
        if goes_on:
            new_key[0], fresh[0] = False, ctx[0] != last_ctx
        left, right = b // 128, b % 128
        later = ~fresh & (left + right >= MIN)
        if later.any():
            yield span_rows(doc[later], copy[later], (a - left)[later].astype(np.int64), (a + right)[later].astype(np.int64))
        at = np.flatnonzero(fresh)
        group = np.cumsum(new_key)[at]  # group 0 goes on from the batch before
        size = np.bincount(group, minlength=1)
        keep = size[group] > 1
        if goes_on:
            keep[group == 0] = True
            if pending is not None and size[0]:
                yield pending
                pending = None
        else:
            pending = None
        if size[1:].sum():  # another key began, so what was pending has no second surroundings
            pending = pending if goes_on and not new_key.any() else None
        yield _batch(PROBE, key[at[keep]], key[at[keep]], doc[at[keep]], copy[at[keep]], a[at[keep]], b[at[keep]])
        if new_key.any() and size[group[-1]] == 1 and group[-1] > 0:
            i = at[-1:]
            pending = _batch(PROBE, key[i], key[i], doc[i], copy[i], a[i], b[i])
        last_key, last_ctx = key[-1], ctx[-1]


def window_ranks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places with MIN bytes left in their fragment (``ends`` for each place), and the order rank of those bytes.

    Ranks double from words of 8 bytes to 64; two of 64 that overlap give MIN.
    """
    n = len(data)
    place = np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : n + k]
    rank, length = np.unique(words, return_inverse=True)[1].astype(np.int64), 8
    while length < 64:
        rank = np.unique(rank * n + rank[np.minimum(place + length, n - 1)], return_inverse=True)[1].astype(np.int64)
        length *= 2
    whole = np.flatnonzero(place + MIN <= ends)
    return whole, rank[whole] * n + rank[whole + MIN - 64]


def tail_order(data: np.ndarray, ends: np.ndarray, places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Orders places by group, then by the bytes behind their first MIN, an end before any byte."""
    most = int((ends - places).max()) - MIN
    keys = []
    for at in range(0, most, 8):
        begin = places + MIN + at
        valid = np.clip(ends - begin, 0, 8)
        word = np.zeros(len(places), np.uint64)
        for k in range(8):
            byte = np.where(k < valid, data[np.minimum(begin + k, len(data) - 1)], 0)
            word = (word << np.uint64(8)) | byte.astype(np.uint64)
        keys += [word, valid]
    return np.lexsort((*keys[::-1], group))


def common_lengths(data: np.ndarray, ends: np.ndarray, places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common-prefix length of each place with the one before it; 0 where another group begins."""
    out = np.zeros(len(places), np.int64)
    at = np.flatnonzero(group[1:] == group[:-1]) + 1
    x, y = places[at - 1] + MIN, places[at] + MIN
    stop_x, stop_y = ends[at - 1], ends[at]
    out[at] = MIN
    while len(at):
        going = (x < stop_x) & (y < stop_y)
        going[going] = data[x[going]] == data[y[going]]
        at, x, y, stop_x, stop_y = at[going], x[going] + 1, y[going] + 1, stop_x[going], stop_y[going]
        out[at] += 1
    return out


def maximal_repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places and length of every maximal repeat of MIN bytes or more; fragment i is data[starts[i]:ends[i]]."""
    if not len(data):
        return
    stop = np.repeat(ends, ends - starts)
    places, rank = window_ranks(data, stop)
    before = np.full(len(data), -1, np.int64)
    before[1:] = data[:-1]
    before[starts[starts < ends]] = 256 + np.flatnonzero(starts < ends)  # a fragment's edge differs from all bytes
    order = np.argsort(rank, kind="stable")
    places, rank = places[order], rank[order]
    begin = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [len(rank)]]))
    if len(begin):
        # Suffixes of a group that all follow the same byte hold no maximal repeat, nor do the intervals within it.
        diverse = np.minimum.reduceat(before[places], begin) != np.maximum.reduceat(before[places], begin)
        keep = np.repeat(diverse & (size > 1), size)
        places, rank = places[keep], rank[keep]
    if not len(places):
        return
    order = tail_order(data, stop[places], places, rank)
    places, rank = places[order], rank[order]
    common, left = common_lengths(data, stop[places], places, rank), before[places]
    stack: list[tuple[int, int]] = []  # (common length, first suffix) of open intervals
    for i, length in enumerate([*common.tolist(), 0]):
        first = i - 1
        while stack and stack[-1][0] > length:
            most, first = stack.pop()
            own = left[first:i]
            if (own != own[0]).any():
                yield places[first:i], most
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def repeats_of(rows: dict[str, np.ndarray], data: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Spans to remove from a batch of fragments; ``rows`` has doc, copy and place of each fragment's first byte."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    for places, length in maximal_repeats(data, starts, ends):
        fragment = np.searchsorted(starts, places, side="right") - 1
        begin = rows["begin"][fragment] + places - starts[fragment]
        first = np.lexsort((begin, rows["copy"][fragment], rows["doc"][fragment]))[0]
        # Fragments overlap, so the earliest string may be in several of them.
        later = (rows["doc"][fragment] != rows["doc"][fragment[first]]) | (rows["copy"][fragment] != rows["copy"][fragment[first]]) | (begin != begin[first])
        out.append((fragment[later], begin[later], length))
    fragment = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64)
    begin = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64)
    end = begin + np.repeat([o[2] for o in out], [len(o[0]) for o in out]).astype(np.int64) if out else begin
    return span_rows(rows["doc"][fragment], rows["copy"][fragment], begin, end)


def fragment_rows(probed: DataFrame) -> DataFrame:
    """From (doc, copy, text, probes): a fragment for each probe, and windows for probes of hot grams."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            ids, copies = batch["doc"].to_numpy(), batch["copy"].to_numpy()
            data, offsets = text_bytes(batch["text"])
            probes = batch["probes"]
            row = np.repeat(np.arange(batch.num_rows), np.diff(probes.offsets.to_numpy()))
            flat = probes.flatten()
            gram, pos, reach, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            left, right = reach // 128, reach % 128
            at = offsets[row] + pos
            plain = np.flatnonzero(~hot)
            pieces = [data[at[i] - left[i] : at[i] + right[i]].tobytes() for i in plain.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*_batch(PROBE, gram[plain], 0, ids[row[plain]], copies[row[plain]], pos[plain] - left[plain], reach[plain]).columns, pa.array(pieces, pa.binary())],
                ["kind", "key", "ctx", "doc", "copy", "a", "b", "piece"],
            )
            hot = np.flatnonzero(hot)
            if len(hot):
                hasher = Hasher(data)
                # All windows of MIN bytes around the hot anchors, as keys of their own; (0, MIN) is a window's reach.
                starts = np.concatenate([at[hot] - k for k in range(LEFT + 1)])
                owner = np.tile(hot, LEFT + 1)
                ok = (starts >= at[owner] - left[owner]) & (starts + MIN <= at[owner] + right[owner])
                starts, owner = starts[ok], owner[ok]
                starts, keep = np.unique(starts, return_index=True)
                owner = row[owner[keep]]
                keys = mix64(hasher.of(starts, starts + MIN) + np.uint64(1)).view(np.int64)
                for out in collapse(keys, np.zeros(len(keys), np.int64), ids[owner], copies[owner], starts - offsets[owner], np.full(len(keys), MIN)):
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary())], [*out.schema.names, "piece"])

    return probed.mapInArrow(run, ROW + ", piece binary")


def sort_fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: fragments in batches of whole keys through suffix arrays, windows by first and later."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        pieces = table["piece"].chunk(0)
        data, offsets = text_bytes_of(pieces)
        rows = {"doc": table["doc"].to_numpy(), "copy": table["copy"].to_numpy(), "begin": table["a"].to_numpy().astype(np.int64)}
        return repeats_of(rows, data, np.diff(offsets))

    def fragments() -> Iterator[pa.RecordBatch]:
        """Yields spans of fragments and passes the other rows to ``resolve``."""
        nonlocal held, held_bytes
        for batch in batches:
            own = batch["kind"].to_numpy() == PROBE
            plain = batch.filter(pa.array(own))
            rest = batch.filter(pa.array(~own)).drop_columns(["piece"])
            if rest.num_rows:
                yield rest
            if plain.num_rows:
                keys = plain["key"].to_numpy()
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                sizes = np.concatenate([[0], np.cumsum(plain["b"].to_numpy() // 128 + plain["b"].to_numpy() % 128)])
                if held and held[-1]["key"][held[-1].num_rows - 1].as_py() != keys[0] and held_bytes >= BATCH:
                    yield flush()
                    held, held_bytes = [], 0
                begin = 0
                for cut in cuts[1:-1]:
                    if held_bytes + sizes[cut] - sizes[begin] >= BATCH:
                        held.append(plain.slice(begin, cut - begin))
                        yield flush()
                        held, held_bytes, begin = [], 0, cut
                held.append(plain.slice(begin))
                held_bytes += int(sizes[-1] - sizes[begin])
        if held:
            yield flush()

    yield from resolve(fragments())


def text_bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, copy, start, end) of what to remove from rows of (doc, copy, text); spans may overlap."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = anchor_rows(docs).repartition(partitions, "key").sortWithinPartitions("key", "ctx", "doc", "copy", "a")
    first = written(met.mapInArrow(resolve, ROW), "anchors")
    probes = first.where(F.col("kind") == PROBE).select(F.col("ctx").alias("gram"), "doc", "copy", "a", "b").distinct()
    hot = probes.groupBy("gram").count().where(F.col("count") > HOT).select("gram", F.lit(True).alias("hot"))
    probes = probes.join(hot, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    grouped = probes.groupBy("doc", "copy").agg(F.collect_list(F.struct("gram", "a", "b", "hot")).alias("probes"))
    fragments = fragment_rows(docs.join(grouped, ["doc", "copy"]).select("doc", "copy", "text", "probes"))
    met = fragments.repartition(partitions, "key").sortWithinPartitions("key", "ctx", "doc", "copy", "a")
    second = written(met.mapInArrow(sort_fragments, ROW).where(F.col("kind") == SPAN), "fragments")
    spans = first.where(F.col("kind") == SPAN).unionByName(second)
    return spans.select("doc", "copy", F.col("a").alias("start"), F.col("b").alias("end"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc, copy, text, _id), where copy numbers rows that share an id in the order of their texts; whether any do."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(doc.alias("doc"), F.lit(0).alias("copy"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("_id"))
    repeated = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return rows, False
    texts = rows.join(repeated, "doc", "left_semi").select("doc", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s")).distinct()
    ranks = texts.select("doc", "s", (F.row_number().over(Window.partitionBy("doc").orderBy("h", "s")) - 1).alias("rank"))
    out = rows.withColumn("s", F.sha2("text", 256)).join(ranks, ["doc", "s"], "left")
    return out.select("doc", F.coalesce("rank", F.lit(0)).alias("copy"), "text", "_id"), True


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_bytes, n_removed, n_spans, spans (array of start and end) and kept (binary) of every row."""
    rows, repeated = numbered(docs, id_col, text_col)
    once = rows.select("doc", "copy", "text")
    spans = repeated_spans(once.dropDuplicates(["doc", "copy"]) if repeated else once)
    by_doc = spans.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    met = rows.join(by_doc, ["doc", "copy"], "left").select("_id", "text", "found")
    kind = met.schema["_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            data, offsets = text_bytes(batch["text"])
            removed, kept, merged = [], [], []
            for i, found in enumerate(batch["found"].to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                if not found:
                    kept.append(own.tobytes())
                    merged.append([])
                    removed.append(0)
                    continue
                start, end = np.array([s["start"] for s in found]), np.array([s["end"] for s in found])
                zeros = np.zeros(len(start), np.int64)
                _, _, start, end = merged_spans(zeros, zeros, start, end)
                mask = np.zeros(len(own) + 1, np.int64)
                mask[start] += 1
                mask[end] -= 1
                kept.append(own[np.cumsum(mask)[:-1] == 0].tobytes())
                merged.append([{"start": int(s), "end": int(e)} for s, e in zip(start, end, strict=True)])
                removed.append(int((end - start).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array([len(m) for m in merged], pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    out = met.mapInArrow(cut, f"_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("_id", id_col)


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes]) -> list[tuple[int, int, str]]:
    """Removed bytes, spans and hash of the kept bytes for texts in document order, by definition; for tests."""
    seen: set[bytes] = set()
    out = []
    for text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - MIN + 1):
            window = text[i : i + MIN]
            if window in seen:
                gone[i : i + MIN] = b"\1" * MIN
            seen.add(window)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.append((sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
