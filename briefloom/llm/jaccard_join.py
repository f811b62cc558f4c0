"""N-gram Jaccard join of documents by a size-aware heavy-light join.

A document is the set of its distinct 5-word shingles. Two sets link when their Jaccard similarity reaches the
threshold; with o shared shingles that is o >= t / (1 + t) * (n + m).

Small sets. A set of at most ``boundary`` shingles lists, for each size of a partner, all its subsets of as many shingles
as the two need to share, with both sizes. Small sets link exactly when they have such a subset of their two sizes in
common, so each set of a subset's list is linked to the least set of the other size, and nothing is compared.

Large sets. All shingles have one global order, from the rare to the frequent ones. Sets that link share one of their
first n - ceil(t n) + 1 shingles, so an inverted list is kept for those. Frequencies are counted over all documents, in a
packed exchange between blocks of texts and ranges of keys. A key is the leading bits of a shingle's hash, some more bits
than there are shingles; where two shingles share a key they count as one, which may only change the order. Shingles that
no second set has are in no list. Sets just under the boundary are in both structures, since they may link with larger ones.

The boundary is the largest size up to which listing subsets costs fewer rows than scanning lists of the mean length.

Linking. Equal sets are one node from the start. A list of two sets is one pair to compare. The head of a longer list is the set that has the list's shingle nearest to its
front, that is with the fewest rarer shingles before it: the original among its near copies. Each set names the head that
most of its lists share, as long as the two are in different components, fit in size and have room: behind the list's
shingle both still hold as many shingles as they need to share. These pairs, one for each set at most, are compared by
their texts, in two rounds. A list whose sets are in one component is done. In what is left, sets that can have no partner in the list are taken out by the sizes they would need, and the remaining pairs are
compared, but never two sets of the list's largest component. So no link between different texts is lost, and no group
of copies is spelled out in pairs.

Defined cases: a null or empty text, or one without words, has no shingle, links with nothing and is its own component;
a text of fewer than five words has its word sequence as the only shingle; rows that share an id are linked by their
texts alone and each get a row; rows with a null id are linked by their texts and take the smallest id of their component,
null if there is none; texts are used whole; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import byte_texts, discard, give_back, mix64, read_table, text_slices, tidy, written
from briefloom.llm.components import connected_components
from briefloom.llm.exchange import ANSWERS, KEYS, Range, answered, asked
from briefloom.llm.shingles import shingle_sets

#: Bytes of text of a block, and of the slices whose shingles a task hashes at once.
BLOCK_BYTES, SLICE = 8 << 20, 2 << 20
#: Bits of a key beyond those that number all bytes of text, and so all shingles.
MORE_BITS = 10


def needed_overlap(n: int, m: int, percent: int) -> int:
    """Shared shingles that sets of n and m need to link."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(max(1, -(-percent * n // 100)), 100 * n // percent + 1)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int, boundary: int) -> list[tuple[int, int]]:
    """(partner's size, shingles to share) for all small partners."""
    return [(m, o) for m in partner_sizes(n, percent) if m <= boundary and (o := needed_overlap(n, m, percent)) <= min(n, m)]


def choose_boundary(mean_list: float, percent: int) -> int:
    """The largest size for which subsets cost no more rows than inverted lists of the mean length, size by size."""
    size = 1
    while sum(math.comb(size + 1, c) for _, c in subset_sizes(size + 1, percent, 2 * size)) <= prefix_length(size + 1, percent) * (1 + mean_list):
        size += 1
    return size


def set_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each text's set; zeros without shingles."""
    full = np.flatnonzero(sizes)
    ids = np.zeros((len(sizes), 2), np.uint64)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for side, salt in enumerate((0, 0x5851F42D4C957F2D)):
            ids[full, side] = mix64(np.add.reduceat(mix64(hashes ^ np.uint64(salt)), starts) + sizes[full].astype(np.uint64))
    return ids


def as_binary(ids: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(ids).tobytes())
    array = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(0, 16 * len(ids) + 1, 16, dtype=np.int32).tobytes()), data])
    return array if mask is None else where(~mask, array)


def where(chosen: np.ndarray, array: pa.Array) -> pa.Array:
    """The array with nulls where not chosen."""
    return array.take(pa.array(np.arange(len(array)), mask=~chosen))


def subset_key(shingles: np.ndarray, n: int, m: int) -> bytes:
    """A key of a set of shingles and of the sizes of the two sets that it stands for."""
    sizes = np.uint64((min(n, m) << 32) + max(n, m))
    return b"".join(mix64(np.array([np.add.reduce(mix64(shingles ^ np.uint64(salt))) + sizes], np.uint64)).tobytes() for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25))


def cut_blocks(batches: Iterable[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: its number, bytes of text, and ids and texts as a compressed Arrow stream."""
    held: list[pa.RecordBatch] = []
    made = size = 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | made]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "rows"])

    for batch in text_slices(batches, "text", SLICE):
        held.append(batch)
        size += pa.compute.sum(pa.compute.binary_length(batch["text"])).as_py() or 0
        if size >= BLOCK_BYTES:
            yield block()
            held, size, made = [], 0, made + 1
    if held:
        yield block()


class Block:
    """The texts of a block as ordered sets, slice by slice, and its distinct keys with the number of sets that have them."""

    def __init__(self, rows: bytes, size: int, bits: int):
        self.shift = np.uint64(64 - bits)
        with pa.ipc.open_stream(rows) as stream:
            self.slices = list(text_slices(stream.read_all().combine_chunks().to_batches(), "text", SLICE))
        self.sets = [shingle_sets(s["text"], size)[:2] for s in self.slices]
        self.ids = [set_ids(*s) for s in self.sets]
        self.first: list[np.ndarray] = []
        seen: set[bytes] = set()
        cells = [np.zeros(0, np.uint64)]
        for (hashes, sizes), ids in zip(self.sets, self.ids, strict=True):
            first = np.zeros(len(sizes), bool)
            for i in np.flatnonzero(sizes).tolist():
                if (own := ids[i].tobytes()) not in seen:
                    seen.add(own)
                    first[i] = True
            self.first.append(first)
            cells.append(hashes[np.repeat(first, sizes)] >> self.shift)
        self.keys, self.counts = np.unique(np.concatenate(cells), return_counts=True)


def frequency_class(times: np.ndarray) -> np.ndarray:
    """0 for what one set has, and more for more frequent shingles."""
    return np.where(times > 1, np.minimum(1 + 4 * np.log2(times), 255), 0).astype(np.uint8)


def count_keys(table: pa.Table) -> pa.Table:
    """Of one range: each key's frequency class for the blocks, and what tells the mean length of a list."""
    own = Range(table)
    times = own.sums("counts", np.uint32)
    shared = times[times > 1]
    rows = len(own.table)
    more = {"lists": [len(shared)] + [0] * (rows - 1), "entries": [int(shared.sum())] + [0] * (rows - 1)}
    return pa.table(own.answers(own.spread(frequency_class(times))) | {k: pa.array(v, pa.int64()) for k, v in more.items()})


def sign(block: pa.Table, answers: pa.Table, percent: int, size: int, bits: int, boundary: int) -> pa.Table:
    """Of one block: a row for each text, with list entries, subsets and the text itself where it is the block's first of its set."""
    own = Block(block["rows"][0].as_py(), size, bits)
    classes = answered(answers, np.uint8)
    out = []
    for batch, (hashes, sizes), ids, first in zip(own.slices, own.sets, own.ids, own.first, strict=True):
        starts = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(sizes)), sizes)
        rank = classes[np.searchsorted(own.keys, hashes >> own.shift)] if len(hashes) else np.zeros(0, np.uint8)
        order = np.lexsort((hashes, rank, text))
        hashes, rank = hashes[order], rank[order]
        at = np.arange(len(hashes)) - starts[text]
        n = sizes[text]
        large = 100 * sizes >= percent * (boundary + 1)
        entry = (rank > 0) & (at < n + (-percent * n // 100) + 1) & (first & large)[text]
        entries = np.bincount(text[entry], minlength=len(sizes))
        equal: list[list[bytes] | None] = [None] * len(sizes)
        cross: list[list[bytes] | None] = [None] * len(sizes)
        for i in np.flatnonzero(first & (sizes <= boundary)).tolist():
            k = int(sizes[i])
            words = hashes[starts[i] : starts[i] + k]
            found = [(m, subset_key(words[list(c)], k, m)) for m, o in subset_sizes(k, percent, boundary) for c in combinations(range(k), o)]
            equal[i], cross[i] = [key for m, key in found if m == k], [key for m, key in found if m != k]
        pairs = pa.StructArray.from_arrays([pa.array(hashes[entry].view(np.int64)), pa.array(at[entry], pa.int32())], ["key", "at"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(entries)]), pa.int32()), pairs)
        texts = where(entries > 0, batch["text"])
        digests = pa.array([hashlib.sha256(t).digest() for t in byte_texts(batch["text"])], pa.binary())
        columns = [batch["_id"], digests, as_binary(ids, sizes == 0), pa.array(sizes, pa.int64()), lists, pa.array(equal, pa.list_(pa.binary())), pa.array(cross, pa.list_(pa.binary())), texts]
        out.append(pa.table(columns, ["_id", "digest", "set_id", "n", "entries", "equal", "cross", "text"]))
    del own
    give_back()
    return pa.concat_tables(out)


SIGNED = "digest binary, set_id binary, n long, entries array<struct<key: long, at: int>>, equal array<binary>, cross array<binary>, text string"


def signatures(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The signed rows of all texts, with the shingles of all documents in the order of their frequencies."""
    kind = docs.schema["_id"].dataType.simpleString()
    blocks = written(docs.mapInArrow(lambda batches: cut_blocks(batches, TaskContext.get().partitionId()), "block long, size long, rows binary"), "text-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-total // BLOCK_BYTES))
    bits = min(64, max(16, total.bit_length() + MORE_BITS))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch["block"].to_pylist(), batch["rows"], strict=True):
                block = Block(rows.as_py(), size, bits)
                yield from asked(number, block.keys, bits, ranges, {"counts": block.counts.astype(np.uint32)}).to_batches()

    counted = blocks.select("block", "rows").mapInArrow(tidy(ask), f"{KEYS}, counts binary").groupBy("range").applyInArrow(count_keys, f"{ANSWERS}, lists long, entries long")
    counted = written(counted, "shingle-classes")
    sums = counted.agg(F.sum("lists").alias("lists"), F.sum("entries").alias("entries")).first()
    boundary = choose_boundary((sums["entries"] or 0) / max(1, sums["lists"] or 0), percent)
    met = blocks.select("block", "rows").groupBy("block").cogroup(counted.select("block", "range", "n", "found").groupBy("block"))
    signed = written(met.applyInArrow(lambda rows, answers: sign(rows, answers, percent, size, bits, boundary), f"_id {kind}, {SIGNED}"), "signatures")
    discard(blocks)
    discard(counted)
    return signed


def small_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) of small sets: each set of a subset's list to the least one that it links with there."""
    links = []
    for column, meets in (("equal", F.col("size") == F.col("n")), ("cross", F.col("size") != F.col("n"))):
        rows = sets.select(F.explode(column).alias("key"), "set_id", "n")
        heads = rows.groupBy("key", F.col("n").alias("size")).agg(F.min("set_id").alias("head"))
        met = rows.join(heads, "key").where(meets & (F.col("set_id") != F.col("head")))
        links.append(met.select(*_pair(F.col("set_id"), F.col("head"))))
    return links[0].unionByName(links[1]).distinct()


def largest_partner(n: Column, at: Column, percent: int) -> Column:
    """The size up to which a partner is near enough and can share enough shingles from place ``at`` on."""
    return F.least(F.floor((n - at) * (100 + percent) / percent) - n, F.floor(n * 100 / percent))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    known = lists.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    return known.withColumn("component", F.coalesce("component", "set_id"))


def list_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of lists of two sets that have room for one another, and the rows of longer lists."""
    entry = F.struct("set_id", "n", "most")
    lists = written(rows.groupBy("key").agg(F.count("*").alias("sets"), F.min(entry).alias("x"), F.max(entry).alias("y")).where("sets > 1"), "list-ends")
    pairs = lists.where("sets = 2 and x.n <= y.most and y.n <= x.most").select(*_pair(F.col("x.set_id"), F.col("y.set_id"))).distinct()
    return pairs, rows.join(lists.where("sets > 2").select("key"), "key")


def named_heads(lists: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs (a, b) not tested yet: each set with the head that most of its lists share."""
    known = _labelled(lists, labels)
    heads = known.groupBy("key").agg(F.min(F.struct("at", "n", "set_id", "component", "most")).alias("head"), F.min("component").alias("low"), F.max("component").alias("high"))
    met = known.join(heads.where("low != high").select("key", "head"), "key")
    met = met.where((F.col("component") != F.col("head.component")) & (F.col("head.n") <= F.col("most")) & (F.col("n") <= F.col("head.most")))
    named = met.groupBy("set_id", F.col("head.set_id").alias("head")).agg(F.count("*").alias("times")).select("set_id", "head", "times", *_pair(F.col("set_id"), F.col("head")))
    named = named.join(tested, ["a", "b"], "left_anti")
    best = named.groupBy("set_id").agg(F.max_by(F.struct("a", "b"), F.struct("times", "head")).alias("pair"))
    return best.select("pair.*").distinct()


def remaining_pairs(lists: DataFrame, labels: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that can share enough shingles from their list's shingle on, and are not tested yet.

    Lists are cut by size class, so that a set meets partners of its own or the next smaller class. The smaller set of a
    pair must have room for one of its own size, so the least size of such sets tells which larger ones can stay.
    """
    step = math.log(100 / percent) if percent < 100 else None
    klass = F.floor(F.log("n") / step + 1e-9) if step else F.col("n")
    known = written(_labelled(lists, labels).withColumn("class", klass.cast("long")), "labelled-lists")
    key = ["key", "class"]
    smaller = known.where(F.col("most") >= F.col("n"))
    larger = known.unionByName(known.withColumn("class", F.col("class") - 1)) if step else known
    bounds = smaller.groupBy(*key).agg(F.min("n").alias("least"), F.min("component").alias("low"), F.max("component").alias("high"))
    alone = (F.col("low") == F.col("high")) & (F.col("low") == F.col("component"))
    larger = written(larger.join(bounds, key).where((F.col("most") >= F.col("least")) & ~alone).drop("least", "low", "high"), "larger-sets")
    counts = larger.groupBy(*key, "component").agg(F.count("*").alias("sets"), F.max("most").alias("most"))
    tops = counts.groupBy(*key).agg(F.max_by("component", F.struct("sets", "component")).alias("top"), F.max("most").alias("reach"), F.min("component").alias("low"), F.max("component").alias("high"))
    smaller = smaller.join(tops, key).where((F.col("reach") >= F.col("n")) & ~alone)
    smaller = written(smaller.select(*key, "set_id", "n", "most", "component", "top"), "smaller-sets")
    larger = larger.join(tops.select(*key, "top"), key)
    pairs = []
    for part, rest in ((smaller.where("component != top"), larger), (smaller.where("component = top"), larger.where("component != top"))):
        x, y = part.alias("x"), rest.alias("y")
        meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.component") != F.col("y.component"))
        room = (F.col("x.n") <= F.col("y.n")) & (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most"))
        pairs.append(x.join(y, meet & room).select(*_pair(F.col("x.set_id"), F.col("y.set_id"))))
    return pairs[0].unionByName(pairs[1]).distinct().join(tested, ["a", "b"], "left_anti")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) of set ids that link, compared shingle by shingle."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    texts = written(texts.join(wanted, "set_id"), "set-texts")
    met = pairs.join(texts.select(F.col("set_id").alias("a"), "text"), "a")
    met = met.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "text", "other")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            left, n = shingle_sets(batch["text"], size)[:2]
            right, m = shingle_sets(batch["other"], size)[:2]
            rows = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
            both = np.concatenate([left, right])
            order = np.lexsort((both, rows))
            rows, both = rows[order], both[order]
            same = (rows[1:] == rows[:-1]) & (both[1:] == both[:-1])
            shared = np.bincount(rows[1:][same], minlength=len(n))
            yield batch.filter(pa.array(100 * shared >= percent * (n + m - shared))).select(["a", "b"])

    links = written(met.mapInArrow(tidy(compare), "a binary, b binary"), "links")
    discard(texts)
    return links


def linked_rows(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """_id, digest of the text, n, set_id and component (a set id) of every row; the last two are null without shingles."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    signed = signatures(docs, percent, size)
    sets = signed.where((F.size("entries") > 0) | F.col("equal").isNotNull())
    sets = sets.groupBy("set_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "entries", "equal", "cross", "text")])
    sets = written(sets, "sets")
    lists = sets.select("set_id", "n", F.explode("entries").alias("e")).select("set_id", "n", "e.*")
    pairs, lists = list_pairs(lists.withColumn("most", largest_partner(F.col("n"), F.col("at"), percent)))
    pairs, lists = written(pairs, "list-pairs"), written(lists, "lists")
    texts = sets.select("set_id", "text")
    links = written(small_links(sets), "links")
    nothing = links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    tested = written(pairs.unionByName(named_heads(lists, nothing, pairs)), "first-pairs")
    links = links.unionByName(verified(tested, texts, percent, size))
    labels = connected_components(links)
    again = written(named_heads(lists, labels, tested), "second-pairs")
    links = links.unionByName(verified(again, texts, percent, size))
    labels = connected_components(links)
    more = written(remaining_pairs(lists, labels, tested.unionByName(again), percent), "remaining-pairs")
    if not more.isEmpty():
        links = links.unionByName(verified(more, texts, percent, size))
        labels = connected_components(links)
    out = signed.select("_id", "digest", "n", "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    return out.withColumn("component", F.coalesce("component", "set_id"))


def jaccard_components(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_shingles, set_id and component_id (the smallest id that links reach) of every row of ``docs``."""
    rows = written(linked_rows(docs, percent, size, id_col, text_col), "linked-rows")
    least = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("_id").alias("component_id"))
    out = rows.join(least, "component", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "set_id", F.when(F.col("component").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with the columns of ``docs``, the one with the smallest id; rows without words stay.

    Ids that are null come last. Of rows with equal id and text one stays.
    """
    rows = written(linked_rows(docs, percent, 5, id_col, text_col), "linked-rows").where(F.col("component").isNotNull())
    named = rows.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("late"), "_id", "digest")).alias("kept"))
    named = named.select(F.col("kept._id").alias("_kept"), F.col("kept.digest").alias("_digest"))
    times = rows.groupBy(F.col("_id").alias("_kept"), F.col("digest").alias("_digest")).agg(F.count("*").alias("times")).where("times > 1")
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_kept"), F.col(text_col).alias("_text"))
    words = F.coalesce(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = packed.withColumn("_digest", F.when(words, F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))).drop("_text")
    same = lambda a, b: (a["_kept"].eqNullSafe(b["_kept"])) & (a["_digest"] == b["_digest"])
    stays = keyed.join(named, same(keyed, named), "left_semi")
    times = written(times.join(named, same(times, named), "left_semi").select("_kept", "_digest"), "repeated-rows")
    if not times.isEmpty():
        repeated = stays.join(times, same(stays, times), "left_semi").dropDuplicates(["_kept", "_digest"])
        stays = stays.join(times, same(stays, times), "left_anti").unionByName(repeated)
    return stays.unionByName(keyed.where(F.col("_digest").isNull())).select("_row.*")


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
