"""SimHash near duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

A fingerprint's bit is the majority of that bit over the XXH64 hashes of a text's word shingles. Every bit position gets a
vector of ``radius + 1`` bits, dealt in turn over all but the zero vector. A table belongs to each vector v but zero, and
keeps of a fingerprint the positions whose vector has an odd product with v. The vectors of ``radius`` positions or fewer
leave some v orthogonal to all of them, so fingerprints that differ at those positions alone are equal in v's table:
every pair within the radius meets in one of ``2**(radius + 1) - 1`` tables.

Equal fingerprints count once. A bucket of few fingerprints is compared within itself, and states a forest of its links,
not its pairs. A bucket of more than ``most`` is covered again by the same construction over the positions that its table
left out, which keeps the guarantee, until buckets are small: with few positions left, few fingerprints fit. ``most``
moves work only; results are the same at every value.

Defined cases: a text that is null, empty or blank has fingerprint zero, which links like any other; a text of fewer words
than a shingle has its whole sequence as one; texts have any length and are hashed in pieces; rows with a null id are
fingerprinted and link others, but give no component its number, which is null where all ids are; repeated rows each
count; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import byte_texts, discard, read_table, text_slices, tidy, written
from briefloom.llm.components import connected_components

BITS, SEED = 64, 42
#: Shingles that are counted at once, and fingerprints of a bucket that are compared with one another.
PIECE, MOST = 1 << 16, 48
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of a text's shingles of ``size`` words, A-Z lower-cased; zero without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), PIECE):
        places = zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in places], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row; ``fp`` holds the 64 bits as a signed number."""

    @tidy
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = np.array([fingerprint(text, size) for text in byte_texts(batch["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(hashed, "id long, fp long")


def covering_masks(free: int, radius: int) -> list[int]:
    """For each table the positions of ``free``, a set of bits, that it keeps."""
    vectors = sorted(range(1, 2 << radius), key=lambda v: (v.bit_count(), v))  # unit vectors first: no table is without one
    places = [i for i in range(BITS) if free >> i & 1]
    dealt = {i: vectors[k % len(vectors)] for k, i in enumerate(places)}
    masks = (sum(1 << i for i, m in dealt.items() if (m & v).bit_count() % 2) for v in vectors)
    return sorted(set(masks))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _in_tables(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """(mask, key, fp): what every table keeps of every row; ``masks`` names the tables that follow a row's mask."""
    shape = "mask long, next array<long>"
    tables = rows.sparkSession.createDataFrame([(_signed(m), [_signed(x) for x in more]) for m, more in masks.items()], shape)
    # A few hundred rows at most: the number of tables depends on the radius and on the levels alone.
    met = rows.join(F.broadcast(tables), "mask").select("fp", F.explode("next").alias("mask"))
    return met.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is connected within the radius, one less than the members of each connected set."""
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    near, open_, links = apart <= radius, np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if open_[start]:
            open_[start], waiting = False, [start]
            while waiting:
                i = waiting.pop()
                met = np.flatnonzero(near[i] & open_)
                open_[met] = False
                waiting.extend(met.tolist())
                links.extend((i, j) for j in met.tolist())
    return links


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["fps"]
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten()).view(np.uint64)
            starts = np.cumsum(sizes) - sizes
            pairs = starts[sizes == 2]
            a, b = flat[pairs], flat[pairs + 1]
            near = np.bitwise_count(a ^ b) <= radius
            found = [np.stack([a[near], b[near]])]
            for start, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                fps = flat[start : start + n]
                if links := forest(fps, radius):
                    found.append(fps[np.array(links).T])
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return buckets.mapInArrow(compared, "a long, b long")


def near_links(fps: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` that connect all that differ in ``radius`` bits or fewer."""
    most = max(most, 2 << radius)
    rows, level = fps.select("fp", F.lit(0).cast("long").alias("mask")), {0: covering_masks((1 << BITS) - 1, radius)}
    links, before = None, None
    while True:
        tables = _in_tables(rows, level)
        if links is not None:  # tables of two kinds can keep the same positions between them
            tables = tables.distinct()
        sizes = tables.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        met = written(tables.join(sizes, ["mask", "key"]), "tables")
        if before is not None:
            discard(before)
        before = met
        light = met.where(F.col("n") <= most).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found = written(_bucket_links(light, radius), "links")
        links = found if links is None else links.unionByName(found)
        rows = met.where(F.col("n") > most).select("fp", "mask")
        if rows.isEmpty():
            discard(met)
            return links
        whole = (1 << BITS) - 1
        level = {m: [m | x for x in covering_masks(whole & ~m, radius)] for masks in level.values() for m in masks}


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, most: int = MOST) -> DataFrame:
    """(id, fp, component_id) of every row; the component is the smallest id that links reach."""
    rows = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    firsts = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    links = near_links(firsts, radius, most)
    labels = connected_components(links)
    grouped = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(grouped.join(least, "component").select("fp", "component_id"), "named")
    for table in (firsts, labels):
        discard(table)
    return rows.join(named, "fp").select("id", "fp", "component_id")


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
