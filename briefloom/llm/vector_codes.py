"""Product codes of vectors: every part of a vector becomes the number of its nearest codebook entry, in exact integers.

Components are ``floor(256 * x)``. The codebooks start from the vectors of the smallest ids and are replaced by floored
means for a stated number of rounds. A task assigns its rows by exponion search and sums the parts of each entry; the sums
of all tasks meet by (part, entry), so that only codebooks, whose size the parameters fix, come to the driver. A round
writes each row's codes beside its components, because the next search starts from them.

Exponion search: let u be the squared distance of a part to the entry that it had before. An entry that is as near lies, by
the triangle inequality, within 2 * sqrt(u) of that entry, hence within 4 * u in squared distance. Entries are listed by
their squared distance to one another, and a part's list is read up to 4 * u inclusive. The nearest entry is the least by
(squared distance, index), so ties go to the lower index, also against the entry that the search starts from.

Sums are exact in 64 bits: vectors with components of 2**26 or more after flooring are refused with an error that says so,
because their distances, or sums of them, need not fit.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part and have no row in the
result; so do vectors of another length than that of the first vector; a length that the parts do not divide is an error;
rows with a null id are coded, but start no codebook while there are others; equal ids start in the order of their vectors;
fewer vectors than entries start a codebook of as many entries, repeats included; an entry without parts stays as it was;
null labels are one label; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import discard, read_table, tidy, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components at or beyond this are refused; rows that a task searches at once.
LARGEST, SLICE = 1 << 26, 8192


def quantised(vector: Column) -> Column:
    """Integer components, null for a vector that takes no part."""
    wide = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(wide(x)) | (F.abs(wide(x)) == float("inf")))
    large = F.exists(vector, lambda x: (wide(x) * 256 >= LARGEST) | (wide(x) * 256 < -LARGEST))
    parts = F.transform(vector, lambda x: F.floor(wide(x) * 256).cast("int"))
    checked = F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).otherwise(parts)
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, checked)


class Neighbours:
    """A part's codebook with, for each entry, all entries by (squared distance to it, index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, points: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point its nearest entry and the squared distance, searched from the entry that it had before."""
        best = before.copy()
        least = ((points - self.entries[before]) ** 2).sum(1)
        by_entry = np.argsort(before, kind="stable")
        bounds = np.searchsorted(before[by_entry], np.arange(len(self.entries) + 1))
        for entry in range(len(self.entries)):
            rows = by_entry[bounds[entry] : bounds[entry + 1]]
            if not len(rows):
                continue
            # Entries within the radius, for each row; rows with long lists first, so that those still reading are a prefix.
            reach = np.searchsorted(self.apart[entry], 4 * least[rows], side="right")
            rows = rows[np.argsort(-reach, kind="stable")]
            reading = np.searchsorted(np.sort(-reach), -np.arange(int(reach.max()) + 1), side="left")
            for place in range(int(reach.max())):
                open_ = rows[: reading[place]]
                other = self.order[entry, place]
                distance = ((points[open_] - self.entries[other]) ** 2).sum(1)
                nearer = (distance < least[open_]) | ((distance == least[open_]) & (other < best[open_]))
                best[open_[nearer]], least[open_[nearer]] = other, distance[nearer]
        return best, least


def _vectors(array: pa.Array) -> np.ndarray:
    return np.asarray(array.flatten(), dtype=np.int64).reshape(len(array), -1)


def assign(books: np.ndarray, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances (rows, parts) under ``books`` (parts, entries, width)."""
    parts, _, width = books.shape
    codes, errors = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), np.int64)
    for p in range(parts):
        points = vectors[:, p * width : (p + 1) * width]
        codes[:, p], errors[:, p] = Neighbours(books[p]).nearest(points, before[:, p])
    return codes, errors


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _before(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint16)
    return codes.reshape(-1, parts).astype(np.int64)


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with each row's codes by ``books``, searched from its codes so far."""

    @tidy
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes, _ = assign(books, _vectors(batch["parts"]), _before(batch, len(books)))
            made = [c.tobytes() for c in codes.astype(np.uint16)]
            yield batch.set_column(batch.schema.get_field_index("code"), "code", pa.array(made, pa.binary()))

    return rows.mapInArrow(code, rows.schema)


def _sums(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, n, sums) over all rows; a task states one row for each entry that it has used."""
    parts, entries, width = shape

    @tidy
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(shape, np.int64)
        for batch in _slices(batches):
            vectors, codes = _vectors(batch["parts"]), _before(batch, parts)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
        at = np.argwhere(counts)
        columns = [pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(counts[tuple(at.T)]), pa.array(list(sums[tuple(at.T)]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    stated = rows.select("parts", "code").mapInArrow(add, "part long, entry long, n long, sums array<long>")
    flat = stated.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
    return flat.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def _first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of the vectors with the smallest ids, which alone come to the driver."""
    first = rows.orderBy(F.asc_nulls_last("id"), "parts").select("parts").limit(1).collect()
    if not first:
        return None
    width, rest = divmod(len(first[0]["parts"]), parts)
    if rest:
        raise ValueError(f"{parts} parts do not divide vectors of {len(first[0]['parts'])} components")
    same = rows.where(F.size("parts") == width * parts)
    picked = np.array([r["parts"] for r in same.orderBy(F.asc_nulls_last("id"), "parts").select("parts").limit(entries).collect()], np.int64)
    return picked.reshape(len(picked), parts, width).transpose(1, 0, 2).copy()


def code_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(id, kept columns as a struct ``row``, codes, error) of every vector that takes part, and the codebooks."""
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), kept.alias("row"), quantised(F.col(vector_col)).alias("parts")).where("parts IS NOT NULL")
    books = _first_books(rows, parts, entries)
    if books is None:
        return rows.select("id", "row", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), None
    width = books.shape[2]
    unread = F.unhex(F.lit("0000" * parts))  # before the first round the search starts from entry 0
    rows = rows.where(F.size("parts") == width * parts).withColumn("code", unread)
    before = None
    for number in range(rounds):
        rows = written(_coded(rows, books), f"codes{number}")
        found = _sums(rows, books.shape).collect()  # parts * entries * width numbers at most
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"], r["place"]] = r["value"] // r["n"]
        if before is not None:
            discard(before)
        before = rows

    @tidy
    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes, errors = assign(books, _vectors(batch["parts"]), _before(batch, parts))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["row"], pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(errors.sum(1))], ["id", "row", "codes", "error"])

    shape = f"id long, row {rows.schema['row'].dataType.simpleString()}, codes array<int>, error long"
    return rows.mapInArrow(last, shape), books


def books_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


def vector_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = code_vectors(read_table(spark, sf_dir, "embeddings"), keep=("label",))
    found = written(found, "coded")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    label = [F.col("row.label").isNull().alias("unlabelled"), F.coalesce(F.col("row.label").cast("string"), F.lit("")).alias("label")]
    rows = found.select(F.col("id").alias("vec_id"), code.alias("code"), "error", *label)
    errors = rows.groupBy("unlabelled", "label").agg(F.sum("error").alias("label_error"))
    met = rows.join(errors, ["unlabelled", "label"])
    return met.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _assigned_sql(k: int) -> str:
    """a{k}: each part's nearest entry of b{k}, and its squared distance."""
    return f"""a{k} AS (
  SELECT vec_id, label, part, x, entry, distance FROM (
    SELECT v.vec_id, v.label, v.part, v.x, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda s: (s[1] - s[2]) * (s[1] - s[2])))::BIGINT AS distance FROM parts v JOIN b{k} b USING (part)
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY distance, entry) = 1)"""


def _updated_sql(k: int) -> str:
    """b{k}: floored means of the parts that a{k-1} assigns; unused entries stay."""
    return f"""b{k} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k - 1} b LEFT JOIN (
    SELECT part, entry, list(floor_mean ORDER BY place) AS x FROM (
      SELECT part, entry, place, (sum(value)::BIGINT - ((sum(value)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
      FROM (SELECT part, entry, unnest(x) AS value, generate_subscripts(x, 1) AS place FROM a{k - 1}) GROUP BY ALL) GROUP BY ALL
  ) m USING (part, entry))"""


VECTOR_CODES_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, p::INT AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) r(p)
), b0 AS (
  SELECT part, entry, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts) WHERE entry < {ENTRIES}
), {_assigned_sql(0)}, {_updated_sql(1)}, {_assigned_sql(1)}, {_updated_sql(2)}, {_assigned_sql(2)}, coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a2 GROUP BY ALL
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM coded
"""
