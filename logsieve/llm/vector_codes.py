"""Vector compression into codes of four bytes: product quantisation with memoised grid cells.

A vector's components become integers ``floor(1024 x)`` and the vector is cut into equal consecutive
parts. Every part position has a codebook of up to 256 entries; a code is the index of the nearest entry
of each part. The codebooks are trained by rounds of assignment and integer means over all vectors.

Method. An assignment hashes the part's coarse grid cell. For a cell that is new to the task, the least
and the greatest distance from the cell's box to every entry are summed up dimension by dimension; an
entry whose least distance exceeds another's greatest is dominated all over the box and can't be nearest
there. The others are cached under the cell, and only they are evaluated exactly. So a part whose cell is
known costs the entries left, and results equal those of comparing all entries.

On Spark, every round is one narrow pass: each task adds up its own sums and counts by part and entry, which
Spark's partial aggregate brings together; the driver holds the codebooks only (``parts`` x ``entries`` x width
numbers), which travel with the tasks. The input is read once a round, and once more for the codes; pass a
written table. Labels that hold over a thousandth of the rows are joined by broadcast, the others by a
shuffle, so that no label meets in one task.

Defined results: rows whose vector is null, or holds a null or a component that isn't finite, are dropped. The
dimension is that of the kept vector of the smallest id (nulls last); vectors of another dimension, and all
vectors if it isn't a multiple of ``parts`` or is zero, keep their row with null code and error. Repeated
ids are rows of their own; the first entries are taken by id, then by vector. Fewer rows than entries: as
many entries as rows. Components beyond 2**24 after scaling count as 2**24. A label's error is null if no row of
it has one. Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import cut

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Width of a grid cell, in scaled units.
CELL = 64
#: Cells that a task keeps for a part position before it starts anew.
CACHE_CELLS = 1 << 15
#: Integers are held to this size, so that a squared distance fits 64 bits.
LARGEST = 1 << 24
#: Parts looked up at a time.
SLICE = 1024
#: A label with over one HOT-th of the rows is joined by broadcast; there are fewer than HOT.
HOT = 1000


class Cells:
    """Nearest entries of one part's codebook, by memoised grid cells."""

    def __init__(self, book: np.ndarray, cell: int = CELL, most: int = CACHE_CELLS):
        self.book, self.cell, self.most = book, cell, most
        self.at: dict[bytes, int] = {}
        self.left = np.zeros((0, len(book)), dtype=bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell (row of grid coordinates), which entries may be nearest somewhere in its box."""
        least = np.zeros((len(cells), len(self.book)), dtype=np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            steps, inverse = np.unique(cells[:, d], return_inverse=True)
            low = (steps * self.cell)[:, None]
            below, above = low - self.book[None, :, d], self.book[None, :, d] - (low + self.cell - 1)
            least += (np.maximum(np.maximum(below, above), 0) ** 2)[inverse]
            most += (np.maximum(np.abs(below), np.abs(above)) ** 2)[inverse]
        return least <= most.min(axis=1)[:, None]

    def entries_of(self, cells: np.ndarray) -> np.ndarray:
        """The cached entries of each of the distinct ``cells``; those of new cells are found and kept."""
        keys = [c.tobytes() for c in cells]
        if len(self.at) + len(keys) > self.most:
            self.at, self.left = {}, self.left[:0]
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            for i in new:
                self.at[keys[i]] = len(self.at)
            self.left = np.concatenate([self.left, self.undominated(cells[new])])
        return self.left[[self.at[k] for k in keys]]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row of ``x``; ties go to the lower entry."""
        out, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for lo in range(0, len(x), SLICE):
            part = x[lo:lo + SLICE]
            cells, inverse = np.unique(np.floor_divide(part, self.cell), axis=0, return_inverse=True)
            row, entry = np.nonzero(self.entries_of(np.ascontiguousarray(cells))[inverse.reshape(-1)])
            gap = part[row] - self.book[entry]
            d = np.einsum("ij,ij->i", gap, gap)
            best = np.minimum.reduceat(d, np.searchsorted(row, np.arange(len(part))))
            hit = np.flatnonzero(d == best[row])
            _, first = np.unique(row[hit], return_index=True)
            out[lo:lo + SLICE], far[lo:lo + SLICE] = entry[hit[first]], best
        return out, far


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows whose vector is whole and finite."""
    v = F.col(f"`{vector_col}`")
    return vectors.where(v.isNotNull() & F.forall(v, lambda x: F.abs(x) < F.lit(float("inf")))).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.cast("array<double>").alias("v"))


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors have ``width`` components, their scaled integers as a matrix)."""
    ends = np.diff(column.offsets.to_numpy())
    fits = ends == width
    flat = column.flatten().to_numpy(zero_copy_only=False)[np.repeat(fits, ends)]
    scaled = np.clip(np.floor(flat * float(SCALE)), -LARGEST, LARGEST).astype(np.int64)
    return fits, scaled.reshape(-1, width)


def _sums(books: list[np.ndarray], width: int, cell: int):
    """Sums and counts of the parts that each entry is nearest to, of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, w = [Cells(b, cell) for b in books], width // len(books)
        sums = [np.zeros(b.shape, dtype=np.int64) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            _, x = integers(batch.column("v"), width)
            for p, c in enumerate(cells):
                entry, _ = c.nearest(x[:, p * w:p * w + w])
                counts[p] += np.bincount(entry, minlength=len(books[p]))
                np.add.at(sums[p], entry, x[:, p * w:p * w + w])
        for p in range(len(books)):
            some = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), p, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[p][some]),
                 pa.array(list(sums[p][some]), type=pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def _codes(books: list[np.ndarray], width: int, cell: int):
    """Codes and errors of all vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, w = [Cells(b, cell) for b in books], width // len(books) if books else 0
        for batch in batches:
            code, error = np.full(batch.num_rows, None, dtype=object), np.full(batch.num_rows, None, dtype=object)
            if books:
                fits, x = integers(batch.column("v"), width)
                found = [c.nearest(x[:, p * w:p * w + w]) for p, c in enumerate(cells)]
                at = np.flatnonzero(fits)
                code[at] = [bytes(c).hex() for c in np.stack([e for e, _ in found], axis=1).astype(np.uint8)]
                error[at] = [int(e) for e in np.sum([d for _, d in found], axis=0)] if len(at) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(code.tolist(), type=pa.string()),
                 pa.array(error.tolist(), type=pa.int64())], names=["id", "label", "code", "error"])
    return run


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
          cell: int = CELL) -> tuple[list[np.ndarray], int]:
    """The codebooks (an integer matrix for each part; none if the vectors can't be cut) and the dimension."""
    if not 1 <= entries <= 256:
        raise ValueError("a part of a code has two hex digits: 1 to 256 entries")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    width = len(first[0].v) if first else 0
    if not width or width % parts:
        return [], width
    start = [r.v for r in first if len(r.v) == width]
    if len(start) < entries:  # vectors of other dimensions were among the first
        start = [r.v for r in rows.where(F.size("v") == width).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    x = np.clip(np.floor(np.array(start, dtype=np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    w = width // parts
    books = [np.ascontiguousarray(x[:, p * w:p * w + w]) for p in range(parts)]
    for _ in range(rounds):
        got = rows.select("v").mapInArrow(_sums(books, width, cell), "part int, entry int, n bigint, sums array<bigint>")
        whole = got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(w)])
        books = [b.copy() for b in books]
        for r in whole.collect():  # parts x entries rows at most
            books[r[0]][r[1]] = [s // r[2] for s in r[3:]]
    return books, width


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> DataFrame:
    """(id_col, label_col, code, error, label_error, codebooks_sha256) for every kept vector."""
    rows = kept(vectors, id_col, vector_col, label_col)
    books, width = train(rows, parts, entries, rounds, cell)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded = cut(rows.mapInArrow(_codes(books, width, cell), f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"))
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    same = F.col("label").eqNullSafe(F.col("l"))
    total = coded.count()
    hot = F.broadcast(by_label.where(F.col("n") * HOT > total))
    rest = coded.join(hot.select("l"), same, "left_anti").join(by_label, same)
    return coded.join(hot, same).unionByName(rest).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def duckdb_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same result from ``embeddings`` by comparing all entries, for vectors of one dimension."""
    out = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x
  FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})"""
    for i in range(rounds + 1):
        out += f""",
near{i} AS MATERIALIZED (
  SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS m FROM (
    SELECT vec_id, parts.p, label, x, e, CAST(list_inner_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[]))
      - 2 * list_inner_product(CAST(x AS DOUBLE[]), CAST(c AS DOUBLE[])) + list_inner_product(CAST(c AS DOUBLE[]), CAST(c AS DOUBLE[])) AS BIGINT) AS d
    FROM parts JOIN book{i} USING (p)) GROUP BY vec_id, p)"""
        if i < rounds:
            out += f""",
book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book{i} b LEFT JOIN (
    SELECT p, e, list(s ORDER BY k) AS c FROM (
      SELECT p, m.e AS e, k, CAST(floor(sum(x[k]) / count(*)) AS BIGINT) AS s FROM near{i}, range(1, 10000) r(k) WHERE k <= len(x) GROUP BY 1, 2, 3)
    GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)"""
    return out + f""",
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""
