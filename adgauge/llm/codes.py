"""Compression of vectors to one code per part, with codebooks fitted by rounds over all vectors.

Finding the nearest entry of a part's codebook goes through memoised grid cells. A part is hashed to its coarse cell, a
box. The first time a task meets a cell it notes which entries can be nearest somewhere in the box: an entry is out if
its least distance to the box is over the largest distance of another entry to it. Only the entries noted are evaluated,
exactly and in whole numbers; ties go to the lower index, so the result does not depend on the grid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.session import cut

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
CELL_BITS = 10  # side of a cell, as a power of two of the whole-number components
CELLS = 1 << 16  # cells a task remembers per part; then it starts over
SLICE = 1 << 19  # components handled at once
CODED = "vec_id long, label string, code string, error long"
SUMS = "part int, entry int, n long, sums array<long>"


class Nearest:
    """Nearest entries of one part's codebook, by remembered cells."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS, cells: int = CELLS) -> None:
        self.entries, self.bits, self.limit = entries, bits, cells
        self.number: dict[bytes, int] = {}
        self.open = np.zeros((0, len(entries)), bool)  # by cell: the entries that can be nearest in it
        self.evaluated = 0

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """The entries that no other entry dominates across the boxes of some cells."""
        low = (cells << self.bits)[:, None, :]
        high = low + (1 << self.bits) - 1
        e = self.entries[None]
        least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(e - low), np.abs(e - high)) ** 2).sum(2)
        return least <= most.min(1, keepdims=True)

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for some points."""
        n, width = points.shape
        if not width:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        cells = np.ascontiguousarray(points >> self.bits)
        keys = cells.view(f"V{8 * width}").ravel()
        _, at, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.number) + len(at) > self.limit:
            self.number, self.open = {}, self.open[:0]
        own = [keys[i].tobytes() for i in at]
        fresh = [i for i, key in enumerate(own) if key not in self.number]
        if fresh:
            self.number.update((own[i], len(self.open) + j) for j, i in enumerate(fresh))
            self.open = np.concatenate((self.open, self._candidates(cells[at[fresh]])))
        candidates = self.open[np.array([self.number[key] for key in own])[which]]
        rows, entry = np.nonzero(candidates)
        self.evaluated += len(rows)
        distance = np.full(candidates.shape, np.iinfo(np.int64).max)
        distance[rows, entry] = ((points[rows] - self.entries[entry]) ** 2).sum(1)
        best = distance.argmin(1)
        return best, distance[np.arange(n), best]


def _points(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors of a batch as rows of whole numbers."""
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(column), -1) * SCALE).astype(np.int64)


def _assign(batches: Iterator[pa.RecordBatch], books: np.ndarray, bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """With each batch: its parts (row, part, component), their entries and squared distances (row, part)."""
    finders = [Nearest(book, bits) for book in books]
    for whole in batches:
        step = max(1, SLICE // max(books[:, 0].size, 1))
        for at in range(0, len(whole), step):
            batch = whole.slice(at, step)
            points = _points(batch).reshape(len(batch), len(books), -1)
            found = [finder.find(np.ascontiguousarray(points[:, p])) for p, finder in enumerate(finders)]
            yield batch, points, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Per part and entry: the number of parts assigned by this task and their sums."""
    n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _, points, entry, _ in _assign(batches, books, bits):
        for p in range(len(books)):
            n[p] += np.bincount(entry[:, p], minlength=books.shape[1])
            np.add.at(total[p], entry[:, p], points[:, p])
    part, used = np.nonzero(n)
    if len(part):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(used, pa.int32()), pa.array(n[part, used]), pa.array(list(total[part, used]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for batch, _, entry, distance in _assign(batches, books, bits):
        code = [bytes(row).hex() for row in entry.astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(distance.sum(1))], names=["vec_id", "label", "code", "error"])


def _fits(vector: Column) -> Column:
    """Not empty, and every component finite and so small that squared distances of two vectors stay below 2^63."""
    bound = F.sqrt(F.lit(2.0**62) / F.size(vector)) / 2
    return (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * SCALE + 1 > bound))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = CELL_BITS) -> DataFrame:
    """One row per vector kept: vec_id, label, code, error, label_error, codebooks_sha256.

    `vectors` has vec_id, embedding and label; other columns are not read. Components become floor(4096 * x). Codebooks
    start as the parts of the `entries` smallest distinct vec_ids (nulls last; of rows of one id, the least vector) and
    may have fewer entries if there are fewer ids. Each round assigns all parts to the nearest entries and moves each
    entry to the floor of its parts' mean. `error` is the squared distance to the final entries, `label_error` its sum
    over equal labels (nulls together; null if it is over 2^63). Every vector that is kept is coded, repeated rows each.

    Dropped are null vectors, vectors with a component that is null or not finite, or so large that squared distances of
    two vectors could pass 2^63 (32,768 or more at 64 dimensions), empty vectors, and those whose length is not that of the
    vector of the least vec_id kept or no multiple of `parts`. An empty table, or one with no vector kept, gives no rows.
    A round sends `parts` x `entries` sums to the driver, whatever the table's size.
    """
    spark = vectors.sparkSession
    if entries > 256:
        raise ValueError("a code has one byte per part")
    vector = F.col("vector")
    whole = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    fitting = whole.filter(vector.isNotNull() & (F.size(vector) % parts == 0) & _fits(vector))
    rank = F.struct(F.col("vec_id").isNull().alias("no"), F.col("vec_id").alias("id"), vector.alias("vector"))
    first = fitting.agg(F.min(rank).alias("first")).first()["first"]
    names = "vec_id " + vectors.schema["vec_id"].dataType.simpleString()
    if first is None:
        return spark.createDataFrame([], f"{names}, label {vectors.schema['label'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    kept = fitting.filter(F.size(vector) == len(first["vector"]))
    start = kept.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    start.sort(key=lambda r: (r["vec_id"] is None, r["vec_id"] if r["vec_id"] is not None else 0))
    points = np.floor(np.array([r["vector"] for r in start], np.float64) * SCALE).astype(np.int64)
    books = np.ascontiguousarray(points.reshape(len(start), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        found = kept.mapInArrow(lambda batches, b=books: _sums(batches, b, bits), SUMS)
        moved = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "sum")).groupBy("part", "entry", "place")
        moved = moved.agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
        books = books.copy()
        for row in moved:
            books[row["part"], row["entry"], row["place"]] = int(row["sum"]) // row["n"]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = cut(kept.mapInArrow(lambda batches, b=books: _codes(batches, b, bits), CODED.replace("vec_id long", names)))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = coded.groupBy("label").agg(total.alias("total"))
    by_label = by_label.select(F.col("label").alias("of_label"), F.expr("try_cast(total AS long)").alias("label_error"))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["of_label"]))
    return joined.select("vec_id", coded["label"].cast(vectors.schema["label"].dataType).alias("label"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rounds as a chain of tables, every part against every entry."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT rid, p, list_slice(v, CAST(p * len(v) // {parts} AS BIGINT) + 1, CAST((p + 1) * len(v) // {parts} AS BIGINT)) AS s FROM kept, range({parts}) AS t(p)),
book0 AS MATERIALIZED (
  SELECT p, j, s AS c FROM pieces JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept QUALIFY j < {entries}) USING (rid))"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT rid, p, any_value(s) AS s, min({{'d': d, 'j': j}}) AS best FROM (
    SELECT rid, p, s, j, list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM pieces JOIN book{k} USING (p))
  GROUP BY rid, p)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT p, j, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT p, j, list(floor(total / n) ORDER BY place) AS c FROM (
      SELECT p, j, place, sum(x)::DOUBLE AS total, count(*) AS n FROM (
        SELECT p, best.j AS j, unnest(s) AS x, unnest(range(len(s))) AS place FROM near{k}) GROUP BY p, j, place) GROUP BY p, j) m USING (p, j))""")
    return "WITH " + ",\n".join(steps) + f""",
coded AS (
  SELECT rid, string_agg(printf('%02x', best.j), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ','), ',' ORDER BY p, j)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)"""


SQL = _sql()
