"""Compression of vectors to product codes, with codebooks refined by exact integer k-means.

A vector is cut into equal parts; each part is replaced by the number of the nearest entry of its
position's codebook. Codebooks are refined in rounds: every part is assigned to its nearest
entry, then every entry becomes the mean of its parts. All of it is exact in integers, so the
result doesn't depend on how rows are dealt over tasks.

The nearest entry is found by an Exponion search. It starts at the entry a that the part had in
the round before; let u be the distance to it. An entry that is no farther from the part than a is
no farther from a than 2u, so only the neighbours of a within that radius are scanned, in a
list sorted by distance from a: in squares, gap <= 4 u^2, without rounding. Ties go to the lower
number, and entries at exactly the same distance lie inside the radius, so none is overlooked.

Rows with their codes are written once a round. A task sums its parts entry by entry and sends one
row for each entry; the codebooks (parts x entries rows, whatever the input) are what the driver
sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .sparkit import bound_batches, drop, settle

#: Sums of squares are exact in float64 below this.
EXACT = 1 << 53
#: Neighbours of the first step of a scan; each further step doubles the list.
STEP = 8
#: Rows that are assigned at a time.
ROWS = 1 << 15


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def finite(vector: Column) -> Column:
    """A vector that is there and whose components are all finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(x: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a column of integer lists as float64, with zeros after shorter ones."""
    flat = x.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(x.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(x), width).astype(np.float64)
    out = np.zeros((len(x), width))
    out[np.repeat(np.arange(len(x)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Codebook:
    """Entries of one part position with, for each, all entries by distance from it."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.float64)
        self.square = (self.entries**2).sum(axis=1)
        gap = np.rint(self.square[:, None] - 2 * self.entries @ self.entries.T + self.square[None, :])
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, axis=1)

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry to each row, and the squared distance."""
        k = len(self.entries)
        here = ((x - self.entries[before]) ** 2).sum(axis=1)
        best = here.astype(np.int64) * k + before  # orders by distance, then by number
        square = (x**2).sum(axis=1)
        by = np.argsort(before, kind="stable")
        start = np.flatnonzero(np.append(True, before[by[1:]] != before[by[:-1]])) if len(by) else np.empty(0, int)
        for a, e in zip(start, np.append(start[1:], len(by)), strict=True):
            rows = by[a:e]
            entry = before[rows[0]]
            reach = np.searchsorted(self.gap[entry], 4 * here[rows], side="right")
            falling = np.argsort(-reach, kind="stable")
            rows, reach = rows[falling], reach[falling]
            at, step = 0, STEP
            while at < reach[0]:
                # the rows whose radius holds the neighbour at this place of the list
                mine = rows[: np.searchsorted(-reach, -at, side="left")]
                near = self.order[entry, at : min(at + step, reach[0])]
                d = square[mine, None] - 2 * x[mine] @ self.entries[near].T + self.square[near]
                best[mine] = np.minimum(best[mine], (d.astype(np.int64) * k + near).min(axis=1))
                at, step = at + len(near), 2 * step
        return best % k, best // k


def _assigned(books: np.ndarray, carried: pa.Schema) -> Callable:
    """Each row with the codes of its parts and their squared distances summed, and at a
    task's end a row for each entry in use: how many parts are its own, and their sum."""
    parts, entries, width = books.shape
    last = [pa.field("code", pa.list_(pa.int32())), pa.field("error", pa.int64()), pa.field("part", pa.int32()), pa.field("entry", pa.int32()), pa.field("n", pa.int64()), pa.field("total", pa.list_(pa.int64()))]
    schema = pa.schema([*carried, *last])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [Codebook(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = matrix(b.column("_x"), parts * width).reshape(-1, parts, width)
                had = b.column("code")
                before = matrix(had, parts).astype(np.int64) if had.null_count == 0 else np.zeros((len(x), parts), np.int64)
                code, error = np.empty((len(x), parts), np.int32), np.zeros(len(x), np.int64)
                for p in range(parts):
                    code[:, p], d = of[p].nearest(x[:, p], before[:, p])
                    error += d
                    n[p] += np.bincount(code[:, p], minlength=entries)
                    by = np.argsort(code[:, p], kind="stable")
                    start = np.flatnonzero(np.append(True, np.diff(code[by, p]) != 0))
                    total[p, code[by[start], p]] += np.add.reduceat(x[by, p], start, axis=0).astype(np.int64)
                codes = pa.ListArray.from_arrays(np.arange(0, code.size + 1, parts, dtype=np.int32), pa.array(code.ravel()))
                none = [pa.nulls(len(x), f.type) for f in last[2:]]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in carried), codes, pa.array(error), *none], schema=schema)
        p, e = np.nonzero(n)
        if len(p):
            sums = pa.ListArray.from_arrays(np.arange(0, len(p) * width + 1, width, dtype=np.int32), pa.array(total[p, e].ravel()))
            none = [pa.nulls(len(p), f.type) for f in [*carried, *last[:2]]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), sums], schema=schema)

    return rows


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """For each row whose vector is whole: key, code (two hex digits a part), error (squared
    distances summed over the parts), label_error (error summed over equal labels, nulls
    together) and codebooks_sha256 (of all final entries' components, joined by ',').

    Components become floor(scale * x). Null vectors, and those with a component that is null or
    not finite, are left out. Codebooks begin as the parts of the `entries` rows of the smallest
    keys (of equal keys the smaller vector first, null keys last; fewer rows, fewer entries).
    A vector shorter than the longest, or than a multiple of `parts`, goes on with zeros.
    Repeated rows count each. An empty table gives an empty result; columns not named are
    ignored. `entries` is 256 at most. Components so large that a squared distance could pass
    2^53 raise a ValueError.
    """
    bound_batches(vectors.sparkSession)
    d = vectors.select(F.col(key).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_v")).filter(finite(F.col("_v")))
    whole = d.select("_id", "_label", whole_numbers(F.col("_v"), scale).alias("_x"))
    current = settle(whole.withColumn("code", F.lit(None).cast("array<int>")))
    most = F.array_max(F.transform("_x", F.abs))
    length, largest = current.agg(F.max(F.size("_x")), F.max(most)).first()
    width = max(1, -(-(length or 0) // parts))
    if width * (2 * (largest or 0)) ** 2 >= EXACT:
        raise ValueError("components are too large for exact distances")
    first = current.orderBy(F.col("_id").asc_nulls_last(), "_x").select("_x").limit(entries).collect()
    books = np.zeros((parts, len(first), width), np.int64)
    for i, r in enumerate(first):
        books[:, i] = np.pad(np.array(r["_x"], np.int64), (0, parts * width - len(r["_x"]))).reshape(parts, width)

    carried = T.StructType([current.schema[c] for c in ("_id", "_label", "_x")])
    schema = T.StructType([*carried, *T.StructType.fromDDL("code array<int>, error long, part int, entry int, n long, total array<long>")])
    for k in range(rounds + 1):
        after = settle(current.mapInArrow(_assigned(books, to_arrow_schema(carried)), schema))
        drop(current)
        current = after.filter("part is null")
        current.settled_at = after.settled_at
        if k < rounds:
            sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
            # a row for each entry, whatever the input
            for r in after.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
                books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    of = settle(current.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_same"))
    code = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))))
    out = current.join(of, current["_label"].eqNullSafe(of["_same"]))
    return out.select(F.col("_id").alias(key), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
