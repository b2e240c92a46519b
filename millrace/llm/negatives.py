"""Hard negatives for anchors, mined by blocked dense products.

Anchors are taken in passes of bounded size. A pass's anchors are broadcast as one matrix; every
task multiplies its candidate rows with it, block by block, in float64, which is exact in
integers below 2^53. First each task keeps, for each anchor, the best rows of the same label;
such lists merge: the best of several tasks' lists are the best of all. The merged lists give each
positive's window of scores, and a second pass over the candidates keeps, for each window, the
best rows of another label, merged in the same way. So a task's memory is a block of products
and a list of a few rows for each anchor, whatever the input, and what is shuffled is those lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codes import EXACT, finite, matrix, whole_numbers
from .sparkit import bound_batches, drop, settle, shared_path, written

#: Bytes of the anchors' matrix that one pass broadcasts.
ANCHORS = 16 << 20
#: Anchors and candidates that are multiplied at a time.
BLOCK, ROWS = 1024, 4096
_LEAST = np.finfo(np.float64).min


class Best:
    """The `k` best (score, id) of each group so far: higher scores first, then smaller ids,
    null ids last."""

    def __init__(self, groups: int, k: int) -> None:
        self.k, self.least = k, np.full(groups, _LEAST)
        self.group, self.score = np.empty(0, np.int64), np.empty(0)
        self.null, self.id = np.empty(0, bool), np.empty(0, np.int64)

    def put(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each candidate, a column for each group, -inf where the
        candidate is none of the group's."""
        floor, k = self.least, self.k
        row, col = np.nonzero(scores >= floor)
        if len(row) > 16 * k * len(floor) and len(scores) > k:
            floor = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
            row, col = np.nonzero(scores >= floor)
        if not len(row):
            return
        group, score = np.append(self.group, col), np.append(self.score, scores[row, col])
        none, i = np.append(self.null, null[row]), np.append(self.id, ids[row])
        by = np.lexsort((i, none, -score, group))
        place = np.arange(len(by)) - np.searchsorted(group[by], group[by], side="left")
        by = by[place < k]
        self.group, self.score, self.null, self.id = group[by], score[by], none[by], i[by]
        full = np.flatnonzero(np.bincount(self.group, minlength=len(floor)) == k)
        self.least[full] = self.score[np.searchsorted(self.group, full, side="right") - 1]


def _searched(shared, k: int, windows: int) -> Callable:
    """The best rows of a task: for each anchor of its own label if `windows` is 0, else for each
    of the anchor's windows of other labels. Groups are numbered anchor by anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, labels, low, high = shared.value
        code = {c: i for i, c in enumerate(sorted(set(labels)))}
        own = np.array([code[c] for c in labels], np.int64)
        blocks = [slice(a, min(a + BLOCK, len(x))) for a in range(0, len(x), BLOCK)]
        best = {(a.start, w): Best(a.stop - a.start, k) for a in blocks for w in range(max(1, windows))}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                c = matrix(b.column("_x"), x.shape[1])
                label = np.array([code.get(v, -1) for v in b.column("_label").to_pylist()], np.int64)
                null = b.column("_id").is_null().to_numpy(zero_copy_only=False)
                ids = b.column("_id").fill_null(0).to_numpy()
                for a in blocks:
                    score = c @ x[a].T
                    same = label[:, None] == own[None, a]
                    score[same if windows else ~same] = -np.inf
                    if not windows:
                        best[a.start, 0].put(score, null, ids)
                    for w in range(windows):
                        inside = (score >= low[a, w]) & (score <= high[a, w])
                        if inside.any():
                            best[a.start, w].put(np.where(inside, score, -np.inf), null, ids)
        for (a, w), of in best.items():
            if len(of.group):
                group = (of.group + a) * max(1, windows) + w
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(of.score.astype(np.int64)), pa.array(of.id, mask=of.null)], ["grp", "score", "id"])

    return rows


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best of all tasks' lists, with their places from 1."""
    order = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256) -> DataFrame:
    """For each anchor and positive its negatives: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x); higher come first, ties by smaller key (null
    keys last). An anchor's positives are its first other rows of its label; a positive's
    negatives are the anchor's first rows of another label that score at most as high as the
    positive and at least `percent` of that. Rows with a null label, a null vector, or a
    component that is null or not finite take no part. `anchors` says over the given columns which
    rows are anchors, null as false. A vector shorter than the longest goes on with zeros. Repeated
    rows count each; an anchor leaves out itself, not a row like it. An empty table, or one
    without anchors, gives an empty result; columns not named are ignored. Keys are integers.
    Components so large that a product could pass 2^53 raise a ValueError.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    d = vectors.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("string").alias("_label"), F.coalesce(anchors, F.lit(False)).alias("_anchor"), F.col(vector).alias("_v"))
    d = d.filter(F.col("_label").isNotNull() & finite(F.col("_v")))
    rows = settle(d.select("_id", "_label", "_anchor", whole_numbers(F.col("_v"), scale).alias("_x"), F.monotonically_increasing_id().alias("_row")))
    most = F.array_max(F.transform("_x", F.abs))
    length, largest, n = rows.agg(F.max(F.size("_x")), F.max(most), F.count_if("_anchor")).first()
    width = max(1, length or 0)
    if width * (largest or 0) ** 2 >= EXACT:
        raise ValueError("components are too large for exact products")
    path = shared_path(spark)
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    written(spark.createDataFrame([], none).write, spark, path)
    passes = -(-n * 8 * width // ANCHORS)
    for p in range(passes):
        # one pass's anchors: of a bounded size, dealt by row and not by key
        chosen = rows.filter("_anchor").filter(F.pmod(F.xxhash64("_row"), F.lit(passes)) == p)
        chosen = chosen.select("_id", "_label", "_x").toArrow().combine_chunks()
        if not chosen.num_rows:
            continue
        _one_pass(rows, chosen, width, positives, negatives, percent, path)
    drop(rows)
    return spark.read.schema(none).parquet(path).select(F.col("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _one_pass(rows: DataFrame, chosen: pa.Table, width: int, positives: int, negatives: int, percent: int, path: str) -> None:
    spark = rows.sparkSession
    x = matrix(chosen.column("_x").chunk(0), width)
    ids, labels = chosen.column("_id").to_pylist(), chosen.column("_label").to_pylist()
    candidates = rows.select("_id", "_label", "_x")
    found = "grp long, score long, id long"

    first = spark.sparkContext.broadcast((x, labels, None, None))
    # the anchor itself may be among the best of its label
    best = _merged(candidates.mapInArrow(_searched(first, positives + 1, 0), found), positives + 1)
    best = best.toArrow().sort_by([("grp", "ascending"), ("place", "ascending")]).combine_chunks()
    grp, score = best.column("grp").to_numpy(), best.column("score").to_numpy()
    pid = np.array(best.column("id").to_pylist(), dtype=object)
    itself = (pid == np.array(ids, dtype=object)[grp]) & (score == (x**2).sum(axis=1).astype(np.int64)[grp])
    # of rows like the anchor one is the anchor
    once = np.cumsum(itself) - np.append(0, np.cumsum(itself))[np.searchsorted(grp, grp, side="left")]
    stay = ~(itself & (once == 1))
    grp, score, pid = grp[stay], score[stay], pid[stay]
    place = np.arange(len(grp)) - np.searchsorted(grp, grp, side="left")
    grp, score, pid, place = (v[place < positives] for v in (grp, score, pid, place))

    low, high = np.full((len(x), positives), np.inf), np.full((len(x), positives), -np.inf)
    low[grp, place], high[grp, place] = -(-percent * score // 100), score
    second = spark.sparkContext.broadcast((x, labels, low, high))
    got = _merged(candidates.mapInArrow(_searched(second, negatives, positives), found), negatives)
    # a row for each anchor of the pass and positive
    of = [(int(g) * positives + int(p), ids[g], i, int(s)) for g, p, i, s in zip(grp, place, pid, score, strict=True)]
    of = spark.createDataFrame(of, "grp long, anchor_id long, positive_id long, positive_score long")
    out = got.join(F.broadcast(of), "grp").select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out.write.mode("append").parquet(path)
    first.unpersist()
    second.unpersist()
