"""Near-duplicates by SimHash fingerprints, found by covering locality-sensitive hashing.

1. A document's words make shingles; each is hashed to 64 bits, and a bit of the fingerprint is
   the majority of that bit over all shingles. Equal fingerprints go on as one.
2. Covering: a *mask* keeps some bits of a fingerprint. Every bit position carries a vector of
   radius + 1 bits, and the mask of each such vector but zero keeps the positions whose product
   with it is odd. Two fingerprints that differ in at most `radius` positions give at most
   `radius` linear equations in radius + 1 unknowns, so a vector solves them all, and under its
   mask the two agree: of the 2^(radius + 1) - 1 tables one at least holds the pair in one bucket.
3. Buckets of up to `BLOCK` fingerprints are compared in one task each. In a larger one all
   members agree on the mask's bits, so the search goes on in it with masks over the other bits:
   each level fixes about half of them. Members are distinct, hence a bucket with eight free bits
   holds 256 at most and the search ends; no pair within the radius is lost, no bucket is cut.
4. Components of the links; the least key of each is its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .forest import _Edges, _whole
from .sparkit import bound_batches, dealt_over, drop, settle, settled_bytes

BITS = 64
#: Fingerprints that are compared all with all at a time.
BLOCK = 256
#: Shingles whose bits are counted at a time.
_RUN = 1 << 16


def fingerprint(raw: bytes | None, width: int, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text, as a signed number; zero without words."""
    words = (raw or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    text = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(width, len(words))
    first, last = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    of = xxhash.xxh64_intdigest
    for at in range(0, len(first), _RUN):
        h = np.array([of(text[a:e], seed) for a, e in zip(first[at : at + _RUN], last[at : at + _RUN], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<i8")[0])


def _fingerprinted(width: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t, width) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(got, pa.int64())], ["_id", "fp"])

    return rows


def covering_masks(fixed: int, radius: int) -> list[int]:
    """Masks over the positions that `fixed` doesn't hold, each with `fixed`: two fingerprints
    that agree on `fixed` and differ in at most `radius` positions agree on one of them."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    # the unit vectors come first, so that no mask is empty where radius + 1 positions are free
    units = [1 << j for j in range(radius + 1)]
    vectors = units + [v for v in range(1, 1 << (radius + 1)) if v not in units]
    carried = {p: vectors[i % len(vectors)] for i, p in enumerate(free)}
    return [fixed | sum(1 << p for p, m in carried.items() if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _close(radius: int) -> Callable:
    """Links inside the buckets of a task, as stars of their components."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = _Edges()
        for f, start in _whole(frames, ["mask", "bucket"]):
            fp, size = f["fp"].to_numpy(np.int64), np.diff(start)
            for n in np.unique(size):
                # buckets of equal size together, in runs of bounded memory
                at = start[:-1][size == n]
                run = max(1, (1 << 20) // int(n * n))
                for k in range(0, len(at), run):
                    x = fp[at[k : k + run, None] + np.arange(n)]
                    near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= radius
                    g, i, j = np.nonzero(near & ~np.tri(n, dtype=bool))
                    edges.put(x[g, i], x[g, j])
            yield from edges.send(1 << 18)
        yield from edges.send()

    return rows


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of a settled table of distinct ones (fp
    long) which differ in at most `radius` bits: each such pair is an edge or is joined by some."""
    spark = prints.sparkSession
    masks = covering_masks(0, radius)
    level = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"))
    done: list[DataFrame] = []
    found: list[DataFrame] = []
    while True:
        d = level.withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
        # counts combine before the shuffle; both sides are tables, so Spark can split a large bucket's rows in the join
        sizes = settle(d.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        shared = settle(d.join(sizes, ["mask", "bucket"]))
        dealt = shared.filter(F.col("n") <= BLOCK).select("mask", "bucket", "fp")
        dealt = dealt.repartition(dealt_over(spark, settled_bytes(shared), 4 << 20), "mask", "bucket").sortWithinPartitions("mask", "bucket")
        found.append(settle(dealt.mapInPandas(_close(radius), "a long, b long")))
        done += [sizes, shared]
        deep = shared.filter(F.col("n") > BLOCK)
        if deep.limit(1).isEmpty():
            break
        following = {m: covering_masks(m, radius) for m in masks}
        masks = sorted({x for some in following.values() for x in some})
        # a row for each mask of the level: a fixed number, whatever the input
        table = spark.createDataFrame([(_signed(m), [_signed(x) for x in sorted(set(some))]) for m, some in following.items()], "mask long, then array<long>")
        level = settle(deep.join(F.broadcast(table), "mask").select("fp", F.explode("then").alias("mask")))
        done.append(level)
    drop(*done)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """For each row: key, fingerprint (16 hex digits), component_id (the least key reachable
    over fingerprints that differ in at most `radius` bits).

    Words are runs without ASCII white space, A-Z in lower case; shingles of `width` words are
    counted as often as they occur, and fewer words are one shingle. Null and wordless texts
    have fingerprint zero and are linked like any other. Rows of equal keys are judged by their
    texts, row by row. A null key can join a component, but names it only if there is no other.
    An empty table gives an empty result; columns not named are ignored, whatever their names.
    Keys are integers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    d = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    signed = settle(d.mapInArrow(_fingerprinted(width), "_id long, fp long"))
    prints = settle(signed.groupBy("fp").agg(F.min("_id").alias("rep")))
    edges = links(prints.select("fp"), radius)
    comp = components(edges)
    named = prints.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
    named = settle(named.withColumn("component", F.coalesce("component", "fp")))
    least = settle(named.groupBy("component").agg(F.min("rep").alias("component_id")))
    # the fingerprint of a third of all rows is one key here: the other side has one row for it
    verdict = settle(named.join(least, "component").select("fp", "component_id"))
    drop(prints, named, least)
    out = signed.join(verdict, "fp")
    return out.select(F.col("_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
