"""Near-duplicate detection by an LSH forest over MinHash signatures, confirmed exactly.

1. A document's words make shingles; the set of their hashes is its class (equal sets link at
   similarity 1 and go on as one), and 128 minima over it are its signature.
2. Forest: 32 orders of the signatures, each beginning with another minimum. Spark range-sorts
   each order, so that documents of a long common prefix are neighbours and no task gets more
   rows than others, however many share a prefix. A *region* is a run of neighbours of a common
   prefix of `ROWS` minima. (A pair at the least similarity misses all 32 such regions once in
   200,000 times; a shorter prefix isn't needed, a longer one would lose links.)
3. Depth adapts: a region of at most `BLOCK` documents is one candidate group. A denser one is
   cut where the common prefix of neighbours is shortest, up to `DEEPEST` minima deep, into
   groups of at most `BLOCK`; consecutive groups share a document. Only what lies at the ends
   of a task's slice is shuffled once more, to put regions together that a slice's end cuts.
4. In a group, documents are candidates if at least `FLOOR` of all places of their signatures
   agree, far below what a pair to be linked can show (four standard deviations).
5. Connected candidates are confirmed on the full sets, all pairs of up to `BLOCK` documents
   in a task: their intersections are counted by one product of the documents' shingle matrix
   with itself. More of them are dealt at random into blocks, twice, which joins nearly all
   linked documents to one component.
6. Completion: in every region that was cut and every group that was dealt, the documents
   outside the largest component are compared by signature with all others of another
   component, block by block, and the pairs that agree are confirmed. So every pair that shares
   a region is compared, or lies in one component already.
7. Components of the confirmed links; the least key of each is its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as K
from .components import components
from .sparkit import bound_batches, dealt_over, drop, settle, settled_bytes

U = np.uint64
PERMUTATIONS, ROWS = 128, 4
TREES = PERMUTATIONS // ROWS
#: Minima that the sorted orders hold, and the longest common prefix they can tell.
DEEPEST = 2 * ROWS
#: Agreement of signatures below which a pair cannot reach similarity 0.75.
FLOOR = 0.58
#: Documents that are compared all with all at a time.
BLOCK = 256
#: Groups of a region that stay in one task, where they share a name in the edges.
TOGETHER = 6
#: Pairs or rows that a task holds before it passes them on.
HELD = 1 << 18
SMALL, DENSE, OPEN, MARK = 0, 1, 2, 3
_MUL = (K.splitmix(5, PERMUTATIONS) >> U(32)).astype(np.uint32) | np.uint32(1)
_ADD = (K.splitmix(6, PERMUTATIONS) >> U(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of a set of shingle hashes under the permutations."""
    x = (hashes >> U(32)).astype(np.uint32)
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(best, (x[at : at + 1024, None] * _MUL + _ADD).min(axis=0), out=best)
    return best


def shingle_sets(texts, width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for a, e, b, off in K.slabs(texts):
        h, row = K.shingle_hashes(K.lowered(b), off, width)
        at = np.searchsorted(row, np.arange(e - a + 1))
        for i in range(e - a):
            yield np.unique(h[at[i] : at[i + 1]])


def set_class(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int((K.mix(s ^ U(77)).sum(dtype=U) ^ K.mix(np.array([len(s)], U))[0]).view(np.int64))


def _signed(width: int) -> Callable:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, cls, sig = [], [], []
            for s in shingle_sets(f["_text"], width):
                n.append(len(s))
                cls.append(set_class(s) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({**{c: f[c] for c in f.columns if c != "_text"}, "n": n, "cls": pd.array(cls, dtype="Int64"), "sig": sig})

    return rows


def _labels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each class and order: the hash of the first `ROWS` minima, the next as they are."""
    for f in frames:
        if not len(f):
            continue
        sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(len(f), PERMUTATIONS)
        cls = f["cls"].to_numpy(np.int64)
        for t in range(TREES):
            turned = np.roll(sig, -t * ROWS, axis=1)[:, :DEEPEST].astype(U)
            region = np.full(len(f), t + 1, U)
            for j in range(ROWS):
                region = K.mix(region * U(3) + turned[:, j])
            d1, d2 = ((turned[:, j] << U(32) | turned[:, j + 1]).view(np.int64) for j in (ROWS, ROWS + 2))
            yield pd.DataFrame({"region": region.view(np.int64), "d1": d1, "d2": d2, "cls": cls})


def _common(x: np.ndarray) -> np.ndarray:
    """Length of the common prefix, beyond the region's, of each row and the next."""
    same = x[1:3, 1:] ^ x[1:3, :-1]
    half, full = (same >> 32) == 0, same == 0
    return half[0].astype(int) + full[0] + (full[0] & half[1]) + (full[0] & full[1])


def _cut(x: np.ndarray, final: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces of the sorted rows of a dense region, cut where neighbours have least in
    common, and what is left for later. A piece begins with the last row of the one before."""
    out = []
    while x.shape[1] > BLOCK:
        low = BLOCK // 2
        common = _common(x[:, low - 1 : BLOCK + 1])
        c = low + int(np.flatnonzero(common == common.min())[-1])
        out.append(x[:, :c])
        x = x[:, c - 1 :]
    if final:
        out.append(x)
        x = x[:, :0]
    return out, x


def _rows(x: np.ndarray, part, state: int) -> pd.DataFrame:
    return pd.DataFrame({"region": x[0], "part": np.broadcast_to(np.int64(part), x.shape[1]), "d1": x[1], "d2": x[2], "cls": x[3], "state": np.full(x.shape[1], state)})


_GROUPS = "region long, part long, d1 long, d2 long, cls long, state int"


def _grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a slice of the sorted orders: the rows of regions of several documents, with the
    group they belong to (region, part). Regions at the ends of the slice may go on elsewhere:
    their rows are `OPEN`, or if they are dense already, a `MARK` is left for the rest."""
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    held, part, first = np.empty((4, 0), np.int64), base, True

    def region(x: np.ndarray, part: int, is_open: bool) -> Iterator[pd.DataFrame]:
        if part > base or x.shape[1] > BLOCK:
            for k, piece in enumerate(_cut(x, True)[0]):
                yield _rows(piece, part + k, DENSE)
            if is_open:
                yield _rows(x[:, :1], 0, MARK)
        elif is_open:
            yield _rows(x, 0, OPEN)
        elif x.shape[1] > 1:
            yield _rows(x, 0, SMALL)

    for f in frames:
        x = np.concatenate([held, f[["region", "d1", "d2", "cls"]].to_numpy(np.int64).T], axis=1)
        if not x.shape[1]:
            continue
        start = np.flatnonzero(np.append(True, x[0, 1:] != x[0, :-1]))
        last = start[-1]
        if last:
            # the region that began before this frame
            yield from region(x[:, : start[1]], part, first)
            part, first = base, False
            size = np.diff(start)[1:]
            inner = x[:, start[1] : last]
            yield _rows(inner[:, np.repeat((size > 1) & (size <= BLOCK), size)], 0, SMALL)
            for a, n in zip(start[1:-1][size > BLOCK], size[size > BLOCK], strict=True):
                yield from region(x[:, a : a + n], base, False)
        held = x[:, last:]
        if held.shape[1] > 2 * BLOCK:
            pieces, held = _cut(held, False)
            for piece in pieces:
                yield _rows(piece, part, DENSE)
                part += 1
    if held.shape[1]:
        yield from region(held, part, True)


def _rejoined(f: pd.DataFrame) -> pd.DataFrame:
    """The rows that slices left open in one region, `2 * BLOCK` at most."""
    mine = f[f["state"] == OPEN].sort_values(["d1", "d2", "cls"])
    x = mine[["region", "d1", "d2", "cls"]].to_numpy(np.int64).T
    if not len(mine):
        return f.iloc[:0]
    if len(mine) < len(f) or len(mine) > BLOCK:
        return pd.concat([_rows(piece, -1 - (k << TOGETHER), DENSE) for k, piece in enumerate(_cut(x, True)[0])])
    return _rows(x, 0, SMALL) if len(mine) > 1 else f.iloc[:0]


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least node of each component of a graph to its others."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while len(x):
        lx, ly = label[x], label[y]
        if (lx == ly).all():
            break
        low = np.minimum(lx, ly)
        np.minimum.at(label, lx, low)
        np.minimum.at(label, ly, low)
        while (label[label] != label).any():
            label = label[label]
    leaf = np.flatnonzero(label != np.arange(len(names)))
    return names[label[leaf]], names[leaf]


class _Edges:
    """Edges of a task on their way out, reduced to a spanning forest."""

    def __init__(self) -> None:
        self.a, self.b, self.n = [], [], 0

    def put(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)

    def send(self, more_than: int = 0) -> Iterator[pd.DataFrame]:
        if self.n > more_than:
            a, b = star_forest(np.concatenate(self.a), np.concatenate(self.b))
            yield pd.DataFrame({"a": a, "b": b})
            self.a, self.b, self.n = [], [], 0


def _whole(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Of rows sorted by some columns, frames that hold whole groups of them, and where the
    groups begin and end."""
    held = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        if not len(f):
            continue
        key = f[by].to_numpy(np.int64)
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        if len(start) > 1:
            yield f.iloc[: start[-1]], start
        held = f.iloc[start[-1] :]
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def spread_labels(link: np.ndarray) -> np.ndarray:
    """Component labels of a symmetric boolean matrix."""
    n = len(link)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(link[front].any(axis=0) & (label < 0))
                label[front] = i
    return label


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places each sketch of x agrees with each of y."""
    agree = np.zeros((len(x), len(y)), np.int16)
    for j in range(PERMUTATIONS):
        agree += x[:, j, None] == y[None, :, j]
    return agree


def _least_places() -> float:
    # agreement of one byte of each minimum: chance adds (1 - similarity) / 256
    return (FLOOR + (1 - FLOOR) / 256) * PERMUTATIONS


def _sketches(f: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(len(f), PERMUTATIONS)


def _agreeing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate edges inside the groups, which come in one piece each. Groups of equal size
    are compared together."""
    least, edges = _least_places(), _Edges()
    for f, start in _whole(frames, ["region", "part"]):
        sig, cls, size = _sketches(f), f["cls"].to_numpy(np.int64), np.diff(start)
        for n in np.unique(size[size > 1]):
            at = start[:-1][size == n]
            if n > 16:
                for a in at:
                    i, j = np.nonzero(np.triu(_agreement(sig[a : a + n], sig[a : a + n]) >= least, 1))
                    edges.put(cls[a + i], cls[a + j])
                continue
            for i in range(n - 1):
                for j in range(i + 1, n):
                    ok = at[(sig[at + i] == sig[at + j]).sum(axis=1) >= least]
                    edges.put(cls[ok + i], cls[ok + j])
        yield from edges.send(HELD)
    yield from edges.send()


def _across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each task the documents outside their set's largest part (side 1) and those of
    another part (side 0) that have a pair whose sketches agree."""
    least = _least_places()
    for f, start in _whole(frames, ["task"]):
        sig, side, label = _sketches(f), f["side"].to_numpy(), f["label"].to_numpy(np.int64)
        for a, e in zip(start[:-1], start[1:], strict=True):
            x, y = a + np.flatnonzero(side[a:e] == 1), a + np.flatnonzero(side[a:e] == 0)
            if len(x) and len(y):
                pair = (_agreement(sig[x], sig[y]) >= least) & (label[x][:, None] != label[y][None, :])
                both = np.append(x[pair.any(axis=1)], y[pair.any(axis=0)])
                yield f.iloc[both][["task", "cls"]]


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices of bounded size over
    the elements that two sets at least have."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[size[0], both], [both, size[1]]])
    every = np.concatenate(sets)
    who = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    v, who = every[order], who[order]
    new = np.append(True, v[1:] != v[:-1]) if len(v) else np.empty(0, bool)
    col = np.cumsum(new) - 1
    often = np.bincount(col) > 1 if len(v) else np.empty(0, bool)
    keep = often[col]
    col, who = (np.cumsum(often) - 1)[col[keep]], who[keep]
    total = np.zeros((n, n))
    step = 16384
    for at in range(0, int(often.sum()), step):
        a, e = np.searchsorted(col, [at, at + step])
        m = np.zeros((n, min(step, int(often.sum()) - at)), np.float32)
        m[who[a:e], col[a:e] - at] = 1
        total += m @ m.T
    total = np.rint(total).astype(np.int64)
    total[np.arange(n), np.arange(n)] = size
    return total


def _confirmed(width: int, percent: int) -> Callable:
    """Links among the documents of each task, as stars of their components."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = _Edges()
        for f, start in _whole(frames, ["task"]):
            cls, text = f["cls"].to_numpy(np.int64), f["_text"].tolist()
            for a, e in zip(start[:-1], start[1:], strict=True):
                sets, names, had = [], [], set()
                for s, c in zip(shingle_sets(text[a:e], width), cls[a:e].tolist(), strict=True):
                    if c not in had and len(s) and set_class(s) == c:
                        had.add(c)
                        sets.append(s)
                        names.append(c)
                if len(sets) < 2:
                    continue
                both = intersections(sets)
                size = np.diag(both)
                label = spread_labels(100 * both >= percent * (size[:, None] + size[None, :] - both))
                names = np.array(names)
                edges.put(names[label], names)
            yield from edges.send(HELD)
        yield from edges.send()

    return rows


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """For each row: key, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z in lower case. A set holds the distinct
    shingles of `width` words; fewer words are one shingle; null and wordless texts have an
    empty set and are linked with nothing (their own component, kept). Documents with
    100 * |A and B| >= percent * |A or B| are linked (percent is 75 at least: the candidate
    search is laid out for it); component_id is the least key that links lead to; kept says
    that it is the document's own. Rows of equal keys are judged by their texts, row by row.
    A null key can join a component, but names it only if there is no other; then it is kept.
    An empty table gives an empty result; columns not named are ignored.
    """
    return _judged(docs, key, text, width, percent).select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def _judged(docs: DataFrame, key: str, text: str, width: int, percent: int, hashed: bool = False) -> DataFrame:
    """What `near_duplicates` says of each row: _id, n, component (null for an empty set),
    component_id, kept, and if `hashed` the text's hash as _h."""
    h = ["_h"] if hashed else []
    spark = docs.sparkSession
    bound_batches(spark)
    d = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    d = d.withColumn("_h", F.xxhash64("_text"))
    ids = d.select(F.col("_id").cast("string").alias("_id"), "_text", "_h")
    signed = settle(ids.mapInPandas(_signed(width), "_id string, _h long, n long, cls long, sig binary").withColumn("_id", F.col("_id").cast("long")))
    # a class is named by its least key; its texts are those of one (key, hash)
    source = F.min(F.struct("_id", "_h")).alias("_source")
    classes = settle(signed.filter("cls is not null").groupBy("cls").agg(F.min("_id").alias("_rep"), source, F.first("sig").alias("sig")))
    groups, edges = _candidates(classes)

    sketch = F.unhex(F.regexp_replace(F.hex("sig"), "(..)......", "$1"))  # one byte of each minimum
    sketches = classes.select(F.col("cls").alias("_c"), sketch.alias("sketch"))

    def confirm(members: DataFrame) -> DataFrame:
        """Links among the documents of each task: members are (task, cls)."""
        texts = settle(members.join(pool, "cls").select("task", "cls", "_text"))
        dealt = texts.repartition(dealt_over(spark, settled_bytes(texts), 4 << 20), "task").sortWithinPartitions("task", "cls")
        links = settle(dealt.mapInPandas(_confirmed(width, percent), "a long, b long"))
        drop(texts)
        return links

    joined = components(edges)
    dense = groups.filter(F.col("state") == DENSE).select(F.col("region").alias("set"), "cls").distinct()
    # whatever is to be confirmed comes from here: all texts travel once, not once a round
    wanted = joined.select(F.col("node").alias("cls")).unionByName(dense.select("cls")).distinct()
    w = wanted.join(classes.select("cls", "_source"), "cls").select("cls", F.col("_source._id").alias("_w"), F.col("_source._h").alias("_wh"))
    pool = d.join(w, d["_id"].eqNullSafe(w["_w"]) & (d["_h"] == w["_wh"])).select("cls", "_text")
    pool = settle(pool.groupBy("cls").agg(F.first("_text").alias("_text")))
    sizes = settle(joined.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    members = settle(joined.join(sizes, "component").select(F.col("node").alias("cls"), F.col("component").alias("grp"), "size"))
    small = members.filter(F.col("size") <= BLOCK).select(F.col("grp").alias("task"), "cls")
    large = members.filter(F.col("size") > BLOCK)
    twice = large.withColumn("salt", F.explode(F.array(F.lit(0), F.lit(1))))
    block = F.pmod(F.xxhash64("cls", "salt"), F.ceil(F.col("size") / BLOCK))
    links = confirm(small.unionByName(twice.select(F.xxhash64("grp", "salt", block).alias("task"), "cls")))
    # what a cut region's groups kept apart, and what the blocks of a large group left apart
    apart = dense.join(members.select("cls", "grp"), "cls", "left").select("set", "cls", F.coalesce("grp", "cls").alias("label"))
    part = components(links)
    inside = large.join(part, large["cls"] == part["node"], "left").select(F.col("grp").alias("set"), "cls", F.coalesce("component", "cls").alias("label"))
    sets = settle(apart.unionByName(inside))
    more = _rest(sets, sketches, confirm)
    comp = part if more is None else joined_further(part, more)
    named = classes.select("cls", "_rep").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    named = settle(named.withColumn("component", F.coalesce("component", "cls")))
    least = named.groupBy("component").agg(F.min("_rep").alias("component_id"))
    # the component of a third of all rows is one key here: least has a row for each component
    least = settle(least)
    verdict = named.join(least, "component").select("cls", "component", "component_id")
    out = signed.select("_id", *h, "n", "cls").join(verdict, "cls", "left")
    cid = F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    drop(groups, edges, pool, sizes, members, sets, links, more)
    return out.select("_id", *h, "n", "component", cid.alias("component_id"), F.col("_id").eqNullSafe(cid).alias("kept"))


def joined_further(part: DataFrame, more: DataFrame) -> DataFrame:
    """The components of a graph whose components `part` (node, component) are known, with
    `more` edges (a, b): only the components that those touch are put together anew."""
    if more.limit(1).isEmpty():
        return part
    of = lambda side: part.select(F.col("node").alias(f"_{side}"), F.col("component").alias(f"_{side}c"))
    moved = more.join(of("a"), more["a"] == F.col("_a"), "left").join(of("b"), more["b"] == F.col("_b"), "left")
    top = components(moved.select(F.coalesce("_ac", "a").alias("a"), F.coalesce("_bc", "b").alias("b")))
    top = settle(top.select(F.col("node").alias("_n"), F.col("component").alias("_c")))
    known = part.join(top, part["component"] == top["_n"], "left").select("node", F.coalesce("_c", "component").alias("component"))
    # what no known component holds; a component's own name is among its nodes
    new = top.join(part, top["_n"] == part["node"], "left_anti").select(F.col("_n").alias("node"), F.col("_c").alias("component"))
    return known.unionByName(new)


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the candidate groups, edges between candidates)."""
    spark = classes.sparkSession
    labels = classes.select("cls", "sig").mapInPandas(_labels, "region long, d1 long, d2 long, cls long")
    order = ["region", "d1", "d2", "cls"]
    n = dealt_over(spark, settled_bytes(classes) * TREES * 32 // (4 * PERMUTATIONS))
    found = settle(labels.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_grouped, _GROUPS))
    at_ends = found.filter(F.col("state") >= OPEN).groupBy("region").applyInPandas(_rejoined, _GROUPS)
    groups = settle(found.filter(F.col("state") < OPEN).unionByName(at_ends).select("region", "part", "cls", "state"))
    drop(found)
    sketch = F.unhex(F.regexp_replace(F.hex("sig"), "(..)......", "$1"))  # one byte of each minimum
    with_sketch = groups.select("region", "part", "cls").join(classes.select("cls", sketch.alias("sketch")), "cls")
    # comparing costs far more than a row's bytes tell
    n = dealt_over(spark, settled_bytes(groups), 1 << 20)
    dealt = with_sketch.repartition(n, "region", F.shiftright("part", TOGETHER)).sortWithinPartitions("region", "part", "cls")
    return groups, settle(dealt.mapInPandas(_agreeing, "a long, b long"))


def _rest(sets: DataFrame, sketches: DataFrame, confirm: Callable) -> DataFrame | None:
    """Links that are still missing inside sets (set, cls, label) of documents: those outside
    a set's largest part, block by block, against each block of the whole set. Sets of one
    part need nothing. Only sketches travel; texts follow for documents of agreeing pairs."""
    spark = sets.sparkSession
    count = sets.groupBy("set", "label").agg(F.count(F.lit(1)).alias("m"))
    shape = count.groupBy("set").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("m"))
    # one row for each set that is in several parts
    shape = settle(shape.filter("all > m").select(F.col("set").alias("s"), "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("m")) / BLOCK).cast("int").alias("rests")))
    if shape.limit(1).isEmpty():
        drop(shape)
        return None
    d = sets.join(shape, sets["set"] == shape["s"])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda salt, n: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).cast("int")
    rest = d.filter("label <> main").withColumn("rb", place(2, "rests")).withColumn("ab", each("blocks")).withColumn("side", F.lit(1))
    every = d.withColumn("ab", place(3, "blocks")).withColumn("rb", each("rests")).withColumn("side", F.lit(0))
    tasks = settle(rest.unionByName(every).select(F.xxhash64("set", "rb", "ab").alias("task"), "side", "cls", "label"))
    t = tasks.join(sketches, tasks["cls"] == sketches["_c"]).drop("_c")
    dealt = t.repartition(dealt_over(spark, settled_bytes(tasks), 1 << 20), "task").sortWithinPartitions("task")
    found = confirm(dealt.mapInPandas(_across, "task long, cls long").distinct())
    drop(shape, tasks)
    return found


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of one document for each component: that of
    the least key, and of several texts of that key the one with the least hash. Of rows
    with the same key and text one stays. Null and wordless texts are components of their own
    and stay; an empty table stays empty. Keys are integers."""
    kept = _judged(docs, key, text, 5, 75, hashed=True).filter("kept")
    # a row without words is a component of its own
    own = [F.when(F.col("component").isNull(), F.col(c)) for c in ("_id", "_h")]
    kept = kept.groupBy("component", *own).agg(F.min(F.struct("_id", "_h")).alias("_row")).select("_row.*").distinct()
    same = docs[key].eqNullSafe(kept["_id"]) & (F.xxhash64(docs[text]) == kept["_h"])
    return docs.join(kept, same, "left_semi").dropDuplicates([key, text])
