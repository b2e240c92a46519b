"""Suffix-array dedup: removes every byte that a long enough earlier repeat covers.

Prefix doubling over the suffixes, of which only the first `threshold` bytes matter:

1. The first rank of a position names the `START` bytes that begin there. Positions are chosen
   by content, one for each window of `threshold` bytes (the least rank in it), so that two
   equal windows always choose the same position in them. Neighbouring windows that chose the
   same position form a *context*. Spark range-sorts (rank, context) and each task reranks its
   slice: a position whose rank is unique drops out with all its windows; of contexts whose
   whole bytes are equal all but the first repeat an earlier one, and the first goes on only
   if its rank has other contexts too.
2. The windows that are left are positions of their own now, and so are the places inside them
   that the rounds look up. Each has the name of the `START` bytes there, by which Spark sorts
   and the tasks rerank: that is the rank over `START` bytes.
3. Round by round each position looks up the rank, of the same round, at the offset of k bytes, by a
   join on document and place; Spark range-sorts the pairs (rank, rank at the offset), the tasks
   rerank them, and k doubles, until the threshold is reached. A position with a unique rank
   drops out, and so do all whose string it lies in, as their lookup finds nothing. At the threshold
   all positions of one rank but the first repeat an earlier one.

The name of the first bytes is a hash of 64 bits; no later round hashes text, and a string of
`threshold` bytes is held equal to another only if two names at least agree.

Skew: what repeats inside one batch of a task is settled there, before any shuffle. Slices hold
equally many rows, however many of them have one rank; a rank that goes on over several slices
is put together from one row for either end of each slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit as K
from .sparkit import bound_batches, dealt_over, drop, number_rows, settle, settled_bytes

U = np.uint64
#: Entries that a task holds before it passes them on.
BATCH = 1 << 20
#: Length of the first rank.
START = 50
_POS = U((1 << 21) - 1)
#: Bits for a place in a document, and places that the rounds look up in one piece.
_PLACE, PIECE = 40, 1 << 20
CONTEXT, SPAN, REQUEST, HEAD, TAIL = 0, 1, 2, 3, 4
_ENTRY = "kind int, slice int, g long, c long, key long, lo long, n int"


def pieces(threshold: int) -> list[tuple[int, int]]:
    """The bytes that each round adds to what its ranks cover: the first rank's, then those from
    each offset that doubling reaches, two pieces at least."""
    out = [(0, min(START, max(1, threshold // 2)))]
    while out[-1][1] < threshold:
        k = out[-1][1]
        out.append((k, min(2 * k, threshold)))
    return out if len(out) > 1 else [*out, (threshold, threshold)]


def offsets(threshold: int) -> list[int]:
    """At which bytes of a window the rounds look up first ranks: a rank over n bytes comes of two
    over k, at 0 and n - k, each of which comes of two more."""
    out, cover = {0}, [end for _, end in pieces(threshold)]
    for k, n in zip(cover[-2::-1], cover[:0:-1], strict=True):
        out |= {x + n - k for x in out}
    return sorted(out)


def _entries(kind: int, g=0, c=0, key=0, lo=0, n=1) -> pd.DataFrame:
    rows = len(key)
    wide = lambda x: np.broadcast_to(np.asarray(x, np.int64), rows)
    where = TaskContext.get().partitionId() if TaskContext.get() else 0
    return pd.DataFrame({"kind": np.full(rows, kind), "slice": np.full(rows, where), "g": wide(g), "c": wide(c), "key": wide(key), "lo": wide(lo), "n": wide(n)})


def _contexts(b: np.ndarray, off: np.ndarray, whole: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rank, class, row, first window, windows) of every context, in pieces of bounded size."""
    half = pieces(whole)[0][1]
    w = whole - half + 1
    size = np.diff(off)
    for at in range(0, max(1, len(b)), K.SLAB):
        x = b[at : at + K.SLAB + whole - 1]
        if len(x) < whole:
            continue
        s = K.prefix_sums(x)
        g = K.gram_hashes(s, half)
        key = (g & ~_POS) | np.arange(len(g), dtype=U)
        pick = (K.window_min(key, w)[: K.SLAB] & _POS).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)[at : at + len(pick)] if len(size) > 1 else np.zeros(len(pick), np.int64)
        inside = np.arange(at, at + len(pick)) + whole <= off[row + 1]
        pick = np.where(inside, pick, -1)
        new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])]))
        end = np.append(new[1:], len(pick))
        ok = pick[new] >= 0
        lo, hi = new[ok], end[ok]
        p = pick[lo]
        c = K.range_hashes(s, lo, hi + whole - 1) ^ K.mix((p - lo).astype(U))
        yield g[p].view(np.int64), c.view(np.int64), row[lo], lo + at - off[row[lo]], hi - lo


def _firsts(order_by: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order, and where in it a new group of `same` begins."""
    order = np.lexsort(order_by[::-1]) if len(order_by) > 1 else np.argsort(order_by[0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in same:
        v = c[order]
        new[1:] |= v[1:] != v[:-1]
    return order, new


def _runs(key: np.ndarray) -> np.ndarray:
    """The number, from 0, of the run of equal keys that each row is in."""
    return np.append(0, np.cumsum(key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)


def _scan(whole: int) -> Callable:
    """Contexts, and spans of those that repeat inside a batch, where the texts are read."""

    def batch(held: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        g, c, key, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
        # by class alone first: what is alone there needs no order
        by, new = _firsts((c,), (c,))
        several = ~new | np.append(~new[1:], False)
        alone, among = by[~several], by[several]
        order, new = _firsts((g[among], c[among], key[among], lo[among]), (g[among], c[among]))
        order = among[order]
        # the same document may be here twice: its copies of a first context are no repeats
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        dup = order[~new & ((key[order] != key[lead]) | (lo[order] != lo[lead]))]
        dup, f = np.sort(dup), np.sort(np.concatenate([alone, order[new]]))
        yield _entries(SPAN, key=key[dup], lo=lo[dup], n=n[dup])
        yield _entries(CONTEXT, g[f], c[f], key[f], lo[f], n[f])

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            keys = f["_key"].to_numpy(np.int64)
            for a, e, b, off in K.slabs(f["_text"]):
                for g, c, row, lo, n in _contexts(b, off, whole):
                    held.append((g, c, keys[a:e][row], lo, n))
                    size += len(g)
                    if size >= BATCH:
                        yield from batch(held)
                        held, size = [], 0
        if size:
            yield from batch(held)

    return rows


def _classes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reranks a slice of contexts sorted by (g, c, key, lo). Repeats become spans, firsts
    whose rank has others, or lies at an end of the slice, become requests. The first context
    of the slice's first class is left open (HEAD), as its class may have begun before; that of
    its last class is told (TAIL)."""
    held = None  # the last row not passed on, which is the first of its class
    alone = False  # whether its rank has no other context so far
    lead = None  # the first row of the class
    begun = False
    for f in frames:
        if not len(f):
            continue
        x = f[["g", "c", "key", "lo", "n"]].to_numpy(np.int64).T
        if not begun:
            yield _entries(HEAD, *x[:, :1])
            lead, begun, alone = x[:, 0], True, False
            x = x[:, 1:]
            if not x.shape[1]:
                continue
        prev = np.concatenate([lead[:, None], x], axis=1)[:, :-1]
        same_rank = x[0] == prev[0]
        new = ~(same_rank & (x[1] == prev[1]))
        # the leading row of each row's class
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        first = np.where(at >= 0, x[:, np.maximum(at, 0)], lead[:, None])
        repeat = ~new & ((x[2] != first[2]) | (x[3] != first[3]))
        yield _entries(SPAN, key=x[2, repeat], lo=x[3, repeat], n=x[4, repeat])
        # of the first rows, those whose rank has another context before or after them
        p = np.flatnonzero(new)
        if len(p):
            y = x[:, p]
            before = np.concatenate([[same_rank[p[0]]], y[0, 1:] == y[0, :-1]])
            after = np.append(y[0, 1:] == y[0, :-1], False)
            if held is not None and (before[0] or not alone):
                yield _entries(REQUEST, *held[:, None])
            go = (before | after)[:-1]
            yield _entries(REQUEST, *y[:, :-1][:, go])
            held, alone = y[:, -1], not before[-1]
        lead = first[:, -1] if not new[-1] else x[:, -1]
    if begun:
        if held is not None:
            yield _entries(REQUEST, *held[:, None])
        yield _entries(TAIL, *np.asarray(lead)[:, None])


def _positions(whole: int) -> Callable:
    """First ranks of the windows asked for: one row (name of the first bytes, key, lo) for each
    position that the rounds will look up. Rows come sorted by key, the requests of a document
    before its text. Windows that repeat inside a batch are settled here."""
    first, at_bytes = pieces(whole)[0][1], offsets(whole)
    full = max(1, 2 * BATCH // len(at_bytes))

    def flush(out: list) -> Iterator[pd.DataFrame]:
        # documents and, in them, places come in order
        *names, all_of, key, lo = (np.concatenate(x) for x in zip(*out, strict=True))
        order, new = _firsts((all_of,), (names[0], all_of))
        lead = np.zeros(len(key), bool)
        lead[np.minimum.reduceat(order, np.flatnonzero(new))] = True
        dup, go = np.flatnonzero(~lead), np.flatnonzero(lead)
        yield pd.DataFrame({"kind": np.full(len(dup), SPAN), "name": 0, "key": key[dup], "lo": lo[dup]})
        name = np.concatenate([x[go] for x in names])
        keys, los = np.tile(key[go], len(names)), np.concatenate([lo[go] + x for x in at_bytes])
        # names of one place are equal, so that any of them will do
        place = (np.tile(_runs(key)[go], len(names)) << _PLACE) + los
        order, new = _firsts((place,), (place,))
        p = order[new]
        yield pd.DataFrame({"kind": np.full(len(p), CONTEXT), "name": name[p], "key": keys[p], "lo": los[p]})

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, at, done = [], None, False  # ranges of windows asked for, of which key, and whether it was served
        out, size = [], 0
        for f in frames:
            keys, kind = f["_key"].to_numpy(np.int64), f["kind"].to_numpy()
            los, ns, text = f["lo"].to_numpy(np.int64), f["n"].to_numpy(np.int64), f["_text"].tolist()
            # runs of one document's requests, and single texts
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (kind[1:] != REQUEST)) if len(f) else [])
            for a, e in zip(cut, np.append(cut[1:], len(f)), strict=True):
                k = int(keys[a])
                if k != at:
                    asked, at, done = [], k, False
                if kind[a] == REQUEST:
                    asked.append((los[a:e], ns[a:e]))
                    continue
                if not asked or done:
                    continue  # nobody asks here, or the same document again
                done = True
                lo, n = (np.concatenate(x) for x in zip(*asked, strict=True))
                start = np.unique(np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()))
                b = np.frombuffer(text[a].encode("utf-8", "surrogatepass"), np.uint8)
                for piece in range(0, len(b), K.SLAB):
                    q = start[np.searchsorted(start, piece) : np.searchsorted(start, piece + K.SLAB)]
                    if len(q):
                        s = K.prefix_sums(b[piece : piece + K.SLAB + whole])
                        cuts = [*((x, x + first) for x in at_bytes), (0, whole)]
                        h = [K.range_hashes(s, q - piece + i, q - piece + j).view(np.int64) for i, j in cuts]
                        out.append((*h, np.full(len(q), k, np.int64), q))
                        size += len(q)
                if size > full:
                    yield from flush(out)
                    out, size = [], 0
        if out:
            yield from flush(out)

    return rows


def _reranked(last: bool) -> Callable:
    """Reranks a slice of positions sorted by (rank, name, key, lo), where name is the rank at the
    round's offset: the new rank tells slice and number of the pair in it. first: the pair's first
    row here; several: the pair has several rows here. One more row for either end of the slice
    has kind HEAD or TAIL, and alone tells its pair. Rows go on that may matter: those of pairs with several rows, in the
    last round all but their first, and those of pairs that may have begun or may go on in
    another slice. A position that two batches told is one row."""
    cols = ["rank", "name", "key", "lo"]

    def frame(x: np.ndarray, kind: int, new_rank: np.ndarray, first: np.ndarray, several: np.ndarray) -> pd.DataFrame:
        pair = x[:2] if kind != CONTEXT else np.zeros_like(x[:2])
        return pd.DataFrame({"kind": np.full(x.shape[1], kind), "new_rank": new_rank, "first": first, "several": several, **dict(zip(cols, [*pair, *x[2:]], strict=True))})

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held, joined, number = None, False, base  # the last row, whether the row before has its pair, its rank
        for f in frames:
            f = f if "name" in f else f.assign(name=0)
            x = f[cols].to_numpy(np.int64).T
            if held is None:
                if not len(f):
                    continue
                yield frame(x[:, :1], HEAD, np.array([base]), np.array([True]), np.array([False]))
            else:
                x = np.concatenate([held, x], axis=1)
            x = x[:, np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0))]
            same = (x[0, 1:] == x[0, :-1]) & (x[1, 1:] == x[1, :-1])
            new = np.append(not joined, ~same)
            rank = number + np.append(0, np.cumsum(~same))
            several = ~new | np.append(same, False)
            go = np.flatnonzero((~new if last else several)[:-1] | (rank[:-1] == base))
            yield frame(x[:, go], CONTEXT, rank[go], new[go], several[go])
            held, joined, number = x[:, -1:], not new[-1], int(rank[-1])
        if held is not None:
            yield frame(held, CONTEXT, np.array([number]), np.array([not joined]), np.array([joined]))
            yield frame(held, TAIL, np.array([number]), np.array([True]), np.array([False]))

    return rows


def _at_offset(k: int) -> Callable:
    """(rank, rank at the offset of k bytes, key, lo) of the positions that have both. Rows come sorted
    by key, piece and lo; those past the end of their piece are there to be looked up."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((4, 0), np.int64)
        for f in frames:
            x = np.concatenate([held, f[["key", "piece", "lo", "rank"]].to_numpy(np.int64).T], axis=1)
            if not x.shape[1]:
                continue
            key, piece, lo, rank = x
            run = np.append(0, np.cumsum((key[1:] != key[:-1]) | (piece[1:] != piece[:-1])))
            place = (run << _PLACE) + lo
            at = np.minimum(np.searchsorted(place, place + k), len(place) - 1)
            # what a row looks up may be yet to come
            wait = (run == run[-1]) & (lo + k > lo[-1])
            go = np.flatnonzero((place[at] == place + k) & ~wait & (lo // PIECE == piece))
            yield pd.DataFrame({"rank": rank[go], "name": rank[at[go]], "key": key[go], "lo": lo[go]})
            held = x[:, wait]

    return rows


def _doubled(named: DataFrame, threshold: int) -> DataFrame:
    """(key, lo) of the positions that repeat an earlier one over the whole threshold, as a settled
    table. named is settled and goes after the first round; its rows of kind CONTEXT are the
    positions: key, lo and name, which names the first bytes there.

    Each round sorts and reranks; a position whose rank is unique drops out, and with it every
    position that would look it up. The others look up the rank, of the same round, at the offset
    to which the next one reaches: a join of the round's ranks with themselves by document and place. Both
    sides lie in one sort by piece of a document, so a long document is dealt too; what lies within the
    offset after a piece is there once more."""
    spark, size, positions = named.sparkSession, settled_bytes(named), named.filter(F.col("kind") == CONTEXT)
    order = ["rank", "name", "key", "lo"]
    schema = "kind int, new_rank long, first boolean, several boolean, rank long, name long, key long, lo long"
    pairs = positions.select(F.col("name").alias("rank"), "key", "lo")
    cover, old = [end for _, end in pieces(threshold)], [named]
    for i, k in enumerate(cover):
        last = i + 1 == len(cover)
        by = [c for c in order if c in pairs.columns]
        dealt = pairs.repartitionByRange(dealt_over(spark, size), *by).sortWithinPartitions(*by)
        got = settle(dealt.mapInPandas(_reranked(last), schema))
        size = settled_bytes(got)
        # pairs that go on over several slices: two rows a slice, so their number follows the tasks
        tips = got.filter(F.col("kind") != CONTEXT).groupBy("rank", "name").agg(F.min("new_rank").alias("true_rank"), F.collect_set("new_rank").alias("_all"))
        ends = tips.filter(F.size("_all") > 1).select(F.explode("_all").alias("_rank"), "true_rank")
        drop(*old)
        old, rows = [got], got.filter(F.col("kind") == CONTEXT)
        rows = rows.join(F.broadcast(ends), rows["new_rank"] == ends["_rank"], "left")
        rank = F.coalesce("true_rank", "new_rank")
        if last:
            out = settle(rows.filter(~F.col("first") | (rank != F.col("new_rank"))).select("key", "lo"))
            drop(got)
            return out
        left = rows.filter(F.col("several") | F.col("true_rank").isNotNull()).select(rank.alias("rank"), "key", "lo")
        reach = cover[i + 1] - k
        piece = F.floor(F.col("lo") / PIECE)
        before = F.when((F.col("lo") % PIECE < reach) & (piece > 0), F.array(piece - 1, piece)).otherwise(F.array(piece))
        pieces_ = left.withColumn("piece", F.explode(before)).repartition(dealt_over(spark, size), "key", "piece")
        # the sort by ranges reads its input twice; the pairs are few beside what was looked up
        pairs = settle(pieces_.sortWithinPartitions("key", "piece", "lo").mapInPandas(_at_offset(reach), "rank long, name long, key long, lo long"))
        size = settled_bytes(pairs)
        drop(got)
        old = [pairs]
    raise AssertionError


def removed_bytes(size: int, lo: np.ndarray, n: np.ndarray, whole: int) -> np.ndarray:
    """Which bytes of a document the repeated windows cover."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, lo, 1)
    np.add.at(d, lo + n + whole - 1, -1)
    return np.cumsum(d)[:size] > 0


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the characters whose bytes are all removed."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    head = (b & 0xC0) != 0x80
    char = np.cumsum(head) - 1
    keep = np.bincount(char, weights=~gone, minlength=char[-1] + 1 if len(char) else 0) > 0
    return b[keep[char]].tobytes().decode("utf-8", "surrogatepass")


def _apply(whole: int, columns: list[str]) -> Callable:
    """Cuts the texts. Rows come sorted by key, the spans of a document before its rows."""

    def of(text: str | None, lo: np.ndarray | None, n: np.ndarray | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        gone = None if lo is None else removed_bytes(len(raw), lo, n, whole)
        if gone is None or not gone.any():
            return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        clean = kept.decode() if len(raw) == len(text) else cut_text(text, gone)
        return len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), clean

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, spans = None, []
        for f in frames:
            keys, kind = f["_key"].to_numpy(np.int64), f["kind"].to_numpy()
            los, ns, texts = f["lo"].to_numpy(np.int64), f["n"].to_numpy(np.int64), f["_text"].to_numpy()
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (kind[1:] != kind[:-1])) if len(f) else [])
            at, out = [], []
            for a, e in zip(cut, np.append(cut[1:], len(f)), strict=True):
                if keys[a] != key:
                    key, spans = keys[a], []
                if kind[a] == SPAN:
                    spans.append((los[a:e], ns[a:e]))
                    continue
                lo, n = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (None, None)
                at.extend(range(a, e))
                out.extend(of(text, lo, n) for text in texts[a:e])
            if at:
                given = f.iloc[at]
                got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"], index=given.index)
                yield pd.concat([given, got], axis=1)[columns]

    return rows


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 100, keep: list[str] | None = None) -> DataFrame:
    """For each row: key, the columns named in `keep`, n_bytes, n_removed, n_spans,
    kept_sha256, and kept_text (a character goes only if all of its bytes do).

    A byte is removed if a string of `threshold` bytes that covers it also starts earlier:
    in a document with a smaller key, or before it in the same document. Null text counts
    as empty. A text shorter than the threshold stays whole. Rows with the same key and the
    same text are one document and share a result; rows with the same key and different
    texts are ordered by their SHA-256. A null key comes before all others. An empty table gives an
    empty result. Columns not named are ignored, whatever their names. Keys are integers.
    """
    keep = [c for c in keep or [] if c not in (key, text)]
    spark = docs.sparkSession
    bound_batches(spark)
    # what is only carried along goes through Python as text, so that nulls change no type; what
    # has no text of its own (bytes, arrays, maps, structs) as it is
    own = {c: docs.schema[c].dataType for c in keep}
    through = {c: t if isinstance(t, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)) else T.StringType() for c, t in own.items()}
    carried = {c: f"_keep_{i}" for i, c in enumerate(keep)}
    d = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), *[docs[f"`{c}`"].cast(through[c]).alias(n) for c, n in carried.items()])
    ids = d.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    odd = ids.filter((F.col("n") > 1) | F.col("_id").isNull()).limit(1).count()
    if odd:
        names = d.select("_id", F.coalesce(F.col("_text"), F.lit("")).alias("_text")).distinct()
        tie = F.sha2("_text", 256)
        ranked = names.select("_id", tie.alias("_tie"))
        # order the different texts of one key, then number all
        ranked = ranked.withColumn("_sub", F.row_number().over(Window.partitionBy("_id").orderBy("_tie")))
        ranked = number_rows(settle(ranked.orderBy(F.col("_id").asc_nulls_first(), "_sub").withColumn("_seq", F.monotonically_increasing_id())), "_seq", [], "_key").select("_id", "_tie", "_key")
        left = d.withColumn("_tie", F.sha2(F.coalesce(F.col("_text"), F.lit("")), 256))
        r = ranked.select(F.col("_id").alias("_rid"), F.col("_tie").alias("_rtie"), "_key")
        d = settle(left.join(r, left["_id"].eqNullSafe(r["_rid"]) & (left["_tie"] == r["_rtie"])).drop("_tie", "_rid", "_rtie"))
    else:
        d = d.withColumn("_key", F.col("_id").cast("long"))
    slim = d.filter(F.octet_length("_text") >= threshold).select("_key", "_text")
    size = d.agg(F.sum(F.octet_length("_text"))).first()[0] or 0

    scanned = settle(slim.mapInPandas(_scan(threshold), _ENTRY))
    order = ["g", "c", "key", "lo"]
    contexts = scanned.filter(F.col("kind") == CONTEXT)
    dealt = contexts.repartitionByRange(dealt_over(spark, settled_bytes(scanned)), *order).sortWithinPartitions(*order)
    classed = settle(dealt.mapInPandas(_classes, _ENTRY))
    first = settle(scanned.filter(F.col("kind") == SPAN).unionByName(classed).unionByName(_heads(classed)).filter(F.col("kind").isin(SPAN, REQUEST)).select("kind", "key", "lo", "n"))
    drop(scanned, classed)

    none = lambda kind: F.lit(None).cast(kind)
    asked = first.filter(F.col("kind") == REQUEST).select("kind", F.col("key").alias("_key"), "lo", "n", none("string").alias("_text"))
    texts = slim.select(F.lit(REQUEST + 1).alias("kind"), "_key", F.lit(0).cast("long").alias("lo"), F.lit(0).alias("n"), "_text")
    tasks = dealt_over(spark, size)
    both = asked.unionByName(texts).repartition(tasks, "_key").sortWithinPartitions("_key", "kind")
    named = settle(both.mapInPandas(_positions(threshold), "kind int, name long, key long, lo long"))
    here = settle(named.filter(F.col("kind") == SPAN).select("key", "lo"))
    repeats = _doubled(named, threshold)
    singles = here.unionByName(repeats)
    spans = first.filter(F.col("kind") == SPAN).select("key", "lo", "n").unionByName(singles.withColumn("n", F.lit(1)))

    schema = T.StructType([T.StructField("_id", T.StringType()), *[T.StructField(n, through[c]) for c, n in carried.items()]])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept_text", "string")):
        schema = schema.add(name, kind)
    given = d.withColumn("_id", F.col("_id").cast("string")).select(F.lit(SPAN + 1).alias("kind"), F.lit(0).cast("long").alias("lo"), F.lit(0).alias("n"), *d.columns)
    cuts = spans.select(F.lit(SPAN).alias("kind"), "lo", "n", F.col("key").alias("_key"))
    together = given.unionByName(cuts, allowMissingColumns=True).repartition(tasks, "_key").sortWithinPartitions("_key", "kind")
    final = together.mapInPandas(_apply(threshold, schema.fieldNames()), schema)
    back = [F.col(n).cast(own[c]).alias(c) for c, n in carried.items()]
    return final.select(F.col("_id").cast(docs.schema[key].dataType).alias(key), *back, *schema.fieldNames()[1 + len(keep) :])


def _heads(classed: DataFrame) -> DataFrame:
    """What became of the first context of each slice: it repeats one of an earlier slice, is
    that context once more (a repeated row), or is the first of its class and asks."""
    ends = classed.filter(F.col("kind").isin(HEAD, TAIL))
    least = ends.groupBy("g", "c").agg(F.min(F.struct("key", "lo", "slice")).alias("_least"))
    # two rows for each slice: their number follows the tasks
    heads = classed.filter(F.col("kind") == HEAD).join(F.broadcast(least), ["g", "c"])
    same = (F.col("key") == F.col("_least.key")) & (F.col("lo") == F.col("_least.lo"))
    kind = F.when(~same, F.lit(SPAN)).when(F.col("slice") == F.col("_least.slice"), F.lit(REQUEST)).otherwise(F.lit(HEAD))
    return heads.withColumn("kind", kind).select(*classed.columns)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars", threshold: int = 100) -> DataFrame:
    """docs with all its columns, each text cut to what stays of it; a column `size`, if
    there is one, holds the new number of characters. A null text stays null and its size null;
    null keys, repeated rows and an empty table as in `suffix_dedup`."""
    keep = {c: f"_carried{i}" for i, c in enumerate(docs.columns) if c not in (key, text, size)}
    d = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_words"), *[docs[f"`{c}`"].alias(n) for c, n in keep.items()])
    got = suffix_dedup(d, "_doc", "_words", threshold, list(keep.values()))
    out = {key: F.col("_doc"), text: F.col("kept_text"), size: F.char_length("kept_text").cast("long")}
    return got.select(*[out.get(c, F.col(keep.get(c, c))).alias(c) for c in docs.columns])
