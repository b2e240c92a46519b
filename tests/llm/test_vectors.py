"""Vector codes and hard negatives against brute force, on odd rows too."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import codes, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, _x string, code string, _id string"
NAN, INF = float("nan"), float("inf")


def table(rnd, n, dims, spread=1.0, labels=3):
    rows = [(i, [rnd.gauss(0, spread) for _ in range(dims)], rnd.randrange(labels)) for i in range(n)]
    rows += [(3, None, 1), (-5, [NAN] * dims, 1), (n, [None] * dims, 2), (n + 1, [INF] + [0.0] * (dims - 1), 0)]
    rows += [rows[7], rows[7], (7, rows[8][1], 1), (None, rows[5][1], 1), (n + 2, rows[5][1], None), (n + 3, rows[5][1], rows[5][2]), (-100, rows[20][1], rows[20][2]), (100, rows[20][1], rows[20][2])]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


def whole(v, scale, width):
    return [math.floor(scale * float(np.float32(x))) for x in v] + [0] * (width - len(v))


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_codes(rows, parts, entries, rounds, scale=1024):
    rows = [r for r in rows if fine(r[1])]
    width = max(1, -(-max((len(r[1]) for r in rows), default=0) // parts))
    x = [(r[0], whole(r[1], scale, parts * width), r[2]) for r in rows]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = [v for _, _, v in sorted((k is None, k or 0, v) for k, v, _ in x)][:entries]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    for r in range(rounds + 1):
        got = [[min((far(cut(v, p), c), i) for i, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in x]
        if r < rounds:
            for p in range(parts):
                for i in range(len(books[p])):
                    own = [cut(v, p) for (_, v, _), g in zip(x, got, strict=True) if g[p][1] == i]
                    if own:
                        books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in g) for g in got]
    by = {}
    for (_, _, label), e in zip(x, error, strict=True):
        by[label] = by.get(label, 0) + e
    return sorted(repr((k, "".join(f"{i:02x}" for _, i in g), e, by[label], sha)) for (k, _, label), g, e in zip(x, got, error, strict=True))


@pytest.mark.parametrize("n,dims,entries,spread", [(120, 8, 16, 1.0), (90, 10, 256, 0.001), (60, 3, 7, 30.0)])
def test_codes_match_brute_force(spark, n, dims, entries, spread):
    rows = table(random.Random(n), n, dims, spread)
    if dims == 10:
        rows += [(500, [], 1), (501, [1.0], 1), (502, [0.5] * 7, None)]
    got = codes.encode(frame(spark, rows), entries=entries)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_codes(rows, 4, entries, 4)


def test_the_search_finds_the_least_number_of_equally_near_entries():
    rnd = np.random.default_rng(3)
    book = codes.Codebook(rnd.integers(-3, 4, (60, 3)))
    x = rnd.integers(-4, 5, (4000, 3)).astype(float)
    d = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2).astype(int)
    for before in (np.zeros(4000, int), rnd.integers(0, 60, 4000)):
        code, error = book.nearest(x, before)
        assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_codes_of_nothing_and_of_too_much(spark):
    assert codes.encode(frame(spark, [])).collect() == []
    assert codes.encode(frame(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(ValueError, match="too large"):
        codes.encode(frame(spark, [(1, [1e30], 1)]))


def brute_negatives(rows):
    rows = [r for r in rows if r[2] is not None and fine(r[1])]
    width = max((len(r[1]) for r in rows), default=0)
    x = [(k, whole(v, 256, width), (label + 1) % 10 if k is not None and k % 7 == 0 else label) for k, v, label in rows]
    out = []
    for a, (k, v, label) in enumerate(x):
        if k is None or k % 100:
            continue
        s = sorted((-sum(i * j for i, j in zip(v, w, strict=True)), i is None, i or 0, other == label) for b, (i, w, other) in enumerate(x) if b != a)
        for p, none, i, _ in [y for y in s if y[3]][:5]:
            fit = [y for y in s if not y[3] and 80 * -p <= 100 * -y[0] <= 100 * -p][:5]
            out += [(k, None if none else i, r + 1, None if y[1] else y[2], -p, -y[0]) for r, y in enumerate(fit)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("n,dims,labels", [(450, 4, 3), (220, 2, 2), (130, 8, 1)])
@pytest.mark.parametrize("blocks", [(1024, 4096, 16 << 20), (2, 50, 64)])
def test_negatives_match_brute_force(spark, monkeypatch, n, dims, labels, blocks):
    for name, value in zip(("BLOCK", "ROWS", "ANCHORS"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rows = table(random.Random(n), n, dims, labels=labels)
    v = frame(spark, rows)
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = negatives.mine(v, F.col("vec_id") % 100 == 0).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_negatives(rows)
    assert labels == 1 or got


def test_negatives_of_nothing(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, None, 1), (200, [1.0], None)]):
        assert negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).collect() == []
    with pytest.raises(ValueError, match="too large"):
        negatives.mine(frame(spark, [(1, [1e30], 1)]), F.col("vec_id") % 100 == 0)
