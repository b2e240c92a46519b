"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash

SCHEMA = "doc_id long, text string, fp string, _id string, mask string"


def brute_print(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    k = min(width, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    fp = [brute_print(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                comp[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return sorted((str(k), f"{fp[i]:016x}", str(least[root(i)])) for i, (k, _) in enumerate(rows))


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute(rows)


def family(rnd, n, words, edits):
    base = [f"w{rnd.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [256, 64])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(4)
    rows = list(enumerate(t for n, words in ((40, 300), (30, 120), (20, 30)) for t in family(rnd, n, words, 5)))
    rows += [(500 + i, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(1, 50)))) for i in range(60)]
    rows += [(1000, ""), (1001, None), (1002, " \n\x0b"), (1003, "A b"), (1004, "a  B"), (1005, "a b\tc"), (1006, "Ä b"), (1007, "ä b"), (1008, "one")]
    rows += [(-3, rows[5][1].upper()), (None, rows[5][1]), (None, "lone null key"), (5, rows[5][1]), (1003, "other words here")]
    rows += [(2000, "long text " * 100_000), (2001, "long text " * 100_001)]
    check(spark, rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    rnd = random.Random(radius)
    fixed = 0
    while fixed.bit_count() < 56:
        masks = simhash.covering_masks(fixed, radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(m & fixed == fixed and m != fixed for m in masks)
        free = [i for i in range(64) if not fixed >> i & 1]
        for _ in range(3000):
            apart = sum(1 << i for i in rnd.sample(free, min(radius, len(free))))
            assert any(not m & apart for m in masks)
        fixed = rnd.choice(masks)


@pytest.mark.parametrize("radius,block", [(3, 256), (3, 64), (2, 16)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, radius, block):
    """Most of them share each table's bucket, and are told apart by few bits."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(7)
    bits = rnd.sample(range(64), 14)
    x = sorted({simhash._signed(sum(rnd.getrandbits(1) << b for b in bits)) for _ in range(700)} | {rnd.getrandbits(63) for _ in range(50)})
    df = spark.createDataFrame([(i,) for i in x], "fp long").select(F.col("fp"))
    from millrace.llm.sparkit import settle

    got = {(r.a, r.b) for r in simhash.links(settle(df), radius).collect()}
    y = np.array(x)
    near = np.bitwise_count(y[:, None] ^ y[None, :]) <= radius
    from millrace.llm.forest import spread_labels

    assert all(a != b for a, b in got)
    at = {v: i for i, v in enumerate(x)}
    linked = np.eye(len(x), dtype=bool)
    for a, b in got:
        linked[at[a], at[b]] = linked[at[b], at[a]] = True
    assert (spread_labels(linked) == spread_labels(near)).all()
