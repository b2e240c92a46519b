import functools
import hashlib
import re

import pytest
import xxhash

from millrace.llm import fingerprints as P
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, next string, n_chars string"


def xx(s, seed=42):
    return xxhash.xxh64_intdigest(s.encode() if isinstance(s, str) else s, seed)


def xx_long(v, seed):
    return xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), seed)


def xx_int(v, seed):
    return xxhash.xxh64_intdigest(v.to_bytes(4, "little"), seed)


@functools.cache
def brute(text):
    dense, n, bits = [0] * P.DENSE, 0, [0] * P.BITS
    for par in text.split("\n"):
        h = xx(par)
        for i in range(P.DENSE):
            dense[i] += xx_int(i, xx_long(h, 42)) & 0xFFFFFFFF
        w = re.split(r"[\x20\x09-\x0D]+", par)
        pairs = [xx(b, xx(a)) for a, b in zip(w, w[1:])] or [xx(w[0])]
        for h0 in pairs:
            h1 = xx_long(h0, 42)
            n += 1
            for b in range(P.BITS // 2):
                h = h1 if b >= 32 else h0
                bits[2 * b] += h >> (b % 32) & 1
                bits[2 * b + 1] += h >> (b % 32) >> 32 & 1
    return "".join(f"{x % 2**32:08x}" for x in [*dense, n, *bits])


def like(a, b):
    """Likeness of two fingerprints, from their text."""
    if a == b:
        return 1.0
    x, y = ([int(v[i : i + 8], 16) for i in range(0, len(v), 8)][P.DENSE :] for v in (a, b))
    x, y = ([2 * v - n for v in rest] for n, *rest in (x, y))
    dot = lambda p, q: sum(u * v for u, v in zip(p, q))
    norm = (dot(x, x) * dot(y, y)) ** 0.5
    return min(1.0, max(0.0, dot(x, y) / norm)) if norm else 0.0


def edits(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    for k, (i, t) in enumerate(order):
        after, m = order[(k + 1) % len(order)][1], len(t) // 3
        yield i, t, t[: len(t) - m] + after[:m], after


def test_matches_brute_force(spark):
    rows = [(i, "\n".join(f"Zeile {j} läuft \tund wörter {i * j}" for j in range(i % 7)) + " end" * (i % 3)) for i in range(40)]
    rows += [(50, ""), (51, None), (52, "x"), (53, "\n\n"), (None, "null key text"), (54, "same"), (54, "same"), (55, "a b c\n" * 200)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = P.fingerprint_edits(df).collect()
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), brute(t), brute(e)) for i, t, e, _ in edits(rows))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
    near = sorted((str(i), round(like(brute(t), brute(e)), 9), round(like(brute(t), brute(n)), 9)) for i, t, e, n in edits(rows))
    assert sorted((str(r.doc_id), round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == near


def test_likeness_of_very_long_texts(spark):
    """More word pairs than 16 bits count: unrelated texts stay unlike, a half-changed one is half alike."""
    rows = [(i, " ".join(f"{c}{k * 7919 % 99991}" for k in range(40_000))) for i, c in ((3, "a"), (2, "b"))]
    rows.append((1, "same pair " * 40_000))
    got = {r.doc_id: r for r in P.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: (brute(t), brute(e), brute(n)) for i, t, e, n in edits(rows)}
    for i, (own, edited, after) in want.items():
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (own, edited)
        assert r.near_edited == pytest.approx(like(own, edited), abs=1e-9) and r.near_next == pytest.approx(like(own, after), abs=1e-9)
    assert got[3].near_next < 0.5


def test_order_of_paragraphs_insertion_and_deletion(spark):
    df = spark.createDataFrame([(1, "a b\nc d e\nf"), (2, "f\na b\nc d e"), (3, "a b\nf"), (4, "c d e")], "id long, text string")
    v = P.vectors(df, ["id"], {"v": "text"})
    by = {r.id: r.v for r in v.collect()}
    assert by[1] == by[2] != by[3]
    one = v.filter("id = 1").select(F.col("v").alias("a")).crossJoin(v.filter("id = 4").select(F.col("v").alias("b")))
    assert one.select(P.combine(F.col("a"), F.col("b"), -1)).first()[0] == by[3]
    back = v.filter("id = 3").select(F.col("v").alias("a")).crossJoin(v.filter("id = 4").select(F.col("v").alias("b")))
    assert back.select(P.combine(F.col("a"), F.col("b"))).first()[0] == by[1]


@pytest.mark.parametrize("rows", [[], [(1, "only one\nrow")]])
def test_empty_and_single(spark, rows):
    got = P.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.near_next == 1 for r in got)
