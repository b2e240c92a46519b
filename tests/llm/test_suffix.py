import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from millrace.llm import suffix

SCHEMA = "doc_id long, text string, lang string, n_chars long"


def brute(rows, whole=100):
    """Straight from the definition, over distinct (doc_id, text) in order."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest()))
    seen, out = set(), {}
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - whole + 1):
            s = b[p : p + whole]
            if s in seen:
                gone[p : p + whole] = b"\1" * whole
            seen.add(s)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    return out


def check(spark, rows, whole=100):
    df = spark.createDataFrame([(i, t, "en", None) for i, t in rows], SCHEMA)
    got = suffix.suffix_dedup(df, threshold=whole, keep=["lang", "n_chars"]).collect()
    want = brute(rows, whole)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert r.lang == "en" and r.n_chars is None
    for (i, t), w in want.items():
        assert w in by[i], (i, t[:50], w, by[i])
    return got


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(40), prose(120)
    rows = [(i, prose(60)) for i in range(20)]
    rows += [(20 + i, prose(5) + passage[i:] + prose(20)) for i in range(12)]
    for i in range(15):  # near copies
        w = base.split()
        for _ in range(3):
            w[rnd.randrange(len(w))] = word()
        rows.append((40 + i, " ".join(w)))
    rows += [(60 + i, base) for i in range(5)]
    rows += [(70, "ab" * 400), (71, "ab" * 90), (72, "x" * 99), (73, "x" * 100), (74, "x" * 101), (75, ""), (76, None)]
    rows += [(-5, passage), (90, "ab" * 30), (91, "\n".join([passage] * 3))]
    check(spark, rows)


def test_long_document_in_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    part = "".join(rnd.choice("abcdef ") for _ in range(3000))
    big = part * 3 + "".join(rnd.choice("abcdef ") for _ in range(5000)) + part
    monkeypatch.setattr(suffix.K, "SLAB", 1 << 11)
    check(spark, [(1, big), (2, part[500:2500])])


def test_repeated_rows_ties_nulls_and_empty(spark):
    rnd = random.Random(5)
    p = "".join(rnd.choice("abc ") for _ in range(300))
    rows = [(1, p), (1, p), (1, p[50:] + "zz"), (None, p[:120]), (None, None), (3, p[10:200])]
    got = check(spark, rows)
    assert len({(r.n_removed, r.kept_text) for r in got if r.doc_id == 1 and r.n_bytes == 300}) == 1
    assert suffix.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("whole", [1, 2, 7, 64, 130, 1000])
def test_any_threshold_in_as_many_rounds_as_it_takes(spark, whole):
    assert suffix.pieces(whole)[-1][1] == whole and len(suffix.pieces(whole)) == {1: 2, 2: 2, 7: 3, 64: 2, 130: 3, 1000: 6}[whole]
    rnd = random.Random(whole)
    prose = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    p = prose(3 * whole)
    rows = [(i, prose(rnd.randrange(2 * whole)) + p[rnd.randrange(whole) :][: rnd.randrange(whole, 2 * whole + 1)] + prose(9)) for i in range(25)]
    check(spark, [*rows, (30, p), (31, p), (31, p), (32, "z" * (2 * whole + 1)), (33, "")], whole)


def test_one_rank_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix, "dealt_over", lambda *_: 23)
    rnd = random.Random(6)
    mid = "".join(rnd.choice("abc ") for _ in range(70))
    rows = [(i, "".join(rnd.choice("abc ") for _ in range(80)) + mid + ("q" * 40 if i % 3 else "r" * 45)) for i in range(40)]
    rows += [(100 + i, mid + "s" * 200) for i in range(30)] + [(100, mid + "s" * 200)] * 5
    check(spark, rows)


def test_text_is_cut_between_characters():
    import numpy as np

    t = "aébéc"
    gone = np.array([0, 0, 1, 1, 1, 1, 0], bool)
    assert suffix.cut_text(t, gone) == "aéc"


def test_ranks_at_an_offset_over_batches_and_pieces():
    """Rows of a piece over many batches; those past its end are looked up but look up nothing."""
    rnd, k, end = np.random.default_rng(3), 50, suffix.PIECE
    rows = []
    for key in (-7, 4, 9):
        los = sorted({int(x) for x in rnd.integers(end - 400, end + 400, 300)})
        rows += [(key, lo // end, lo, 1000 * key + lo % 97) for lo in los]
        rows += [(key, 0, lo, 1000 * key + lo % 97) for lo in los if end <= lo < end + k]
    rows.sort()
    table = pd.DataFrame(rows, columns=["key", "piece", "lo", "rank"])
    rank = {(key, lo): r for key, _, lo, r in rows}
    want = sorted((r, rank[key, lo + k], key, lo) for (key, lo), r in rank.items() if (key, lo + k) in rank)
    for step in (1, 7, 64, 5000):
        got = pd.concat(suffix._at_offset(k)(table[i : i + step] for i in range(0, len(table), step)))
        assert sorted(got[["rank", "name", "key", "lo"]].itertuples(index=False, name=None)) == want and len(want) > 200
