import random
import re

import pytest

from millrace.llm import components, forest

SCHEMA = "doc_id long, text string, cls string, component string"


def sets_of(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def brute(rows):
    s = [sets_of(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                comp[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return sorted((str(k), len(s[i]), str(least[root(i)]), least[root(i)] == k) for i, (k, _) in enumerate(rows))


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = forest.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows)


def family(rnd, n, words, edits, vocabulary=500):
    base = [f"w{rnd.randrange(vocabulary)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        yield " ".join(w)


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, t) for i, t in enumerate(t for n in (1, 5, 12, 30) for t in family(rnd, n, 150, 9))]
    k = len(rows)
    rows += [(k + i, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(1, 300)))) for i in range(60)]
    rows += [(1000, ""), (1001, None), (1002, " \n"), (1003, "A b"), (1004, "a  B"), (1005, "a b c d e"), (1006, "a b c d e f"), (1007, "Ä b"), (1008, "ä b")]
    rows += [(-3, rows[5][1].upper()), (None, rows[5][1]), (None, "lone null key"), (5, rows[5][1]), (1003, "other words here")]
    check(spark, rows)


def test_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 8)
    rnd = random.Random(2)
    rows = list(enumerate([*family(rnd, 60, 120, 7), *family(rnd, 20, 200, 4)]))
    # a chain: each links with the next only, so most lie outside the largest component
    w = [f"c{i}" for i in range(400)]
    rows += [(200 + i, " ".join(w[12 * i : 12 * i + 110])) for i in range(24)]
    check(spark, rows)


@pytest.mark.parametrize("words", range(1, 7))
@pytest.mark.parametrize("before", ["", "long " * 250000])
def test_a_short_text_alone_in_its_slab(words, before):
    text = " ".join(f"w{i}" for i in range(words))
    together = list(forest.shingle_sets([text, "and some other words beside it"], 5))
    got = list(forest.shingle_sets([before, text], 5) if before else forest.shingle_sets([text], 5))
    assert len(got[-1]) == len(sets_of(text)) and (got[-1] == together[0]).all()


@pytest.mark.parametrize("words", [2, 3])
def test_a_table_of_one_short_row(spark, words):
    check(spark, [(1, " ".join(f"w{i}" for i in range(words)))])


def test_one_row_of_each_component_stays_where_keys_repeat(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = lambda t: t + " more"
    rows = [(1, a), (2, b), (2, near(a)), (3, near(b)), (None, near(a) + " x"), (None, "null key"), (4, ""), (4, " "), (4, ""), (5, "five words"), (5, "other"), (6, a)]
    rows += [(0, "z " + " ".join(f"c{i}" for i in range(60))), (0, " ".join(f"c{i}" for i in range(60)))]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.text) for r in forest.without_near_duplicates(df).collect())
    zero = [t for i, t in got if i == "0"]
    assert len(zero) == 1 and (0, zero[0]) in rows
    assert [x for x in got if x[0] != "0"] == sorted([("1", a), ("2", b), ("None", "null key"), ("4", ""), ("4", " "), ("5", "five words"), ("5", "other")])


def test_empty_table(spark):
    assert forest.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 1)], {}), ([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8})])
def test_components(spark, edges, want):
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_long_words_made_to_share_a_polynomial(spark):
    """The Thue-Morse word and its complement are equal under every polynomial modulo 2^64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: "b", 98: "a"})
    other = word.translate({97: "b", 98: "a"})
    check(spark, [(1, word), (2, other), (3, word + " x"), (4, other + " x"), (5, word)])


def test_components_joined_further(spark):
    part = spark.createDataFrame([(2, 1), (1, 1), (4, 3), (3, 3), (6, 5), (5, 5)], "node long, component long")
    more = spark.createDataFrame([(4, 2), (9, 8), (8, 6), (20, 21)], "a long, b long")
    got = {r.node: r.component for r in forest.joined_further(part, more).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 5, 9: 5, 20: 20, 21: 20}
    assert forest.joined_further(part, more.limit(0)).count() == 6
