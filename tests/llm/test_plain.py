"""Sharding, mixing, rules and archives against straightforward versions."""

import base64
import decimal
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, queries, rules, sharding, warc

SCHEMA = "doc_id long, text string, source string, shard string"
ROWS = [(i, f"text {i % 9} é", f"s{i % 3 if i % 4 else 0}", "clash") for i in range(300)] + [(None, "x", None, "c"), (500, None, "s0", "c"), (501, "", "s0", "c"), (7, "again", "s1", "c"), (2**60, "big", "s2", "c"), (-5, "neg", "s2", "c")]


def jump_one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def mixed(k):
    z = k % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    return z ^ z >> 31


def test_shards(spark):
    got = sharding.shard(spark.createDataFrame(ROWS, SCHEMA), 8).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump_one(mixed(i or 0), 8), jump_one(mixed(i or 0), 9)) for i, t, _, _ in ROWS)
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(8):
        own = sorted((r.slot, -1 << 70 if r.doc_id is None else r.doc_id) for r in got if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own)))
        assert [k for _, k in own] == sorted(k for _, k in own)
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in got)
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards_are_even_and_grow_by_their_share():
    k = np.array([mixed(i) for i in range(40000)], np.uint64)
    a, b = sharding.jump(k, 8), sharding.jump(k, 9)
    assert abs(np.bincount(a) / 5000 - 1).max() < 0.06
    assert (a != b).mean() == pytest.approx(1 / 9, abs=0.01) and (b[a != b] == 8).all()


def test_mixing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("shard", "mix_copy")
    for weights in (None, {"s0": 3.0, "s1": 1.0, None: 2.0}):
        n = {}
        for r in ROWS:
            n[r[2]] = n.get(r[2], 0) + 1
        w = {s: math.sqrt(c) if weights is None else weights.get(s, 0.0) for s, c in n.items()}
        rate = {s: w[s] / sum(w.values()) * len(ROWS) / n[s] for s in n}
        want = []
        for i, _, s, _ in ROWS:
            u = int(hashlib.md5(f"7|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate[s])
            k = 0
            while u >= c and k < 200:
                k += 1
                p *= rate[s] / k
                c += p
            want += [(str(i), str(s), j) for j in range(k)]
        got = mixing.mix_sources(df, weights).collect()
        assert sorted((str(r.doc_id), str(r.source), r.mix_copy) for r in got) == sorted(want)
        order = [r.mix_order for r in got]
        assert order == sorted(order)
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_poisson_has_its_mean(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = {r.source: r.c for r in mixing.mix_sources(df, {"a": 1.0, "b": 1.0}, deal=False).groupBy("source").agg(F.count("*").alias("c")).collect()}
    assert got["a"] == pytest.approx(10000, rel=0.05) and got["b"] == pytest.approx(10000, rel=0.05)


def poisson_by_decimals(rate, u):
    """The count of rational mean `rate` at which the distribution function passes u."""
    with decimal.localcontext() as c:
        c.prec = 80
        rate, u = decimal.Decimal(rate.numerator) / rate.denominator, decimal.Decimal(u)
        p = total = (-rate).exp()
        k = 0
        while u >= total:
            k += 1
            p *= rate / k
            total += p
        return k


@pytest.mark.parametrize("tiny,big", [(3, 300), (2, 4000), (1, 9000)])
def test_small_sources_reach_half_the_mix(spark, tiny, big):
    """Rates of about 50, 1,000 and 4,500: over 64 copies, and means whose exp(-rate) vanishes."""
    df = spark.range(tiny + big).select(F.col("id").alias("doc_id"), F.when(F.col("id") < tiny, "tiny").otherwise("big").alias("source"))
    rows = mixing.mix_sources(df, {"tiny": 1.0, "big": 1.0}, ceiling=None).collect()
    rate = Fraction(tiny + big, 2 * tiny)
    got = {}
    for r in rows:
        if r.source == "tiny":
            assert r.mix_rate == pytest.approx(float(rate), rel=1e-12)
            got.setdefault(r.doc_id, []).append((r.mix_copy, r.mix_copies))
    for i in range(tiny):
        want = poisson_by_decimals(rate, int(hashlib.md5(f"7|{i}".encode()).hexdigest()[:13], 16) / 2**52)
        assert sorted(got[i]) == [(j, want) for j in range(want)]
    share = sum(map(len, got.values())) / len(rows)
    assert share == pytest.approx(0.5, abs=0.08)
    order = [r.mix_order for r in rows]
    assert order == sorted(order)


def test_op7_and_pipeline_cut_no_rate(spark, tmp_path):
    df = spark.range(20001).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 1, "tiny").otherwise("big").alias("source"), F.lit(1).alias("n_chars"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = 20001 / (1 + math.sqrt(20000))  # the tiny source's share of roots, for its one row
    got = queries.op7_mixing(spark, str(tmp_path)).filter("source = 'tiny'").collect()
    assert len(got) == got[0].mix_copies == pytest.approx(want, abs=5 * math.sqrt(want)) and got[0].mix_rate == pytest.approx(want)
    assert corpus_pipeline.mix_to_weights(spark, df, "").filter("source = 'tiny'").count() == len(got)


def test_poisson_of_large_means():
    rnd = random.Random(3)
    rates = [0.0, 1e-9, 0.3, 1.0, 63.9, 64.1, 700.0, 999.0, 5000.0, 2e6]
    table = mixing._distribution(pd.Series(rates))
    for rate, low, cdf in zip(rates, table.low, table.cdf, strict=True):
        assert len(cdf) < 24 * math.sqrt(rate) + 60 and cdf[-1] == 1 and (np.diff(cdf) >= 0).all()
        u = np.array([rnd.random() for _ in range(4000)])
        k = low + np.searchsorted(cdf, u, side="right")
        assert abs(k.mean() - rate) <= 5 * math.sqrt(rate / 4000) + 1e-6
        if rate >= 64:
            assert k.var() == pytest.approx(rate, rel=0.15)


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit, times = set(), Counter(grams)
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines, dup = [], 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.append(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_rules(spark):
    rnd = random.Random(1)
    prose = lambda n: " ".join(rnd.choice("wort haus éa. zu, in das der x\x1cy\xa0z".split(" ")) for _ in range(n)) + "."
    texts = [prose(rnd.randrange(1, 90)) + "\n" + prose(20) * rnd.randrange(3) for _ in range(60)]
    texts += [None, "", "\n\n", "a b c a b c", "# * $ | <b>", "same\nsame\n \nsame", "Home | About | News | Mail\n" + prose(80)]
    rows = [(i, t, "s", "c") for i, t in enumerate(texts)] + [(0, texts[0], "s", "c"), (None, "x", "s", "c")]
    got = rules.clean_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((str(i), *base_counts(t)) for i, t, _, _ in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert rules.clean_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "line,fault",
    [("Home | About | Contact", "navigation"), ("the*** of### in$$$ a&&& word", "symbols"), ("la la la la la", "repetition"), ("THE!! BIG!! SALE!! NOW!!", "shouting"), ("Please accept our cookie policy.", "boilerplate"), ("no end here", "punctuation"), ("A sentence. And a cut", None), ("A whole sentence.", None)],
)
def test_line_faults(line, fault):
    assert rules.line_fault(line, line.split()) == fault


def test_documents_that_lose_too_much_are_rejected():
    text = "\n".join(f"This{i} is{i} a{i} plain{i} sentence{i} of{i} some{i} words{i}." for i in range(8))
    assert rules.judge(text)["kept"]
    junk = "\n".join(f"Home{i} | News{i} | About{i} | Contact{i} | Search{i}" for i in range(40))
    bad = rules.judge(junk + "\n" + text)
    assert not bad["kept"] and not bad["base_failed"] and bad["clean_text"] == text


def verdict(rows):
    """The verdict straight from the rules, over all rows (source, text)."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lines_of = lambda t: [x for x in (t or "").split("\n") if word.search(x)]
    held = {}
    for s, t in rows:
        own = sorted({(xxhash.xxh64_intdigest(x.encode(), 42) ^ 1 << 63, x) for x in lines_of(t)})
        for x in own if len(own) > 1 else []:
            held.setdefault((s, x[1]), set()).add((own[1] if x == own[0] else own[0], tuple(own)))
    shared = {k for k, v in held.items() if len(v) >= 10 and len({c for c, _ in v}) >= 0.5 * len(v)}
    out = []
    for s, t in rows:
        lost = total = 0
        for x in lines_of(t):
            w = word.findall(x)
            phrases = sum(len(m[0]) for m in rules.BOILERPLATE.finditer(x))
            ended = any(v.endswith(rules.ENDS) for v in w)
            symbols = sum(bool(rules.SYMBOLS.search(v)) for v in w) > 0.3 * len(w)
            links = sum(v in rules.NAVIGATION for v in w) > 0.2 * len(w)
            echo = len(w) > 3 and sum(a == b for a, b in zip(w, w[1:])) > 0.3 * len(w)
            loud = len(w) > 3 and sum(v.isupper() for v in w) > 0.5 * len(w)
            bad = not ended or symbols or links or echo or loud or phrases > 0.05 * len(x) or (s, x) in shared
            total, lost = total + len(x), lost + bad * len(x)
        out.append((not base_counts(t)[-1] and 2 * lost <= total, round(lost / total, 9) if total else 0.0))
    return out


def test_verdict_and_learned_boilerplate(spark):
    rnd = random.Random(9)
    prose = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n)) + "."
    footer = "Tous droits réservés, et une longue ligne de pied de page qui revient partout. " * 4
    rows = [("a", prose(70) + "\n" + footer) for _ in range(14)] + [("b", prose(70) + "\n" + footer) for _ in range(9)]
    copies = prose(60) + "\n" + prose(40) + "\n" + prose(30)
    rows += [("a", copies)] * 20 + [("a", copies.replace("w1", "v1", i)) for i in range(5)]
    rows += [(None, prose(40) + "\n" + footer + "\n" + prose(30)) for _ in range(12)]
    rows += [("a", None), ("a", ""), (None, "\u00a0\n" + prose(60)), ("c", prose(80) + " privacy policy and more."), ("c", "click here. " + prose(50)), ("c", prose(200_000))]
    df = spark.createDataFrame([(i, t, s, True) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string, kept boolean")
    got = {r.doc_id: (r.kept, round(r.lost_share, 9)) for r in rules.clean_lines(df).collect()}
    assert [got[i] for i in range(len(rows))] == verdict(rows)
    assert not any(got[i][0] for i in range(14) if 2 * len(footer) > len(rows[i][1])) and all(got[i][0] for i in range(14, 40))


def test_documents_of_a_line_are_counted_exactly(spark):
    rows = []
    for s in range(60):  # a source each: ten documents share a line in even ones, nine in odd ones, with copies
        own = rules.SHARED - s % 2
        rows += [(f"s{s}", f"line of {s}\nown text {s} {i}") for i in range(own) for _ in range(1 + i % 3)]
    got = {(r.source) for r in rules.learned_lines(spark.createDataFrame(rows, "source string, text string")).collect()}
    assert got == {f"s{s}" for s in range(0, 60, 2)}


def test_quality_labels_agree(spark):
    d = "/root/testdata/sf0.01"
    got = rules.clean_lines(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert all(r.kept for r in got if r.quality == 1) and not any(r.kept for r in got if r.quality == 0)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


PAGES = [(i, f"http://h/{i} x", f"<p>seite {i % 5 if i < 20 else i} é</p>" * 30) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "ü\r\n", "WARC/1.1\r\n\r\nnot a record"), (None, "n", "lone"), (None, "n", "<p>seite 1 é</p>" * 30), (103, "u", "\x1f"), (103, "u", "\x1f")]


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, PAGES)).collect()
    most = {}
    for i, _, h in PAGES:
        if i is not None:
            most[h or ""] = max(most.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        m = most.get(h or "")
        again = m is not None and i != m
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", str(m if again else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_payloads_come_back(spark):
    back = warc.read_archives(warc.archives(pages(spark, PAGES[:30]))).collect()
    html = {i: (h or "").encode() for i, _, h in PAGES}
    assert len(back) == 30 and all(bytes(r.payload) == html[r.page_id] for r in back if r.record_type == "response")


def records(n=12, zipped=True):
    out = [warc.write_record(i, f"http://h/{i}", bytes([65 + i]) * (50 + 40 * i), None, False) for i in range(n)]
    return [gzip.compress(x) for x in out] if zipped else out


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    whole = records(zipped=zipped)
    at = np.append(0, np.cumsum([len(x) for x in whole]))
    raw = bytearray(b"".join(whole))
    for k in (3, 4, 8):
        p = int(at[k]) + len(whole[k]) // 2 + (10 if zipped else 60)
        raw[p] ^= 0x55
    raw = bytes(raw[: int(at[11]) + len(whole[11]) // 2])
    got = list(warc.salvage(raw))
    assert [r["page_id"] for *_, why, r in got if not why] == [0, 1, 2, 5, 6, 7, 9, 10]
    gaps = [(a, n) for a, n, why, _ in got if why]
    assert gaps == [(at[3], at[5] - at[3]), (at[8], len(whole[8])), (at[11], len(raw) - at[11])]
    assert sum(n for _, n, _, _ in got) == len(raw)


def test_salvage_of_other_inputs():
    assert list(warc.salvage(b"")) == []
    assert [(a, n) for a, n, why, _ in warc.salvage(b"garbage" * 9) if why] == [(0, 63)]
    plain = b"noise" + b"".join(records(2, zipped=False)) + b"".join(records(1))
    assert [r.get("page_id") for *_, r in warc.salvage(plain)] == [None, 0, 1, 0]
    both = gzip.compress(b"".join(records(3, zipped=False)))
    assert [r["page_id"] for *_, r in warc.salvage(both)] == [0, 1, 2]
