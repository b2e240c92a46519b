"""The pipeline against the brute-force version of each stage, in turn."""

import hashlib
import math
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from millrace.llm import bpe, langid, suffix

from . import test_forest, test_suffix


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = corpus_pipeline.queries.language_model(docs)
    judged = {r.doc_id: r.rejected for r in langid.predict(docs, model).collect()}
    rows = [r for r in rows if not judged[r[0]]]
    assert len(rows) > 0.95 * len(judged)
    kept = {k for k, _, _, own in test_forest.brute([(i, t) for i, t, _ in rows]) if own}
    rows = [r for r in rows if str(r[0]) in kept]
    gone, seen = {}, set()
    for i, t, _ in sorted(rows):
        b = t.encode()
        g = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                g[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        gone[i] = g
    import numpy as np

    rows = [(i, suffix.cut_text(t, np.frombuffer(bytes(gone[i]), bool)) if t else t, s) for i, t, s in rows]
    n = Counter(s for _, _, s in rows)
    total = sum(math.sqrt(c) for c in n.values())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t, s in rows:
        rate = math.sqrt(n[s]) / total * len(rows) / n[s]
        u = int(hashlib.md5(f"7|{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while u >= c:
            k += 1
            p *= rate / k
            c += p
        ids = enc.encode_ordinary(t)
        want += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * k
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
    assert test_suffix.SCHEMA.startswith("doc_id")


def test_the_last_stage_returns_the_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    got = corpus_pipeline.tokenize(spark, docs, sf_dir).collect()
    assert len(got) == 20 and all(len(r.token_ids.split()) == r.n_tokens for r in got)
    assert all(hashlib.sha256(r.token_ids.encode()).hexdigest() == r.ids_sha256 for r in got)


def test_stages_keep_the_columns_and_bear_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0


def test_columns_of_any_name_and_type_go_through(spark, sf_dir):
    """Names that the stages use themselves, and types that have no text of their own."""
    import datetime

    kind = "_u string, _s long, _src string, _rate double, _poisson boolean, _own string, _key long, _id timestamp, n_bytes string, kept_text long, `a.b` string, arr array<int>, m map<string, long>, st struct<x: int, y: array<string>>, raw binary, _text string"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = ("u", 7, None, 0.5, True, "o", 3, datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), "n", 9, "dot", [1, None, 3], {"a": 1, "b": None}, (4, ["x", None]), b"\x00\xff", "t")
    empty = (None,) * len(odd)
    more = docs.select("doc_id").collect()
    extra = spark.createDataFrame([(r.doc_id, *(odd if r.doc_id % 3 else empty)) for r in more], f"k long, {kind}")
    wide = docs.join(extra, docs.doc_id == extra.k).drop("k")
    want = {r.doc_id: r for r in wide.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns and out.dtypes == wide.dtypes, name
        got = out.collect()
        assert got, name
        for r in got:
            w = want[r.doc_id]
            for c in wide.columns:
                if c not in ("text", "n_chars"):
                    assert r[c] == w[c], (name, c)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf_dir).count() == len(want)


def test_copies_between_the_stages_go(spark, sf_dir):
    import os

    from millrace.llm.sparkit import shared_dir

    base = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(base))
    corpus_pipeline.run(spark, sf_dir).count()
    new = set(os.listdir(base)) - before
    whole = [d for d in new if set(spark.read.parquet(f"file://{base}/{d}").columns) >= {"doc_id", "text", "source", "n_chars"}]
    assert len(whole) == 1  # what the last stage reads
