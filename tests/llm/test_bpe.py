import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from millrace.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "\n\n  x", "aaaaaaaaaaaa" * 50, "日本語 テスト 😀😀 ½²³", "<|endoftext|>", "a" * 3000, "\x00\x01\x1c a\x85\xa0b", "it's we'LL  ...\t\t\n", "Größe naïve ª º", "x" * 70 + " y" * 9]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_whole():
    keys = [str(i * i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot_key) == list(range(len(keys)))
    assert all(keys[h.find(k)] == k for k in keys)


def test_small_memory_gives_the_same_ids(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    codec = bpe.Codec(ranks, P.PATTERN)
    for k in range(30):
        t = " ".join(f"wörd{(i * k) % 37}y" for i in range(60))
        assert codec.encode(t) == " ".join(map(str, reference.encode_ordinary(t)))


def test_whole_table_as_the_library_does(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**6 + i, t, "n_tokens") for i, t in enumerate(ODD)] + [(None, "no key", "x"), (7, "twice", "x"), (7, "twice", "x")], docs.schema)
    docs = docs.unionByName(extra).withColumnRenamed("lang", "n_tokens")
    want = []
    for r in docs.collect():
        ids = " ".join(map(str, reference.encode_ordinary(r.text or "")))
        want.append((str(r.doc_id), len(ids.split()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, PATH, P.PATTERN).collect()]
    assert sorted(got) == sorted(want)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
