import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import langid, quality, queries

ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "123 !!! \n"), (10**6 + 3, "é"), (10**6 + 4, "x" * 50000), (None, "the and of"), (7, "the same row"), (7, "the same row")]


def odd_docs(spark, schema):
    return spark.createDataFrame([(i, t, None, "score", 0) for i, t in ODD], schema)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(y, got[i].score) for i, y in labels.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    auc = np.mean([a > b for a in good for b in bad])
    assert auc > 0.95, auc
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    right = np.mean([(s >= 0.3) == y for y, s in held])
    assert right > 0.9, right
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_quality_of_odd_rows_and_no_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = quality.score(odd_docs(spark, docs.schema), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    blank = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_features_of_a_long_text_in_any_company():
    texts = ["Hello WORLD!! hello hello", "", "é ÉÉ!! a", "b" * 3000 + " c"]
    alone = []
    for t in texts:
        for a, e, b, off in quality.K.slabs([t]):
            alone.append(set(quality.features(b, off)[1].tolist()))
    for a, e, b, off in quality.K.slabs(texts):
        row, feat = quality.features(b, off)
        assert [set(feat[row == i].tolist()) for i in range(4)] == alone


def test_language_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in held]) < 0.02


def test_language_of_odd_rows_and_nothing_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    got = langid.predict(odd_docs(spark, docs.schema).withColumn("lang_pred", F.lit(1)), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[10**6 + k].lang_pred == "und" for k in range(5)] == [True, True, True, False, False]
    assert all(by[10**6 + k].rejected and by[10**6 + k].score == 0 for k in range(3))
    none = langid.predict(docs, langid.train(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert all(r.rejected for r in none)
    assert langid.predict(docs.limit(0), model).count() == 0


def repeated(spark, schema):
    """One key on 60 rows of three languages, each of its own text, and 20 equal rows."""
    rows = [(7, f"{w} {i}", w, "s", 0) for w in ("aaa", "bbb", "zzz") for i in range(20)]
    return spark.createDataFrame(rows + [(8, "same", "aaa", "s", 0)] * 20, schema)


def test_repeated_keys_are_sampled_by_row(spark, monkeypatch):
    docs = repeated(spark, "doc_id long, text string, lang string, source string, n_chars int")
    seen = []
    monkeypatch.setattr(langid, "fit", seen.append)
    langid.train(docs, sample=20)
    langid.train(docs, sample=100)
    assert [len(x) for x in seen] == [20, 61]
    assert [{y for y, *_ in x} for x in seen] == [{"aaa", "bbb", "zzz"}] * 2
    seen.clear()
    monkeypatch.setattr(quality, "fit", seen.append)
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    quality.train(docs, labels, sample=20)
    quality.train(docs, labels, sample=100)
    assert [len(x) for x in seen] == [20, 61]


def test_quality_equals_ftrl_by_the_formula(spark):
    """The published update, one coordinate at a time, over a few texts; then the scores."""
    texts = [("a good plain sentence about rivers", 1), ("buy now !!! CLICK here 99", 0), ("good rivers run, and rivers bend", 1), ("CLICK CLICK now", 0), ("", 0)]
    feats = []
    for t, y in texts:
        for a, e, b, off in quality.K.slabs([t]):
            feats.append((y, quality.features(b, off)[1]))
    z, n = {}, {}

    def weight(i):
        v, l1 = z.get(i, 0.0), 0.0 if i == "bias" else quality.L1
        if abs(v) <= l1:
            return 0.0
        return -(v - (l1 if v > 0 else -l1)) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    def probability(f):
        x = {int(i): (len(f) + 1) ** -0.5 for i in f} | {"bias": 1.0}
        w = {i: weight(i) for i in x}
        return x, w, 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))

    rng = np.random.default_rng(1)
    for _ in range(quality.EPOCHS):
        for at in rng.permutation(len(feats)):
            y, f = feats[at]
            x, w, p = probability(f)
            for i in x:
                g, old = (p - y) * x[i], n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / quality.ALPHA * w[i]
    model = quality.fit(feats, seed=1)
    assert abs(model[1] - weight("bias")) < 1e-9
    known = [i for i in z if i != "bias"]
    assert np.allclose(model[0][known], [weight(i) for i in known], atol=1e-6)
    assert not np.delete(model[0], known).any() and any(weight(i) for i in known)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, (_, f) in enumerate(feats):
        assert abs(got[i] - probability(f)[2]) < 1e-5, i
