"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader updates, scored as sparse dot products.

Two streams of tokens make the n-grams of one and two words: the words themselves, in lower
case, and their shapes (runs of letters of one case, digits and each other sign drawn
together, with a word that repeats the one before it as a shape of its own). A feature is
present or absent. Learning takes one pass after another over a bounded sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as K
from .sparkit import bound_batches

#: Labelled rows to learn from, at most: those whose keys have the least hashes.
SAMPLE = 4000
BITS = 18
EPOCHS, ALPHA, BETA, L1, L2 = 6, 3.0, 1.0, 0.3, 0.0
U = np.uint64
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[9:14] = 32
_SHAPE[128:] = 0  # bytes of longer characters say nothing of shape
_ECHO = U(0x5EED)


def features(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all documents, as sorted (row, feature)."""
    starts, ends, at = K.words(b, off)
    n = len(starts)
    count = np.diff(at)
    row = np.repeat(np.arange(len(count)), count)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = K.range_hashes(K.prefix_sums(K.lowered(b)), starts, ends)
    # shapes: of each word, the bytes that differ from the one before it in the word
    c = _SHAPE[b]
    use = c != 0
    inside = np.zeros(len(b), bool)
    inside[starts] = True
    kept = np.flatnonzero(use)
    k = c[kept]
    fresh = np.append(True, k[1:] != k[:-1]) | inside[kept]
    kept = kept[fresh]
    s = K.prefix_sums(c[kept])
    shape = K.range_hashes(s, np.searchsorted(kept, starts), np.searchsorted(kept, ends))
    same = np.append(False, (word[1:] == word[:-1]) & (row[1:] == row[:-1]))
    shape[same] = _ECHO
    pair = np.append(row[1:] == row[:-1], False)
    two = lambda h, salt: K.mix(h[:-1] * U(3) + h[1:] + U(salt))[pair[:-1]]
    every = np.concatenate([K.mix(word + U(1)), two(word, 2), K.mix(shape + U(3)), two(shape, 4)])
    rows = np.concatenate([row, row[:-1][pair[:-1]], row, row[:-1][pair[:-1]]])
    code = np.unique((rows << BITS) | (every >> U(64 - BITS)).astype(np.int64))
    return code >> BITS, code & ((1 << BITS) - 1)


def fit(examples: list[tuple[int, np.ndarray]], seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias. Each example is (label, its distinct features)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        v = z[i]
        l1 = np.where(i == 1 << BITS, 0.0, L1)
        return np.where(np.abs(v) <= l1, 0.0, (np.sign(v) * l1 - v) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for e in rng.permutation(len(examples)):
            y, f = examples[e]
            i = np.append(f, 1 << BITS)
            x = np.full(len(i), 1 / np.sqrt(len(i)))
            x[-1] = 1.0
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for a, e, b, off in K.slabs(f["_text"]):
            row, feat = features(b, off)
            at = np.searchsorted(row, np.arange(e - a + 1))
            out += [feat[at[i] : at[i + 1]].astype(np.uint32).tobytes() for i in range(e - a)]
        yield pd.DataFrame({"label": f["label"], "feat": out})


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from at most `sample` rows of labels (key, label 0 or 1; null ones are left out)."""
    bound_batches(docs.sparkSession)
    chosen = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label")).filter("label is not null and _id is not null")
    chosen = chosen.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample)
    # the sample is bounded by its size
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    # a key can have many rows: of equal ones one counts, and of the others `sample` at most
    rows = rows.withColumn("_h", F.xxhash64(F.col("_id").cast("string"), "_text"))
    least = rows.select("_h", "label").distinct().orderBy("_h", "label").limit(sample)
    rows = rows.join(F.broadcast(least), ["_h", "label"], "left_semi").dropDuplicates(["_h", "label"])
    got = rows.select("label", "_text").mapInPandas(_featured, "label int, feat binary").toPandas()
    examples = sorted((int(r.label), bytes(r.feat)) for r in got.itertuples(index=False))
    return fit([(y, np.frombuffer(f, np.uint32).astype(np.int64)) for y, f in examples])


def _scored(shared) -> Callable:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, bias = shared.value
        for f in frames:
            score = []
            for a, e, b, off in K.slabs(f["_text"]):
                row, feat = features(b, off)
                dot = np.bincount(row, weights=w[feat], minlength=e - a)
                z = dot / np.sqrt(np.bincount(row, minlength=e - a) + 1) + bias
                score += (1 / (1 + np.exp(-np.clip(z, -35, 35)))).tolist()
            yield pd.DataFrame({"_key": f["_key"], "score": score})

    return rows


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """For each row: key, score (of label 1), predicted (1 if score >= cut, else 0).

    A null or empty text scores by the bias alone. Repeated rows score alike. An empty table
    gives an empty result. Columns not named are ignored. The weights are broadcast; their
    size is fixed.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    got = d.mapInPandas(_scored(shared), "_key string, score double")
    return got.select(F.col("_key").cast(kind).alias(key), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
