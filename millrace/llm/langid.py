"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of 2, 3 and 4 bytes that lie in a word with its borders; each has an
embedding, found by its hash. A document is the mean of its subwords' embeddings, and a
linear layer with softmax tells its language. Both are trained by stochastic gradient
descent in numpy, on a bounded sample. Once trained, embedding and layer are one table of
subword by language, so that scoring is a sum of its rows.

Scores are calibrated on a part of the sample kept out of training: a temperature makes
them probabilities, and the rejection threshold is the score that all but `REJECT` of the
rightly predicted documents there reach."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as K
from .sparkit import bound_batches

#: Documents to learn from, at most: those whose keys and texts have the least hashes.
SAMPLE = 4000
BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
EPOCHS, RATE, REJECT = 4, 0.5, 0.001
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LETTER[_LETTER == 0] = 32


def subwords(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords and the rows they belong to. Other bytes than letters (ASCII,
    or any of a longer character) are borders, as are the ends of a text."""
    n = len(off) - 1
    size = np.diff(off)
    x = np.full(len(b) + 2 * n, 32, np.uint8)
    row = np.repeat(np.arange(n), size)
    x[np.arange(len(b)) + 2 * row + 1] = _LETTER[b]
    rows = np.repeat(np.arange(n), size + 2)
    gap = x == 32
    s = K.prefix_sums(x)
    inner = np.append(0, np.cumsum(gap))
    out, own = [], []
    for k in SIZES:
        if len(x) < k:
            continue
        g = K.gram_hashes(s, k)
        m = len(g)
        # no border strictly inside, and not only borders
        ok = (inner[k - 1 : k - 1 + m] - inner[1 : 1 + m] == 0) & ~(gap[:m] & gap[k - 1 : k - 1 + m] & (k == 2))
        ok &= rows[:m] == rows[k - 1 : k - 1 + m]
        at = np.flatnonzero(ok)
        out.append((g[at] % K.U(BUCKETS)).astype(np.int32))
        own.append(rows[at])
    return np.concatenate(out) if out else np.empty(0, np.int32), np.concatenate(own) if own else np.empty(0, np.int64)


def _has_letters(t: str | None) -> bool:
    return t is not None and any(map(str.isalpha, t))


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        idx, cnt = [], []
        for a, e, b, off in K.slabs(f["_text"]):
            bucket, row = subwords(b, off)
            order = np.argsort(row, kind="stable")
            bucket, at = bucket[order], np.searchsorted(row[order], np.arange(e - a + 1))
            for i in range(e - a):
                u, c = np.unique(bucket[at[i] : at[i + 1]], return_counts=True)
                idx.append(u.astype(np.uint16).tobytes())
                cnt.append(c.astype(np.uint32).tobytes())
        yield pd.DataFrame({"label": f["label"], "idx": idx, "cnt": cnt})


class Model:
    """What has been learned: language names, the table of log weights, and calibration."""

    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.names, self.table, self.bias, self.temperature, self.threshold = names, table, bias, temperature, threshold

    def logits(self, bucket: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        count = np.maximum(np.bincount(row, minlength=n), 1)
        w = self.table[bucket]
        total = np.stack([np.bincount(row, weights=w[:, c], minlength=n) for c in range(len(self.names))], axis=1)
        return total / count[:, None] + self.bias

    def score(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    """examples: (language, buckets, counts). One language alone is always predicted; no
    example at all leaves a model that rejects every text."""
    names = sorted({x[0] for x in examples})
    if not names:
        return Model(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 2.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    held = order[: len(order) // 5]
    train = order[len(order) // 5 :]
    emb = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)) / DIM
    out, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    steps, done = EPOCHS * len(train), 0
    target = np.eye(len(names))
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            lang, idx, cnt = examples[i]
            if not len(idx):
                continue
            rate = RATE * (1 - done / steps)
            done += 1
            w = cnt / cnt.sum()
            mean = w @ emb[idx]
            err = _softmax(mean @ out + bias) - target[names.index(lang)]
            pull = out @ err
            out -= rate * np.outer(mean, err)
            bias -= 0.01 * rate * err
            # a document's step is spread over its subwords by how often they occur
            emb[idx] -= rate * np.outer(w * min(len(idx), 200), pull)
    table = (emb @ out).astype(np.float32)
    model = Model(names, table, bias, 1.0, 0.0)
    z, y = [], []
    for i in held:
        lang, idx, cnt = examples[i]
        if len(idx):
            z.append((cnt / cnt.sum()) @ table[idx] + bias)
            y.append(names.index(lang))
    if z:
        z, y = np.array(z), np.array(y)
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = model.score(z)
        right = p[p.argmax(axis=1) == y].max(axis=1) if (p.argmax(axis=1) == y).any() else np.array([0.0])
        model.threshold = float(min(np.quantile(right, REJECT), 0.5))
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` rows of docs that have a language and a text: those with
    the least hashes of key and text. Of equal rows one counts."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("label")).filter("label is not null and _text is not null")
    rows = rows.withColumn("_h", F.xxhash64(F.col("_id").cast("string"), "_text"))
    chosen = rows.select("_h", "label").distinct().orderBy("_h", "label").limit(sample)
    # the sample's hashes are bounded by its size, and so are its rows: of equal ones one
    rows = rows.join(F.broadcast(chosen), ["_h", "label"], "left_semi").dropDuplicates(["_h", "label"])
    got = rows.mapInPandas(_featured, "label string, idx binary, cnt binary").toPandas()
    examples = sorted((r.label, bytes(r.idx), bytes(r.cnt)) for r in got.itertuples(index=False))
    return fit([(a, np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32).astype(float)) for a, b, c in examples])


def _predicted(shared) -> Callable:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        for f in frames:
            lang, score, reject = [], [], []
            texts = f["_text"].tolist()
            for a, e, b, off in K.slabs(texts):
                bucket, row = subwords(b, off)
                p = model.score(model.logits(bucket, row, e - a))
                best = p.argmax(axis=1)
                for i in range(e - a):
                    ok = _has_letters(texts[a + i])
                    lang.append(model.names[best[i]] if ok else "und")
                    score.append(float(p[i, best[i]]) if ok else 0.0)
                    reject.append(not ok or p[i, best[i]] < model.threshold)
            yield pd.DataFrame({**{c: f[c] for c in f.columns if c != "_text"}, "lang_pred": lang, "score": score, "rejected": reject})

    return rows


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, lang_pred, score, rejected.

    A null text or one without a letter is 'und' with score 0 and rejected; any other has a
    language that was learned, and is rejected if its score is below the model's threshold.
    Repeated rows are judged alike. An empty table gives an empty result. Columns not named
    are ignored. The model is broadcast; its size is fixed.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    got = d.mapInPandas(_predicted(shared), "_key string, lang_pred string, score double, rejected boolean")
    return got.select(F.col("_key").cast(kind).alias(key), "lang_pred", "score", "rejected")


def confident(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject. Null texts and
    those without a letter are rejected; repeated rows are judged alike; an empty table stays
    empty; extra columns are carried along, whatever their names."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(t: pd.Series) -> pd.Series:
        rows = _predicted(shared)(iter([pd.DataFrame({"_text": t})]))
        return pd.concat(rows)["rejected"].reset_index(drop=True)

    return docs.filter(~rejected(F.col(text)))
