"""Quality classifier: factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import textvec
from trendspark.llm.common import held_out, table
from trendspark.llm.training import labelled_sample

WORD_BITS = 16
BINS = 16
RANK = 8
PER_CLASS = 4000
EPOCHS = 12

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>{}[]~^_=+\\@"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_STOP = np.isin(np.arange(256), list(b".?!,;:"))
_LETTER = ~textvec.NOT_ALNUM & ~_DIGIT
STRUCTURE = 10
N_FEATURES = (1 << WORD_BITS) + STRUCTURE * BINS


def features(texts: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, feature, value), sorted by doc: words weigh 1/sqrt(distinct words), each statistic's bin weighs 1.

    Every text has its statistics' bins, so every doc occurs, empty texts too. n_chars is the
    metadata column (negative where it is null).
    """
    w = textvec.Words(texts)
    n = len(texts)
    bucket = (w.hash & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    key = textvec.sorted_unique((w.doc.astype(np.int64) << WORD_BITS) | bucket)
    doc, word = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(doc, minlength=n)
    value = 1 / np.sqrt(distinct[doc])
    size = np.maximum(np.diff(w.offsets) - 1, 0)
    share = lambda t: np.add.reduceat(t[w.data], w.offsets[:-1], dtype=np.int64) / np.maximum(size, 1)
    lines = np.add.reduceat(w.data == 10, w.offsets[:-1], dtype=np.int64)
    types = distinct / np.sqrt(np.maximum(w.count, 1))
    word_size = np.bincount(w.doc, weights=w.end - w.start, minlength=n) / np.maximum(w.count, 1)
    part = lambda x: np.sqrt(x) * BINS
    stats = np.stack([
        2 * np.log1p(w.count), 2 * word_size - 4, part(share(_SYMBOL)), part(share(_UPPER)), part(share(_DIGIT)), part(share(_STOP)) * 1.5,
        part(1 - share(_LETTER)), part(np.minimum(1, lines / np.maximum(w.count, 1))) * 2, 1.5 * types, np.where(n_chars < 0, 0, 2 + 1.5 * np.log1p(np.maximum(n_chars, 0))),
    ])
    bins = np.clip(stats, 0, BINS - 1).astype(np.int64) + (np.arange(STRUCTURE) * BINS + (1 << WORD_BITS))[:, None]
    doc = np.concatenate([doc, np.tile(np.arange(n), STRUCTURE)])
    feature = np.concatenate([word, bins.ravel()])
    value = np.concatenate([value, np.ones(n * STRUCTURE)])
    order = np.argsort(doc, kind="stable")
    return doc[order], feature[order], value[order].astype(np.float32)


class FactorisationMachine:
    """logit = b + sum w_i x_i + (sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2) / 2, in time linear in the entries."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b = np.zeros(1, np.float32)
        self.w = np.zeros(N_FEATURES, np.float32)
        self.v = rng.normal(0, 0.05, (N_FEATURES, RANK)).astype(np.float32)

    def logits(self, doc, feature, value):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        vx = self.v[feature] * value[:, None]
        s = np.add.reduceat(vx, first)
        q = np.add.reduceat(vx * vx, first)
        return self.b[0] + np.add.reduceat(self.w[feature] * value, first) + 0.5 * (s * s - q).sum(1), s, vx

    def fit(self, doc, feature, value, y, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, seed: int = 7):
        """Adagrad over shuffled batches of documents; without both classes only the bias is set."""
        n = len(y)
        rate_of_1 = (y.sum() + 1) / (n + 2)
        self.b[0] = np.log(rate_of_1 / (1 - rate_of_1))
        if n == 0 or y.min() == y.max():
            return self
        at = np.searchsorted(doc, np.arange(n + 1))
        past_w, past_v, past_b = np.full(N_FEATURES, 1e-3, np.float32), np.full((N_FEATURES, RANK), 1e-3, np.float32), 1e-3
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                some = order[i : i + batch]
                length = at[some + 1] - at[some]
                idx = np.repeat(at[some] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
                d, f, x = np.repeat(np.arange(len(some)), length), feature[idx], value[idx]
                z, s, vx = self.logits(d, f, x)
                g = (1 / (1 + np.exp(-z)) - y[some]).astype(np.float32) / len(some)
                used, to = np.unique(f, return_inverse=True)
                gx = g[d] * x
                gw = np.bincount(to, weights=gx, minlength=len(used)).astype(np.float32) + decay * self.w[used] / n
                gv = np.stack([np.bincount(to, weights=gx * (s[d, k] - vx[:, k]), minlength=len(used)) for k in range(RANK)], 1).astype(np.float32)
                gv += decay * self.v[used]
                past_w[used] += gw * gw
                past_v[used] += gv * gv
                past_b += float(g.sum()) ** 2
                self.w[used] -= rate * gw / np.sqrt(past_w[used])
                self.v[used] -= rate * gv / np.sqrt(past_v[used])
                self.b -= rate * g.sum() / np.sqrt(past_b)
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> FactorisationMachine:
    """Fit on a sample of at most per_class documents of either label; features are made in the tasks."""
    sample = labelled_sample(docs.select("doc_id", F.struct("text", "n_chars").alias("text")), labels, label, per_class).select("doc_id", "text.text", "text.n_chars", "y")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = textvec.encoded(b["text"])
            for i, j in textvec.chunks(texts):
                d, f, x = features(texts[i:j], _metadata(b["n_chars"].iloc[i:j]))
                at = np.searchsorted(d, np.arange(1, j - i))
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "y": b["y"].iloc[i:j].array, "f": [a.astype(np.int32) for a in np.split(f, at)], "x": np.split(x, at)})

    rows = sample.mapInPandas(extract, "doc_id long, y int, f array<int>, x array<float>").toPandas().sort_values(["doc_id", "y"])
    size = [len(x) for x in rows["f"]]
    if not len(rows):
        return FactorisationMachine().fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
    return FactorisationMachine().fit(np.repeat(np.arange(len(rows)), size), np.concatenate(rows["f"].to_list()).astype(np.int64), np.concatenate(rows["x"].to_list()).astype(np.float32), rows["y"].to_numpy(float))


def _metadata(n_chars) -> np.ndarray:
    return pd.to_numeric(n_chars, errors="coerce").fillna(-1).to_numpy(float)


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row; null texts score as empty ones, repeated rows are scored each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = textvec.encoded(b["text"])
            for i, j in textvec.chunks(texts):
                z = model.logits(*features(texts[i:j], _metadata(b["n_chars"].iloc[i:j])))[0]
                p = 1 / (1 + np.exp(-np.clip(z.astype(float), -40, 40)))
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "score": p, "predicted": (p >= threshold).astype(np.int32)})

    return docs.select("doc_id", "text", "n_chars").mapInPandas(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
