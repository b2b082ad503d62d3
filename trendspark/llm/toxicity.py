"""Toxicity: bidirectional gated recurrent network with attention pooling over character and word inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import textvec
from trendspark.llm.common import held_out, table
from trendspark.llm.training import labelled_sample

WINDOW = 64
STRIDE = 48
HIDDEN = 8
WORD_BITS, WORD_DIM = 15, 8
CHAR_BITS, CHAR_DIM = 14, 6
PER_CLASS = 1500
EPOCHS = 6
LEAST_STEPS = 100
#: Pseudo-documents in each word's log-odds; step sizes of the tables, which would else learn rare words by heart.
PRIOR = 4.0
TABLE_RATE = {"word": 0.1, "char": 0.2}


def _ranges(start, size):
    """start[i], start[i] + 1, ... for size[i] numbers, of all i."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Inputs:
    """Distinct words of texts with word bucket and hashed character grams (3 and 5, with the word's ends), and the windows.

    windows: word index (into the distinct words, the last one past them is padding) by window
    and step; owner: the text of each window. A text without words has one empty window.
    """

    def __init__(self, texts: list[bytes]):
        w = textvec.Words(texts, gaps=textvec.NOT_ALNUM, lower=True)
        distinct, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        self.bucket = (distinct & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
        start, end = w.start[first], w.end[first]
        size = end - start
        self.word_of = np.repeat(np.arange(len(distinct)), size)
        pos = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]] if len(size) else start, size) + np.arange(size.sum())
        inside = lambda p: np.where((p >= np.repeat(start, size)) & (p < np.repeat(end, size)), w.data[np.clip(p, 0, len(w.data) - 1)], 0).astype(np.int64)
        around = [inside(pos + k) + 1 for k in (-1, 0, 1, 2, 3)]
        codes = [sum(c * 257**k for k, c in enumerate(around[:n])) for n in (3, 5)]
        self.char = np.stack([((c * 0x9E3779B1 + n) >> 13) & ((1 << CHAR_BITS) - 1) for n, c in enumerate(codes)])
        self.first = np.r_[0, np.cumsum(size)[:-1]] if len(size) else np.zeros(0, int)
        self.size = np.maximum(size, 1)
        count = np.maximum(1, -(-(np.maximum(w.count, 1) - WINDOW) // STRIDE) + 1)
        self.owner = np.repeat(np.arange(len(texts)), count)
        begin = np.concatenate([[0], np.cumsum(w.count)])
        nth = np.arange(len(self.owner)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        at = (begin[self.owner] + nth * STRIDE)[:, None] + np.arange(WINDOW)
        ok = at < begin[self.owner + 1][:, None]
        which = np.append(which, 0)
        self.windows = np.where(ok, which[np.minimum(at, len(which) - 1)], len(distinct)).astype(np.int32)

    def only(self, windows: np.ndarray) -> "Inputs":
        """The same inputs with these windows, and no other words than theirs."""
        out = object.__new__(Inputs)
        used = np.unique(windows)
        used = used[used < len(self.bucket)]
        to = np.full(len(self.bucket) + 1, len(used), np.int32)
        to[used] = np.arange(len(used))
        size = self.size[used]
        out.bucket, out.size, out.windows = self.bucket[used], size, to[windows]
        out.word_of = np.repeat(np.arange(len(used)), size)
        out.char = self.char[:, _ranges(self.first[used], size)]
        out.first = np.r_[0, np.cumsum(size)[:-1]] if len(size) else np.zeros(0, int)
        return out


class BiGru:
    """The parameters; both directions have update, reset and candidate gates side by side."""

    def __init__(self, seed: int = 5):
        self.odds = np.zeros(1 << CHAR_BITS, np.float32)  # log-odds of character grams, an input
        r = np.random.default_rng(seed)
        f = lambda *s, by=0.3: r.normal(0, by, s).astype(np.float32)
        self.p = {
            "word": f(1 << WORD_BITS, WORD_DIM, by=0.1), "char": f(1 << CHAR_BITS, CHAR_DIM, by=0.1),
            "wx": f(WORD_DIM + CHAR_DIM + 1, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32),
            "uf": f(HIDDEN, 3 * HIDDEN), "ub": f(HIDDEN, 3 * HIDDEN),
            "att": f(2 * HIDDEN), "out": f(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }

    def gates(self, x: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """Input part of the gates for each distinct word (and a zero row for padding), and the word vectors."""
        both = self.p["char"][x.char].sum(0)
        chars = np.stack([np.bincount(x.word_of, weights=both[:, k], minlength=len(x.bucket)) for k in range(CHAR_DIM)], 1) / x.size[:, None]
        odds = self.odds[x.char].max(0)
        odds = np.maximum.reduceat(odds, x.first) if len(odds) else odds
        vec = np.concatenate([self.p["word"][x.bucket], chars.astype(np.float32), odds[:, None]], 1)
        g = vec @ self.p["wx"] + self.p["bx"]
        return np.concatenate([g, np.zeros((1, 6 * HIDDEN), np.float32)]), vec

    def forward(self, g: np.ndarray, windows: np.ndarray, keep: bool = False):
        n, pad, h3 = len(windows), len(g) - 1, 3 * HIDDEN
        hs = np.zeros((2, WINDOW, n, HIDDEN), np.float32)
        saved = {}
        for d, name in enumerate(("uf", "ub")):
            u, gd = self.p[name], np.ascontiguousarray(g[:, d * h3 : (d + 1) * h3])
            u_zr, u_c = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                col = windows[:, t]
                x = gd[col]
                zr = x[:, : 2 * HIDDEN] + h @ u_zr
                np.negative(zr, out=zr)
                np.exp(np.minimum(zr, 30, out=zr), out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ u_c)
                new = h + z * (c - h)
                new[col == pad] = 0  # padding is at the end: the state begins there when read backwards
                if keep:
                    saved[d, t] = h, z, r, c
                hs[d, t] = h = new
        both = np.concatenate([hs[0], hs[1]], 2)
        e = both @ self.p["att"]
        e[(windows == pad).T] = -1e9
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        context = np.einsum("tn,tnh->nh", a, both)
        return context @ self.p["out"] + self.p["bias"][0], (both, a, context, saved)

    def backward(self, x: Inputs, windows, vec, cache, dlogit) -> dict[str, np.ndarray]:
        both, a, context, saved = cache
        pad, h3 = len(vec), 3 * HIDDEN
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["bias"][0] = context.T @ dlogit, dlogit.sum()
        dcontext = dlogit[:, None] * self.p["out"]
        da = np.einsum("nh,tnh->tn", dcontext, both)
        de = a * (da - (a * da).sum(0))
        grad["att"] = np.einsum("tn,tnh->h", de, both)
        dboth = a[:, :, None] * dcontext + de[:, :, None] * self.p["att"]
        dg = np.zeros((pad + 1, 6 * HIDDEN), np.float32)
        for d, name in enumerate(("uf", "ub")):
            u = self.p[name]
            carry = np.zeros((len(windows), HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1) if d == 0 else range(WINDOW):
                h, z, r, c = saved[d, t]
                col = windows[:, t]
                dh = dboth[t, :, d * HIDDEN : (d + 1) * HIDDEN] + carry
                dh[col == pad] = 0
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                grad[name][:, : 2 * HIDDEN] += h.T @ np.concatenate([dz, dr], 1)
                grad[name][:, 2 * HIDDEN :] += (r * h).T @ dc
                carry = dh * (1 - z) + drh * r + dz @ u[:, :HIDDEN].T + dr @ u[:, HIDDEN : 2 * HIDDEN].T
                np.add.at(dg[:, d * h3 : (d + 1) * h3], col, np.concatenate([dz, dr, dc], 1))
        dg = dg[:pad]
        grad["wx"], grad["bx"] = vec.T @ dg, dg.sum(0)
        dvec = dg @ self.p["wx"].T
        np.add.at(grad["word"], x.bucket, dvec[:, :WORD_DIM])
        dchar = (dvec[:, WORD_DIM : WORD_DIM + CHAR_DIM] / x.size[:, None])[x.word_of]
        for some in x.char:
            np.add.at(grad["char"], some, dchar)
        return grad

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 5):
        """Adam on the highest window of each document; one word dimension starts as smoothed log-odds of the labels."""
        n = len(y)
        share = (y.sum() + 1) / (n + 2)
        if n == 0 or y.min() == y.max():
            self.p["out"][:] = 0
            self.p["bias"][0] = np.log(share / (1 - share))
            return self
        words, grams = (np.repeat(PRIOR * np.array([[1 - share], [share]]), 1 << bits, 1) for bits in (WORD_BITS, CHAR_BITS))
        for i, j in textvec.chunks(texts):
            x = Inputs(texts[i:j])
            row, step = np.nonzero(x.windows < len(x.bucket))
            pair = np.unique((x.owner[row].astype(np.int64) << 32) | x.windows[row, step])
            doc, word = pair >> 32, pair & 0xFFFFFFFF
            for hits, of, owner in (
                (words, x.bucket[word], doc),
                *((grams, some[_ranges(x.first[word], x.size[word])], np.repeat(doc, x.size[word])) for some in x.char),
            ):
                key = np.unique((owner << 20) | of)
                np.add.at(hits, (y[i:j].astype(int)[key >> 20], key & ((1 << 20) - 1)), 1)
        odds = lambda hits: np.clip(np.log(hits[1] / (n * share)) - np.log(hits[0] / (n * (1 - share))), -3, 3)
        self.p["word"][:, 0] = odds(words)
        self.odds = odds(grams).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, step = np.random.default_rng(seed), 0
        top = np.zeros(n, int)  # the window that stands for a document, chosen anew every third epoch
        for epoch in range(max(epochs, -(-LEAST_STEPS * batch // n))):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                some = order[i : i + batch]
                x = Inputs([texts[k] for k in some])
                begin = np.flatnonzero(np.r_[True, np.diff(x.owner) > 0])
                if epoch % 3 == 0:
                    z, _ = self.forward(self.gates(x)[0], x.windows)
                    top[some] = np.lexsort((z, x.owner))[np.r_[begin[1:], len(x.owner)] - 1] - begin
                x = x.only(x.windows[begin + top[some]])
                g, vec = self.gates(x)
                z, cache = self.forward(g, x.windows, keep=True)
                grad = self.backward(x, x.windows, vec, cache, ((_sigmoid(z) - y[some]) / len(some)).astype(np.float32))
                step += 1
                for k in self.p:
                    m[k] += 0.1 * (grad[k] - m[k])
                    s[k] += 0.01 * (grad[k] ** 2 - s[k])
                    self.p[k] -= rate * TABLE_RATE.get(k, 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, the highest score of its windows."""
        x = Inputs(texts)
        g, _ = self.gates(x)
        z = np.concatenate([self.forward(g, x.windows[i : i + 4096])[0] for i in range(0, len(x.windows), 4096)])
        return _sigmoid(np.maximum.reduceat(z, np.flatnonzero(np.r_[True, np.diff(x.owner) > 0])).astype(float))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> BiGru:
    """Fit on the whole texts of at most per_class documents of either label."""
    rows = labelled_sample(docs, labels, label, per_class).toPandas().sort_values(["doc_id", "y"])
    return BiGru().fit(textvec.encoded(rows["text"]), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: BiGru, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and wordless texts have one empty window, repeated rows are scored each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = textvec.encoded(b["text"])
            for i, j in textvec.chunks(texts):
                p = model.scores(texts[i:j])
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "score": p, "predicted": (p >= threshold).astype(np.int32)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
