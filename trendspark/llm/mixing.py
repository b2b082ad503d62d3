"""Mixing to target weights: domain posteriors of a classifier, then nonnegative document rates by projected gradient."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import quality_classifier, textvec
from trendspark.llm.common import checkpoint, held_out, table

#: Domains of the labelled table, and the share of tokens that each is to have.
TARGETS = {"good": 0.86, "poor": 0.05, "toxic": 0.09}
PER_DOMAIN = 2000
WORD_WEIGHT = 4.0  # of the words against the statistics
STAY = 1e-3  # weight of the distance of the rates from 1, which makes them unique
ITERATIONS = 60
KEEP_EVERY = 10  # iterations after which the state of the documents is written
TOLERANCE = 5e-4


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table: toxic, else good or poor by quality; rows without a label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null")


def _features(texts: list[bytes]):
    doc, feature, value = quality_classifier.features(texts, np.full(len(texts), -1.0))
    return doc, feature, np.where(feature < 1 << quality_classifier.WORD_BITS, WORD_WEIGHT * value, value).astype(np.float32)


class Softmax:
    """Multinomial logistic regression on the hashed words and statistics of the quality classifier."""

    def __init__(self, classes: int):
        self.w = np.zeros((quality_classifier.N_FEATURES, classes), np.float32)
        self.b = np.zeros(classes, np.float32)

    def posteriors(self, doc, feature, value) -> np.ndarray:
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        z = np.add.reduceat(self.w[feature] * value[:, None], first) + self.b
        p = np.exp((z - z.max(1, keepdims=True)).astype(float))
        return p / p.sum(1, keepdims=True)

    def fit(self, doc, feature, value, y, epochs: int = 20, batch: int = 256, rate: float = 0.3, seed: int = 11):
        n, k = len(y), len(self.b)
        self.b[:] = np.log((np.bincount(y, minlength=k) + 1) / (n + k))
        at = np.searchsorted(doc, np.arange(n + 1))
        past = np.full_like(self.w, 1e-3)
        rng = np.random.default_rng(seed)
        for _ in range(epochs if n else 0):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                some = order[i : i + batch]
                size = at[some + 1] - at[some]
                idx = np.repeat(at[some] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                d, f, x = np.repeat(np.arange(len(some)), size), feature[idx], value[idx]
                g = self.posteriors(d, f, x)
                g[np.arange(len(some)), y[some]] -= 1
                used, to = np.unique(f, return_inverse=True)
                gw = np.stack([np.bincount(to, weights=g[d, c] * x, minlength=len(used)) for c in range(k)], 1).astype(np.float32) / len(some)
                past[used] += gw * gw
                self.w[used] -= rate * gw / np.sqrt(past[used])
        return self


def fit_domains(docs: DataFrame, domains: DataFrame, names: list[str], per_domain: int = PER_DOMAIN) -> Softmax:
    """Fit on at most per_domain documents of each domain, those with the least hashed ids; held-out ids are left out."""
    known = domains.where(F.col("domain").isin(names) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    parts = [known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain).withColumn("y", F.lit(i)) for i, d in enumerate(names)]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = textvec.encoded(b["text"])
            for i, j in textvec.chunks(texts):
                d, f, x = _features(texts[i:j])
                at = np.searchsorted(d, np.arange(1, j - i))
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "y": b["y"].iloc[i:j].array, "f": [a.astype(np.int32) for a in np.split(f, at)], "x": np.split(x, at)})

    rows = sample.mapInPandas(extract, "doc_id long, y int, f array<int>, x array<float>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    if not len(rows):
        return Softmax(len(names))
    # flat arrays, not an object for each document
    f, x = (rows[c].combine_chunks() for c in "fx")
    size = np.diff(f.offsets.to_numpy())
    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
    return Softmax(len(names)).fit(np.repeat(np.arange(len(rows)), size), flat(f), flat(x), rows["y"].to_numpy().astype(int))


def domain_posteriors(docs: DataFrame, model: Softmax, names: list[str]) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>...) of every row; tokens are words, of which null texts have none."""
    cols = [f"p_{d}" for d in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = textvec.encoded(b["text"])
            for i, j in textvec.chunks(texts):
                p = model.posteriors(*_features(texts[i:j]))
                out = pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "n_tokens": textvec.Words(texts[i:j]).count})
                yield out.assign(**{c: p[:, k] for k, c in enumerate(cols)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_tokens long, " + ", ".join(f"{c} double" for c in cols))


def momentum(steps: int) -> float:
    """Nesterov's number after so many steps."""
    t = 1.0
    for _ in range(steps):
        t = (1 + np.sqrt(1 + 4 * t * t)) / 2
    return t


def rates_of(p: np.ndarray, residuals: np.ndarray, stay: float = STAY, rate: np.ndarray | None = None, ahead: np.ndarray | None = None, done: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rate, extrapolated rate) of documents with posteriors p after the steps with these residuals; rate, ahead: the state after the first `done` steps.

    A step goes against the gradient sum_k p_k e_k + stay * (r - 1), is cut off at 0 and
    extrapolated with Nesterov's factor. The step size is the reciprocal of a bound of the
    curvature, as the token-weighted squares of posteriors sum to 1 at most.
    """
    rate = np.ones(len(p)) if rate is None else rate
    ahead, t = rate if ahead is None else ahead, momentum(done)
    for e in residuals:
        new = np.maximum(0, ahead - (p @ e + stay * (ahead - 1)) / (1 + stay))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - rate)
        rate, t = new, t_new
    return rate, ahead


def fit_rates(posteriors: DataFrame, targets: dict[str, float], stay: float = STAY, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """Add rate >= 0 to posteriors: the expected tokens n_tokens * rate * p of each domain come to its target share.

    The target shares are taken of all tokens of the input. The least squares problem is solved
    by distributed projected gradient: an iteration sums the expected tokens of the domains over
    all documents (a few numbers a partition) and sends the residuals back; each document makes
    the steps since its state was last written. It ends when every share is met to the tolerance,
    or after `iterations` with a warning that gives the shares (targets of domains that no
    document has can't be met).
    """
    names = list(targets)
    cols = [f"p_{d}" for d in names]
    total = posteriors.agg(F.sum("n_tokens")).first()[0] or 0
    share = sum(targets.values())
    want = np.array([targets[d] / share for d in names])
    state = posteriors.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0)})
    fields = posteriors.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",rate:double"
    done, recent, met = 0, np.zeros((0, len(names))), not total

    def stepped(b: pd.DataFrame, residuals: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        return rates_of(b[cols].to_numpy(), residuals, stay, b["rate"].to_numpy(), b["ahead"].to_numpy(), first)

    def written(residuals: np.ndarray, first: int) -> DataFrame:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rate, ahead = stepped(b, residuals, first)
                yield b.assign(rate=rate, ahead=ahead)

        return state.mapInPandas(add, fields + ",ahead:double")

    while not met:
        def part(batches: Iterator[pd.DataFrame], residuals=recent, first=done) -> Iterator[pd.DataFrame]:
            sums = np.zeros((2, len(cols)))
            for b in batches:
                for k, r in enumerate(stepped(b, residuals, first)):
                    sums[k] += (b["n_tokens"].to_numpy(float) * r) @ b[cols].to_numpy()
            yield pd.DataFrame([sums.ravel()], columns=[f"s{k}" for k in range(sums.size)])

        row = state.select("n_tokens", *cols, "rate", "ahead").mapInPandas(part, ", ".join(f"s{k} double" for k in range(2 * len(cols)))).agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(2 * len(cols))]).first()
        now, ahead = np.array(row, float).reshape(2, -1) / total
        met = np.abs(now - want).max() < tolerance and done + len(recent) > 0
        if not met and done + len(recent) >= iterations:
            warnings.warn(f"shares {dict(zip(names, now.round(4).tolist()))} instead of {dict(zip(names, want.round(4).tolist()))} after {iterations} iterations", stacklevel=2)
            break
        if not met:
            recent = np.vstack([recent, ahead - want])
        if len(recent) == KEEP_EVERY and not met:
            state = checkpoint(written(recent, done))
            done, recent = done + KEEP_EVERY, recent[:0]
    return written(recent, done).drop("ahead")


def mixing_rates(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, stay: float = STAY) -> DataFrame:
    """(doc_id, n_tokens, posteriors, rate) of every row of docs.

    A larger stay holds the rates nearer to 1 and meets the targets less closely.

    Texts that are null or have no words have posteriors (of the empty text) and a rate, but
    weigh nothing. Equal texts get equal rates. Without any label in the known domains all
    posteriors are even; an empty table stays empty.
    """
    targets = targets or TARGETS
    names = list(targets)
    posteriors = checkpoint(domain_posteriors(docs, fit_domains(docs, domains, names), names))
    return fit_rates(posteriors, targets, stay)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")))
