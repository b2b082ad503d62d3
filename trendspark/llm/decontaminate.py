"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import textvec
from trendspark.llm.common import checkpoint, table

Q = 10
WINDOW, STRIDE = 80, 20  # longer items are searched by windows of so many characters: a copied part of WINDOW + STRIDE - 1 always holds one
ERRORS = 0.06
LEAST = 40  # shorter windows are searched for without errors
BLOCK = 64  # positions over which shared q-grams are first counted
BENCHMARK_CHARS = 500_000  # of the benchmark that one pass over the documents takes (an index of some 40 MB); more takes more passes
_MASK = (1 << 22) - 1
_FACTOR = np.uint64(0xBF58476D1CE4E5B9)


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-cased text with runs of space as one space, none at the ends."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of each q-gram, from the sums that its characters' hashes make with powers of a factor."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    done, size, part, width = None, 0, h, 1  # strings of the powers of two that Q has are joined
    while width <= Q:
        if Q & width:
            done = part[:n] if done is None else done * _FACTOR + part[size : size + n]
            size += width
        part = part[:-width] * _FACTOR + part[width:]
        width *= 2
    return textvec.mix(done)


class Index:
    """Windows of benchmark items with their q-grams, budgets and thresholds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.codes = [], []  # an item's windows are parts of one array
        for item, text in items:
            codes = normalise(text or "")
            last = len(codes) - WINDOW
            for s in [*range(0, last, STRIDE), last] if last > 0 else [0] if len(codes) >= Q else []:
                self.item.append(item)
                self.codes.append(codes[s : s + WINDOW])
        n = np.array([len(c) for c in self.codes], np.int64)
        self.errors = np.where(n >= LEAST, (n * ERRORS).astype(np.int64), 0)
        grams = n - Q + 1
        # lemma: a region within e errors shares all but q * e of the window's q-grams
        self.errors = np.minimum(self.errors, np.maximum(0, (grams - 1) // Q))
        self.least = grams - Q * self.errors
        span = grams + self.errors
        self.block_least = int((self.least // -(-span // BLOCK)).min(initial=BLOCK)) if len(n) else 1
        self.block_least = max(1, min(self.block_least, BLOCK))
        self.reach = int(span.max(initial=0)) + BLOCK
        each = [_grams(c) for c in self.codes]
        gram = np.concatenate(each) if each else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.window = np.repeat(np.arange(len(n), dtype=np.int32), grams)[order]
        self.pos = (np.concatenate([np.arange(k, dtype=np.int16) for k in grams]) if len(n) else np.zeros(0, np.int16))[order]
        self.seen = np.zeros(_MASK + 1, bool)
        self.seen[(self.gram & np.uint64(_MASK)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal of its band) wherever a band shares enough q-grams."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram = _grams(codes)
        if not len(gram) or not len(self.gram):
            return none
        hit = self.seen[(gram & np.uint64(_MASK)).astype(np.int64)]
        sums = np.concatenate([[0], np.cumsum(hit)])
        ends = np.minimum(np.arange(len(hit)) + BLOCK, len(hit))
        dense = sums[ends] - sums[:-1] >= self.block_least
        if not dense.any():
            return none
        at = np.flatnonzero(dense)
        change = np.zeros(len(hit) + 1, np.int64)
        np.add.at(change, np.maximum(at - self.reach, 0), 1)
        np.add.at(change, np.minimum(at + self.reach, len(hit)), -1)
        where = np.flatnonzero(hit & (np.cumsum(change)[:-1] > 0))
        low, high = np.searchsorted(self.gram, gram[where]), np.searchsorted(self.gram, gram[where], side="right")
        size = high - low
        k = np.repeat(low - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
        window = self.window[k].astype(np.int64)
        diagonal = np.repeat(where, size) - self.pos[k] + WINDOW
        width = self.errors[window] + 1
        band = diagonal // width
        # bands of two widths overlap by one, so that one of them has all the diagonals of a region
        window, band = np.concatenate([window, window]), np.concatenate([band, band - 1])
        pair, count = np.unique((window << 40) | (band + 1), return_counts=True)
        window, band = pair >> 40, (pair & ((1 << 40) - 1)) - 1
        enough = count >= self.least[window]
        window, band = window[enough], band[enough]
        return window, band * (self.errors[window] + 1) - WINDOW

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """item -> (number of windows that match, least distance) in a text."""
        codes = normalise(text)
        found: dict[int, int] = {}
        for w, d in zip(*self.candidates(codes)):
            e = int(self.errors[w])
            low = max(0, d - e)
            distance = banded_distance(self.codes[w], codes[low : max(low, d + 2 * (e + 1) + len(self.codes[w]) + e)], e)
            if distance <= e:
                found[w] = min(distance, found.get(w, distance))
        out: dict[int, tuple[int, int]] = {}
        for w, distance in found.items():
            n, least = out.get(self.item[w], (0, distance))
            out[self.item[w]] = n + 1, min(least, distance)
        return out


def banded_distance(window: np.ndarray, region: np.ndarray, errors: int) -> int:
    """Least edits between the window and any part of the region, over errors where it is more.

    The region is little wider than the window, so all its diagonals make the band.
    """
    if window.tobytes() in region.tobytes() and _aligned(window, region):
        return 0
    if not errors:
        return 1
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for c in window:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (region != c), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > errors:
            return errors + 1
    return int(row.min())


def _aligned(window: np.ndarray, region: np.ndarray) -> bool:
    data, part = region.tobytes(), window.tobytes()
    at = data.find(part)
    while at >= 0 and at % 4:
        at = data.find(part, at + 1)
    return at >= 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, item_id, n_windows, distance): the benchmark items that a document holds.

    A document holds an item if one of the item's windows (the whole item where it has up to
    WINDOW characters) is in it within ERRORS of the window's length as edits, after lower-casing
    and joining runs of space. Items of less than Q characters and null texts match nothing;
    repeated rows are reported each; null ids are reported as null.
    """
    sizes = benchmark.select("item_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-total // BENCHMARK_CHARS))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for k in range(passes):  # one index at a time, on the driver and in the tasks
        rows = sizes.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).select("item_id", "text").collect()
        index = Index([(r["item_id"], r["text"]) for r in rows if r["item_id"] is not None])
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = []
                for doc, text in zip(b["doc_id"], b["text"]):
                    if isinstance(text, str):
                        found += [(None if pd.isna(doc) else int(doc), item, *m) for item, m in shared.value.matches(text).items()]
                if not found:
                    continue
                frame = pd.DataFrame(found, columns=["doc_id", "item_id", "n_windows", "distance"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

        part = plain.mapInPandas(run, "doc_id long, item_id long, n_windows int, distance int")
        if passes > 1:
            part = checkpoint(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("doc_id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that hold no benchmark item; rows with a null id stay."""
    leaks = find_leaks(docs, benchmark, text_col, id_col).select(F.col(id_col).alias("__leak")).distinct()
    return docs.join(leaks, docs[id_col] == F.col("__leak"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
