"""Substring dedup: threshold-bounded interval expansion on Burrows-Wheeler transforms of anchor contexts.

Every string of `size` bytes holds GRAM-byte grams; the least hashed of them is its anchor, and
equal strings have equal anchors at equal places. So it is enough to compare the contexts of
equal anchors: `size` - GRAM bytes to the left and right, with the anchor as one symbol between.
All substrings of reach + 1 symbols of such a context stand for one string of `size` bytes.

Texts lie in batches by hashed id and stay there: anchors (as sorted blocks of hash remainders),
flags, distinct contexts and verdicts travel, each grouped by the anchor's hash. A passage in
very many documents sends one context a batch. Anchors at a passage's ends have as many contexts
as there are documents: where an anchor has more than HOT, its contexts are not compared in one
place, but each of their windows goes by its own hash.
"""

from __future__ import annotations

import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import textvec
from trendspark.llm.common import checkpoint, table

GRAM = 32
BATCH_BYTES = 2_000_000
LEAST_BATCH_BYTES = 250_000
PART_ANCHORS = 1_000_000
SLICE = 30_000
HOT = 30_000  # contexts of an anchor over which its windows are dealt out singly
REPLY = "batch long, kind int, part int, doc long, blob binary"
_MAX = np.iinfo(np.int64).max


# ---------------------------------------------------------------- the bounded interval expansion


def bounded_order(text: np.ndarray, bound: int) -> np.ndarray:
    """Suffix positions sorted by their first `bound` symbols, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < bound:
        step = min(known, bound - known)
        after = np.zeros(len(text), np.int64)
        after[: len(text) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(text) + 2) + after, return_inverse=True)[1].astype(np.int64)
        known += step
    return np.argsort(rank, kind="stable")


def common_prefixes(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """Common prefix length of each suffix in order with the one before it; -1 where it is `bound` or more.

    Breadth-first: the interval of a string w of length n is extended backward by each symbol c
    that the transform holds in it; the interval of cw ends at a boundary whose common prefix
    is n, unless a shorter string has set it. The queue of a length is expanded at once, and
    lengths stop below the bound.
    """
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)
    symbol = bwt[by_symbol]
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = lcp[n] = 0
    low, high = np.array([0]), np.array([n])
    owner = np.zeros(n + 1, np.int64)
    for length in range(bound):
        size = high - low
        member = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        which = np.repeat(np.arange(1, len(low) + 1), size)
        target = to[member]
        owner[target] = which
        if len(target) * 12 < n:
            at = np.sort(target)
        else:
            at = np.flatnonzero(owner[:n])
        own, sym = owner[at], symbol[at]
        last = np.ones(len(at), bool)
        last[:-1] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (sym[1:] != sym[:-1])
        ends = np.flatnonzero(last)
        starts = np.concatenate([[0], ends[:-1] + 1])
        owner[target] = 0
        new_low, new_high = at[starts], at[ends] + 1
        fresh = lcp[new_high] == -1
        low, high = new_low[fresh], new_high[fresh]
        lcp[high] = length
        if not len(low):
            break
    return lcp[:n]


def first_documents(left: np.ndarray, right: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For distinct contexts, the least document that holds each window, by context and window start.

    left and right: bytes by row, 256 beyond a text's ends; anchor: a number for each gram.
    Windows beyond the ends of a text count for none.
    """
    n, reach = left.shape
    width = 2 * reach + 2
    text = np.empty((n, width), np.int64)
    text[:, :reach], text[:, reach + 1 : -1] = left, right
    text[:, reach] = 257 + anchor
    text[:, -1] = 257 + anchor.max() + 1 + np.arange(n)
    order = bounded_order(text.ravel(), reach + 1)
    group = np.cumsum(common_prefixes(text.ravel(), order, reach + 1) != -1) - 1
    row, start = order // width, order % width
    inside = (start <= reach) & _valid(left, right)[row, np.minimum(start, reach)]
    least = np.full(group[-1] + 1, _MAX)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0]))
    least[:] = np.minimum.reduceat(np.where(inside, doc[row], _MAX), heads)
    out = np.full((n, reach + 1), _MAX)
    out[row[inside], start[inside]] = least[group[inside]]
    return out


def _valid(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Window starts of each context that lie in its text."""
    reach = left.shape[1]
    a, b = (left < 256).sum(1)[:, None], (right < 256).sum(1)[:, None]
    s = np.arange(reach + 1)
    return (s >= reach - a) & (s <= b)


# ---------------------------------------------------------------- batches


class Batch:
    """Texts of a batch with the anchors of all strings of `size` bytes; rows in `skip` (and without id) have none."""

    def __init__(self, frame: pd.DataFrame, skip: np.ndarray, size: int):
        self.reach = size - GRAM
        self.null = frame["doc_id"].isna().to_numpy()
        self.doc_id = frame["doc_id"].fillna(0).to_numpy(np.int64)
        self.copy = ~self.null & np.isin(self.doc_id, skip)
        self.texts = textvec.encoded(frame["data"])
        used = np.array([len(t) for t in self.texts]) * ~(self.null | self.copy)
        part = [t if u else b"" for t, u in zip(self.texts, used)]
        self.data = np.frombuffer(b"\n".join([*part, b"\n" * size]), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(used + 1)])[:-1]
        self.end = self.begin + used
        c = textvec.prefix_hash(self.data)
        n = len(self.data) - size + 1
        i = np.arange(n + self.reach)
        gram = textvec.span_hash(c, i, i + GRAM)
        w, least = 1, gram
        while 2 * w <= self.reach + 1:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        rest = self.reach + 1 - w
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        starts = np.arange(n)
        owner = np.searchsorted(self.begin, starts, side="right") - 1
        least = np.where(starts + size <= self.end[owner], least[:n], 0)  # windows that leave their text have none
        padded = np.concatenate([np.zeros(self.reach, np.uint64), least, np.zeros(self.reach, np.uint64)])
        w, most = 1, padded
        while 2 * w <= self.reach + 1:
            most = np.maximum(most[:-w], most[w:])
            w *= 2
        most = np.maximum(most[: len(most) - rest], most[rest:]) if rest else most
        self.at = np.flatnonzero((most[: len(gram)] == gram) & (gram > 0))
        self.gram = gram[self.at]
        self.owner = np.searchsorted(self.begin, self.at, side="right") - 1
        self.doc = self.doc_id[self.owner]
        self.hashes = c

    def only(self, keep: np.ndarray) -> "Batch":
        self.at, self.gram, self.owner, self.doc = self.at[keep], self.gram[keep], self.owner[keep], self.doc[keep]
        return self

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of context that the text has to the left and right of each anchor."""
        return np.minimum(self.reach, self.at - self.begin[self.owner]), np.minimum(self.reach, self.end[self.owner] - self.at - GRAM)

    def keys(self) -> np.ndarray:
        """Hash of anchor and context."""
        a, b = self.lengths()
        left = textvec.span_hash(self.hashes, self.at - a, self.at)
        right = textvec.span_hash(self.hashes, self.at + GRAM, self.at + GRAM + b)
        ends = (a * 256 + b).astype(np.uint64)
        return textvec.mix(textvec.mix(self.gram + left * np.uint64(0x9E3779B97F4A7C15)) + right * np.uint64(0xD6E8FEB86659FD93) + ends)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.lengths()
        step = np.arange(self.reach)
        left = np.where(step >= (self.reach - a)[:, None], self.data[np.maximum(self.at[:, None] - self.reach + step, 0)], 0)
        right = np.where(step < b[:, None], self.data[self.at[:, None] + GRAM + step], 0)
        return left.astype(np.uint8), right.astype(np.uint8)


def _part(gram: np.ndarray, parts: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray):
    """(part, rows) of each part."""
    order = np.argsort(part, kind="stable")
    for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(i):
            yield int(part[i[0]]), i


def _skip(replies: pd.DataFrame) -> np.ndarray:
    return replies.loc[replies["kind"] == 0, "doc"].to_numpy(np.int64)


def _anchor_blocks(batch: Batch, parts: int):
    """(part, sorted remainders, whether two documents of the batch have it, times) of the distinct anchors."""
    key = (_part(batch.gram, parts) << 32) | (batch.gram & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((batch.doc, key))
    key, doc = key[order], batch.doc[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    more = np.zeros(len(key), bool)
    more[1:] = ~head[1:] & (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    several = np.logical_or.reduceat(more, at) if len(at) else more
    times = np.minimum(np.diff(np.append(at, len(key))), 65_535).astype(np.uint16)
    key = key[at]
    part = key >> 32
    cut = np.flatnonzero(np.diff(part)) + 1
    for k, s, t in zip(np.split(key, cut), np.split(several, cut), np.split(times, cut)):
        if len(k):
            yield int(k[0] >> 32), (k & 0xFFFFFFFF).astype(np.uint32), s, t


def _pack_block(keys: np.ndarray, several: np.ndarray, times: np.ndarray) -> bytes:
    """Anchors that occur once take a bit for that instead of their times."""
    often = times > 1
    return np.uint32(len(keys)).tobytes() + keys.tobytes() + np.packbits(several).tobytes() + np.packbits(often).tobytes() + times[often].tobytes()


def _open_block(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    m = -(-n // 8)
    bits = [np.unpackbits(np.frombuffer(blob, np.uint8, m, 4 + 4 * n + i * m), count=n).astype(bool) for i in (0, 1)]
    times = np.ones(n, np.int64)
    times[bits[1]] = np.frombuffer(blob, np.uint16, offset=4 + 4 * n + 2 * m)
    return np.frombuffer(blob, np.uint32, n, 4), bits[0], times


_WINDOW = np.dtype([("window", "u8"), ("doc", "i8"), ("key", "u8"), ("start", "u1")])


def _windows(keys: np.ndarray, x: "Batch") -> np.ndarray:
    """All windows of contexts, each with its hash."""
    a, b = x.lengths()
    size = a + b - x.reach + 1  # windows that lie in the text
    row = np.repeat(np.arange(len(keys)), np.maximum(size, 0))
    start = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0)) + (x.reach - a)[row]
    out = np.empty(len(row), _WINDOW)
    begin = x.at[row] - x.reach + start
    out["window"] = textvec.mix(textvec.span_hash(x.hashes, begin, begin + x.reach + GRAM) + start.astype(np.uint64))
    out["doc"], out["key"], out["start"] = x.doc[row], keys[row], start
    return out


def _window_verdicts(rows: np.ndarray) -> np.ndarray:
    """Whether a smaller document than the row's has the same window."""
    order = np.lexsort((rows["doc"], rows["window"]))
    window, doc = rows["window"][order], rows["doc"][order]
    head = np.r_[True, window[1:] != window[:-1]]
    out = np.empty(len(rows), bool)
    out[order] = doc > doc[head][np.cumsum(head) - 1]
    return out


def _record(reach: int) -> np.dtype:
    return np.dtype([("key", "u8"), ("gram", "u8"), ("doc", "i8"), ("a", "u1"), ("b", "u1"), ("left", "u1", (reach,)), ("right", "u1", (reach,))])


def _verdicts(rows: np.ndarray, reach: int) -> np.ndarray:
    """For each context of each batch: bits of the windows that a smaller document than the batch's least has."""
    order = np.lexsort((rows["doc"], rows["key"], rows["gram"]))
    rows_s = rows[order]
    head = np.ones(len(rows), bool)
    head[1:] = (rows_s["key"][1:] != rows_s["key"][:-1]) | (rows_s["gram"][1:] != rows_s["gram"][:-1])
    variant = np.cumsum(head) - 1
    v = rows_s[head]  # the least document of each context comes first
    new_gram = np.ones(len(v), bool)
    new_gram[1:] = v["gram"][1:] != v["gram"][:-1]
    gram = np.cumsum(new_gram) - 1
    many = np.bincount(gram)[gram] > 1
    step = np.arange(reach)
    first = np.repeat(v["doc"][:, None], reach + 1, 1)
    several = np.flatnonzero(many)
    begin = 0
    while begin < len(several):
        end = min(begin + SLICE, len(several))
        while end < len(several) and gram[several[end]] == gram[several[end - 1]]:
            end += 1  # contexts of an anchor stay together
        some = several[begin:end]
        left = np.where(step >= (reach - v["a"][some].astype(int))[:, None], v["left"][some], 256).astype(np.int64)
        right = np.where(step < v["b"][some].astype(int)[:, None], v["right"][some], 256).astype(np.int64)
        first[some] = first_documents(left, right, gram[some] - gram[some[0]], v["doc"][some])
        begin = end
    s = np.arange(reach + 1)
    fits = (s >= reach - v["a"][:, None].astype(int)) & (s <= v["b"][:, None])
    hit = fits[variant] & (first[variant] < rows_s["doc"][:, None])
    bits = np.empty(len(rows), np.uint32)
    bits[order] = (hit * (1 << s)).sum(1)
    return bits


def repeated_spans(docs: DataFrame, size: int = 50, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_bytes, starts, ends, kept) of every row of docs: removed byte runs, and the bytes that stay.

    A byte goes if a string of `size` bytes that covers it also starts in a document with a
    smaller id; strings are judged on the input. Null texts are empty; rows with a null id take
    no part and stay whole; rows that share an id are one document. Equal strings are told by
    64-bit hashes of anchors and contexts. A size from GRAM + 1 to GRAM + 31 is possible.
    """
    if not GRAM < size < GRAM + 32:
        raise ValueError(f"size must be from {GRAM + 1} to {GRAM + 31}")
    reach = size - GRAM
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(data).alias("h1"), F.xxhash64(F.lit(1), data).alias("h2"), F.length(data).cast("long").alias("n"))
    keyed = checkpoint(keyed)
    total = keyed.agg(F.sum("n")).first()[0] or 0
    batch_bytes = min(BATCH_BYTES, max(LEAST_BATCH_BYTES, total // 256))
    batches = max(1, -(-total // batch_bytes))
    parts = max(8, -(-total // (8 * PART_ANCHORS)))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    # a document that is a copy of one with a smaller id goes as a whole
    same = keyed.where((F.col("n") >= size) & F.col("doc_id").isNotNull())
    least = checkpoint(same.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "n", "least"))
    copies = same.join(least, ["h1", "h2", "n"]).where("doc_id > least").select(batch, F.lit(0).alias("kind"), F.lit(0).alias("part"), F.col("doc_id").alias("doc"), F.lit(None).cast("binary").alias("blob"))
    copies = checkpoint(copies)
    texts = docs.select(F.col(id_col).alias("doc_id"), data.alias("data")).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))

    def anchors(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return _reply([], 1)
        b = int(frame["batch"].iloc[0])
        return _reply([(b, 1, p, 0, _pack_block(k, s, t)) for p, k, s, t in _anchor_blocks(Batch(frame, _skip(replies), size), parts)], 1)

    def flag(frame: pd.DataFrame) -> pd.DataFrame:
        """An anchor that two documents have is flagged in every batch's block, and one with very many contexts once more."""
        opened = [_open_block(x) for x in frame["blob"]]
        key, several, times = (np.concatenate(x) for x in zip(*opened))
        order = np.argsort(key, kind="stable")
        k = key[order]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(head)
        hit = (np.diff(np.append(at, len(k))) > 1) | np.logical_or.reduceat(several[order], at)
        flags = np.empty((2, len(k)), bool)
        flags[0, order] = hit[np.cumsum(head) - 1]
        flags[1, order] = (np.add.reduceat(times[order], at) > HOT)[np.cumsum(head) - 1]
        each = np.split(flags, np.cumsum([len(x[0]) for x in opened])[:-1], axis=1)
        return _reply([(b, 1, p, 0, np.packbits(f, axis=1).tobytes()) for b, p, f in zip(frame["batch"], frame["part"], each) if f[0].any()], 1)

    def contexts(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """Distinct contexts of the flagged anchors, each with its least document in the batch."""
        bits = dict(zip(replies.loc[replies["kind"] == 1, "part"], replies.loc[replies["kind"] == 1, "blob"]))
        if not len(frame) or not bits:
            return _reply([], 2)
        x = Batch(frame, _skip(replies), size)
        known, hot = [], []
        for p, k, *_ in _anchor_blocks(x, parts):
            if p in bits:
                flags = np.unpackbits(np.frombuffer(bits[p], np.uint8).reshape(2, -1), axis=1, count=len(k)).astype(bool)
                known.append(p << 32 | k.astype(np.int64)[flags[0]])
                hot.append(flags[1][flags[0]])
        known, hot = np.concatenate(known), np.concatenate(hot)
        anchor = lambda: (_part(x.gram, parts) << 32) | (x.gram & np.uint64(0xFFFFFFFF)).astype(np.int64)
        x.only(np.isin(anchor(), known))
        key = x.keys()
        order = np.lexsort((x.doc, key))
        head = np.ones(len(key), bool)
        head[1:] = key[order][1:] != key[order][:-1]
        x.only(order[head])
        key, b = key[order[head]], int(frame["batch"].iloc[0])
        out, single = [], np.isin(anchor(), known[hot])
        if single.any():
            rows = _windows(key[single], copy.copy(x).only(single))
            out += [(b, 3, p, 0, rows[i].tobytes()) for p, i in _by_part(_part(rows["window"], parts))]
            key = key[~single]
            x.only(~single)
        rows = np.empty(len(x.at), _record(reach))
        rows["key"], rows["gram"], rows["doc"] = key, x.gram, x.doc
        rows["a"], rows["b"] = x.lengths()
        rows["left"], rows["right"] = x.contexts()
        return _reply(out + [(b, 2, p, 0, rows[i].tobytes()) for p, i in _by_part(_part(x.gram, parts))], 2)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        if frame["kind"].iloc[0] == 3:
            rows = [np.frombuffer(x, _WINDOW) for x in frame["blob"]]
            hits = np.split(_window_verdicts(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
            for b, r, x in zip(frame["batch"], rows, hits):
                if x.any():
                    out.append((b, 2, 0, 0, r["key"][x].tobytes() + (np.uint32(1) << r["start"][x].astype(np.uint32)).tobytes()))
            return _reply(out, 2)
        rows = [np.frombuffer(x, _record(reach)) for x in frame["blob"]]
        bits = _verdicts(np.concatenate(rows), reach)
        for b, r, x in zip(frame["batch"], rows, np.split(bits, np.cumsum([len(r) for r in rows])[:-1])):
            if x.any():
                out.append((b, 2, 0, 0, r["key"][x > 0].tobytes() + x[x > 0].tobytes()))
        return _reply(out, 2)

    def remove(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"doc_id": [], "n_bytes": [], "starts": [], "ends": [], "kept": []})
        x = Batch(frame, _skip(replies), size)
        said = [(np.frombuffer(y, np.uint64, len(y) // 12), np.frombuffer(y, np.uint32, offset=len(y) // 12 * 8)) for y in replies.loc[replies["kind"] == 2, "blob"]]
        key = x.keys()
        bits = np.zeros(len(key), np.int64)
        if sum(len(y[0]) for y in said):
            known, mask = np.concatenate([s[0] for s in said]), np.concatenate([s[1] for s in said])
            order = np.argsort(known)
            known, mask = known[order], mask[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, known[1:] != known[:-1]]) if len(known) else np.zeros(0, int)
            known, mask = known[first], np.bitwise_or.reduceat(mask, first) if len(first) else mask
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            bits = np.where(known[at] == key, mask[at], 0)
        order = np.lexsort((x.doc, key))
        if len(order):
            head = np.ones(len(key), bool)
            head[1:] = key[order][1:] != key[order][:-1]
            least = np.empty(len(key), np.int64)
            least[order] = x.doc[order][head][np.cumsum(head) - 1]
            a, b = x.lengths()
            bits = np.where(x.doc > least, (1 << (b + 1)) - (1 << (reach - a)), bits)
        start = np.zeros(len(x.data) + size, np.int32)
        for s in range(reach + 1):
            start[x.at[(bits >> s) & 1 == 1] - reach + s] = 1
        sums = np.concatenate([np.zeros(size, np.int32), np.cumsum(start, dtype=np.int32)])
        covered = sums[size : size + len(x.data)] - sums[: len(x.data)] > 0
        rows = []
        for i, text in enumerate(x.texts):
            if x.copy[i]:
                s, e, kept = np.array([0]), np.array([len(text)]), b""
            else:
                c = covered[x.begin[i] : x.end[i]]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
                s, e = edge[::2], edge[1::2]
                kept = np.frombuffer(text, np.uint8)[~c].tobytes() if len(s) else text
            rows.append((None if x.null[i] else x.doc_id[i], len(text), s.astype(np.int64), e.astype(np.int64), kept))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "starts", "ends", "kept"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    cogroup = lambda replies, f, schema: texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(f, schema)
    blocks = cogroup(copies, anchors, REPLY)
    flags = blocks.groupBy("part").applyInPandas(flag, REPLY)
    found = cogroup(flags.unionByName(copies), contexts, REPLY)
    verdicts = found.groupBy("kind", "part").applyInPandas(compare, REPLY)
    out = cogroup(verdicts.unionByName(copies), remove, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return out.withColumnRenamed("doc_id", id_col)


def _reply(rows: list[tuple], kind: int) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["batch", "kind", "part", "doc", "blob"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
