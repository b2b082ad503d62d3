"""N-gram Jaccard join: MinHash LSH forest over word shingles, then exact verification in blocks.

Every set of shingles has a label of DEPTH digits (16 bits of a MinHash each) in each of TREES
trees. Labels are sorted by range, which makes a tree a sorted prefix trie; sets that share a
prefix are candidates. The prefix is the longest at which a pair at the threshold, and so every more similar one, is
found with the chance RECALL. Nothing that the join does depends on a sample; one is only drawn to measure the recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import textvec
from trendspark.llm.common import checkpoint, connected_components, counted, release, table

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.999
SAMPLE, SAMPLE_BYTES = 500, 32_768  # `sampled_links`: documents whose links are found exactly, and the bytes of their texts
MEASURED = 20  # sampled documents with links that a measure needs; else a pair at the threshold counts
BLOCK = 1024
SETS = "n long, h1 long, labels binary, shingles binary"

_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_XORS = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)
_ODDS = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)


def expected_recall(threshold: float, depth: int, trees: int = TREES) -> float:
    """Chance that a pair of this similarity shares a prefix of this length in a tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(found: dict[int, list[int]], threshold: float, recall: float = RECALL) -> int:
    """Shorten the prefix from whole labels until the recall reaches the target: that of a pair at the threshold, where nothing is given.

    found: for each sampled document with links, how many of them share at most 0, 1, ... DEPTH
    digits in their best tree. Documents count alike, however many links they have. It tells the depth that
    suffices for links like those of the sample, which may be too long for others.
    """
    for depth in range(DEPTH, 0, -1):
        reached = [sum(links[depth:]) / sum(links) for links in found.values()]
        if (sum(reached) / len(reached) if len(reached) >= MEASURED else expected_recall(threshold, depth)) >= recall:
            return depth
    raise ValueError(f"{TREES} trees don't reach a recall of {recall} at the similarity {threshold}")


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the word shingles of each text, sorted, without repeats; hashes have 44 bits.

    Texts of one to four words are one shingle of all their words; texts without words have none.
    """
    w = textvec.Words(texts)
    n = len(w.hash)
    value = np.zeros(n, np.uint64)
    begin = np.concatenate([[0], np.cumsum(w.count)])
    left = begin[w.doc + 1] - np.arange(n)
    for j in range(WORDS):
        inside = left > j
        at = np.minimum(np.arange(n) + j, max(n - 1, 0))
        value += np.where(inside, w.hash[at] * _FACTORS[j], np.uint64(0))
    full = (left >= WORDS) | (np.arange(n) == begin[w.doc])  # the first one stands for a short text
    value = textvec.mix(value[full] + np.minimum(left[full], WORDS).astype(np.uint64))
    key = textvec.sorted_unique((w.doc[full].astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)


def _set_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of shingles of each text and two hashes of their set; and the shingles."""
    doc, value = shingles(texts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    u = textvec.mix(value)
    h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    have = np.flatnonzero(count)
    if len(have):
        first = np.concatenate([[0], np.cumsum(count[have])[:-1]]).astype(np.int64)
        h1[have] = np.add.reduceat(u, first)
        h2[have] = np.add.reduceat(textvec.mix(u + np.uint64(0x9E3779B97F4A7C15)), first)
    return count, h1.view(np.int64), h2.view(np.int64), doc, value


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Keys of the set of each text, digits [text, tree, digit] of its labels, and the shingles."""
    count, h1, h2, doc, value = _set_keys(texts)
    u = textvec.mix(value)
    have = np.flatnonzero(count)
    first = np.concatenate([[0], np.cumsum(count[have])[:-1]]).astype(np.int64)
    digits = np.zeros((len(texts), TREES, DEPTH), ">u2")  # bytes of labels sort as their digits
    for k in range(TREES * DEPTH if len(have) else 0):
        digits[have, k // DEPTH, k % DEPTH] = textvec.mix(np.minimum.reduceat((u ^ _XORS[k]) * _ODDS[k], first)) & np.uint64(0xFFFF)
    return count, h1, h2, digits, (doc, value)


class Sample:
    """Sampled sets, and the exact links of other sets to them."""

    def __init__(self, texts: list[bytes], threshold: float):
        self._index(*signatures(texts), threshold)

    @classmethod
    def of_rows(cls, rows: pa.Table, threshold: float) -> Sample:
        """Of rows of SETS, so that the driver, which makes it, hashes no texts."""
        size = rows["n"].to_numpy()
        each = lambda c, kind: np.frombuffer(b"".join(rows[c].to_pylist()), kind)
        out = cls.__new__(cls)
        out._index(size, rows["h1"].to_numpy(), None, each("labels", ">u2").reshape(-1, TREES, DEPTH), (np.repeat(np.arange(len(size)), size), each("shingles", np.uint64)), threshold)
        return out

    def _index(self, size, h1, _, digits, sets, threshold: float) -> None:
        self.threshold, self.size, self.h1, self.digits = threshold, size, h1, digits
        doc, value = sets
        order = np.argsort(value, kind="stable")
        self.value, self.doc = value[order], doc[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.value & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def links(self, count, h1, digits, doc, value) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, sampled set, digits shared in the best tree) of all links between different sets."""
        maybe = np.flatnonzero(self.seen[(value & np.uint64(0xFFFFF)).astype(np.int64)])
        low, high = np.searchsorted(self.value, value[maybe]), np.searchsorted(self.value, value[maybe], side="right")
        size = high - low
        k = np.repeat(low - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
        pair, both = np.unique(np.repeat(doc[maybe], size) * len(self.size) + self.doc[k], return_counts=True)
        a, b = pair // len(self.size), pair % len(self.size)
        near = (both >= self.threshold * (count[a] + self.size[b] - both) - 1e-6) & (h1[a] != self.h1[b])
        a, b = a[near], b[near]
        return a, b, np.cumprod(digits[a] == self.digits[b], axis=2).sum(2).max(1, initial=0)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = textvec.encoded(b["text"])
        for i, j in textvec.chunks(texts):
            count, h1, h2, digits, _ = signatures(texts[i:j])
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "n": count, "h1": h1, "h2": h2, "labels": [x.tobytes() for x in digits]})


def _hits(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = textvec.encoded(b["text"])
            for i, j in textvec.chunks(texts):
                count, h1, _, digits, sets = signatures(texts[i:j])
                _, k, depth = shared.value.links(count, h1, digits, *sets)
                yield pd.DataFrame({"hit": (k * 16 + depth).astype(np.int32)})

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = textvec.encoded(b["text"])
        for i, j in textvec.chunks(texts):
            count, h1, _, digits, (_, value) = signatures(texts[i:j])
            yield pd.DataFrame({"n": count, "h1": h1, "labels": [x.tobytes() for x in digits], "shingles": [x.tobytes() for x in np.split(value, np.cumsum(count)[:-1])]})


def sample_sets(plain: DataFrame) -> pa.Table:
    """Rows of SETS of at most SAMPLE texts of at most SAMPLE_BYTES, those with the least hashed ids; texts are hashed in a task."""
    fits = plain.where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("doc_id").isNotNull())
    ids = fits.select("doc_id", F.xxhash64(F.lit("sample"), "doc_id").alias("h")).distinct().orderBy("h").limit(SAMPLE).select("doc_id")
    return fits.join(F.broadcast(ids), "doc_id").select("text").limit(SAMPLE).mapInPandas(_sets, SETS).toArrow()


def sampled_links(plain: DataFrame, threshold: float) -> dict[int, list[int]]:
    """What `prefix_depth` takes, of the exact links between a sample and all rows (doc_id, text): a measure of the recall, which the join doesn't need."""
    shared = plain.sparkSession.sparkContext.broadcast(Sample.of_rows(sample_sets(plain), threshold))
    found = {}
    for hit, k in plain.where("doc_id is not null").select("text").mapInPandas(_hits(shared), "hit int").groupBy("hit").count().collect():  # SAMPLE * (DEPTH + 1) rows at most
        found.setdefault(hit // 16, [0] * (DEPTH + 1))[hit % 16] = k
    return found


def block_links(doc: np.ndarray, value: np.ndarray, n: int, weight: np.ndarray, across: np.ndarray, threshold: float, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Verify all pairs of n sets exactly: for each, the weight of its partners and the label of its component.

    across: side of each set (pairs of equal sides are left out where sides differ at all).
    Intersections are summed over slabs of the shingles that two sets have at least.
    """
    size = np.bincount(doc, minlength=n)
    distinct, which, often = np.unique(value, return_inverse=True, return_counts=True)
    keep = often[which] > 1
    column = (np.cumsum(often > 1) - 1)[which[keep]]
    row = doc[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [low, low + width])
        slab = np.zeros((n, width), np.float32)
        slab[row[i:j], column[i:j] - low] = 1
        both += slab @ slab.T
    union = size[:, None] + size[None, :] - both
    hit = (both >= threshold * union - 1e-6) & (both > 0)
    np.fill_diagonal(hit, False)
    label = np.arange(n)
    if across.any() and not across.all():
        hit &= across[:, None] != across[None, :]
    while True:  # each set takes the least label around, then that label's own
        new = np.minimum(label, np.where(hit, label[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == label).all():
            return hit @ weight, label
        label = new


def _verify(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["component", "sid", "n"]).reset_index(drop=True)
        # rows that share the id of a set's document may have other texts
        count, h1, h2, *_ = _set_keys(textvec.encoded(frame["text"]))
        frame = frame[(count == frame["n"].to_numpy()) & (h1 == frame["h1"].to_numpy()) & (h2 == frame["h2"].to_numpy())].drop_duplicates("sid").reset_index(drop=True)
        doc, value = shingles(textvec.encoded(frame["text"]))
        at = np.searchsorted(doc, np.arange(len(frame) + 1))
        heads = np.flatnonzero(np.r_[True, np.diff(frame["component"].to_numpy()) != 0]) if len(frame) else np.zeros(0, int)
        ids, copies = frame["sid"].to_numpy(), frame["copies"].to_numpy()
        side = (frame["own"] != frame["low"]).to_numpy()
        cross = (frame["low"] != frame["high"]).to_numpy()
        out = []
        for i, j in zip(heads, [*heads[1:], len(frame)]):
            s = slice(at[i], at[j])
            across = side[i:j] if cross[i] else np.zeros(j - i, bool)
            if cross[i] and across.all() | (~across).all():
                continue
            links, label = block_links(doc[s] - i, value[s], j - i, copies[i:j], across, threshold)
            out.append(pd.DataFrame({"sid": ids[i:j], "links": links.astype(np.int64), "least": ids[i:j][label]}))
        out = pd.concat(out) if out else pd.DataFrame({"sid": [], "links": [], "least": []})
        return out[out["links"] > 0]

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id", recall: float = RECALL) -> DataFrame:
    """(id_col, copy_of, class_id, n_links) of every row: near-duplicate classes by shingles of five words.

    Texts with equal shingle sets are copies of the least id among them (copy_of) and are
    compared once. Sets that share a prefix in a tree of the forest are candidates; every pair of
    a connected set of candidates is verified exactly (on 44-bit hashes of shingles), in blocks
    of BLOCK sets whose sizes can fit, so that pairs are counted and never emitted. n_links: other
    rows with at least this Jaccard similarity, copies included; class_id: the least id that links
    lead to. Texts without words, and rows with a null id, have no links and their own id as class.
    Rows that share an id are separate documents. recall: the chance to find a pair at the threshold, more for more similar ones; one that the trees can't reach is an error.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    depth = prefix_depth({}, threshold, recall)
    signed = checkpoint(plain.where("doc_id is not null").mapInPandas(_sign, "doc_id long, n long, h1 long, h2 long, labels binary"))
    sets = ["n", "h1", "h2"]
    same = signed.where("n > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    same = checkpoint(same.withColumn("sid", F.monotonically_increasing_id()))
    # the tries: labels of all trees in sorted ranges, in which those with a common prefix lie together
    label = F.substring("labels", F.col("tree") * (2 * DEPTH) + 1, 2 * DEPTH)
    trees = same.select("sid", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", label.alias("label"), "sid")
    trees = checkpoint(trees.repartitionByRange("tree", "label", "sid").sortWithinPartitions("tree", "label"))
    entries = trees.select("tree", F.substring("label", 1, 2 * depth).alias("prefix"), "sid")
    nodes = checkpoint(entries.groupBy("tree", "prefix").agg(F.min("sid").alias("least"), F.max("sid").alias("most")).where("least < most").drop("most"))
    member = connected_components(entries.join(nodes, ["tree", "prefix"]).where("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b")))
    release(docs.sparkSession)
    member = member.join(same.drop("labels"), member["node"] == same["sid"]).drop("node")
    # sizes differ by less than the factor 1/threshold in a link: only neighbouring size classes meet
    member, total = counted(member.withColumn("z", F.floor(F.ln("n") / float(-np.log(threshold)) + 1e-9).cast("int")))
    classes = member.groupBy("component", "z").agg(F.count("*").alias("m")).withColumn("subs", F.ceil(F.col("m") / BLOCK).cast("int"))
    sizes = classes.groupBy("component").agg(F.sum("m").alias("all"), F.map_from_entries(F.collect_list(F.struct("z", "subs"))).alias("subs"))
    member = member.join(checkpoint(sizes), "component")
    groups = max(1, -(-total // BLOCK))
    own = F.col("z") * 1_000_000 + F.pmod(F.xxhash64("sid"), F.col("subs")[F.col("z")])
    in_class = lambda z: F.filter(F.sequence(F.lit(0), F.coalesce(F.col("subs")[z], F.lit(0))), lambda s: s > 0)
    near = F.flatten(F.transform(F.array(F.col("z") - 1, F.col("z"), F.col("z") + 1), lambda z: F.transform(in_class(z), lambda s: (z * 1_000_000 + s - 1).cast("long"))))
    small = F.col("all") <= BLOCK
    member = member.withColumn("own", F.when(small, 0).otherwise(own).cast("long")).withColumn("near", F.when(small, F.array(F.lit(0).cast("long"))).otherwise(near))
    kept = ["rep", "sid", *sets, "component", "copies", "own", "all"]
    placed = member.select(*kept, F.explode("near").alias("other")).select(
        *kept[:-1], F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("all") <= BLOCK, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))).alias("group"),
        (F.col("all") <= BLOCK).alias("packed"),
    )
    placed = checkpoint(placed)
    # never by broadcast: what small tables save so would come back as a shuffle of all texts once the places outgrow it
    texts = plain.join(placed.hint("merge"), plain["doc_id"] == placed["rep"]).drop("doc_id")
    links = checkpoint(texts.groupBy("packed", "group").applyInPandas(_verify(threshold), "sid long, links long, least long"))
    count = links.groupBy("sid").agg(F.sum("links").alias("links"))
    linked = connected_components(links.select(F.col("sid").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("sid"), "component")
    release(docs.sparkSession)
    known = checkpoint(same.drop("labels").join(count, "sid", "left").join(linked, "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    first = checkpoint(known.groupBy("component").agg(F.min("rep").alias("class_id")))
    known = known.join(first, "component").select(*sets, F.col("rep").alias("copy_of"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", *sets).join(checkpoint(known), sets, "left").select(
        F.col("doc_id").alias(id_col), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )
    nothing = plain.where("doc_id is null").select(F.col("doc_id").alias(id_col), F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nothing)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
