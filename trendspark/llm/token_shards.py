"""Token ids in shards, each one file with a wavelet matrix: written in id order, read back, counted and searched.

A shard holds whole documents in ascending order of id, and is one Parquet file of one row: part
and seq (its place in the order), base (ids before it in its part), n_ids, the doc_ids and sizes
of its documents, and `ids`, the wavelet matrix (see wavelet.py) of their ids one after another.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import scratch_dir, table
from trendspark.llm.wavelet import WaveletMatrix

#: A shard closes at this many ids (a longer document has one of its own): 1 to 4 MB, some 100 MB of memory in its task.
SHARD_IDS = 1 << 21
#: White space of the split pattern of byte-level tokenizers (\s of Unicode): fixed values.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")
#: ASCII marks: a run of them between letters and white space is one entry of the split pattern. Not the apostrophe, which may begin one with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Entries that a worker remembers at most, in two generations each.
PIECES, WORDS = 1_200_000, 400_000

_encoders: dict[str, Encoder] = {}


class _Memory(dict):
    """A dict of bounded size: when it holds half of `most`, the entries before the last half go, but for those used since."""

    def __init__(self, most: int):
        self.half, self.older = max(1, most // 2), {}

    def seek(self, key: str) -> bytes | None:
        """The value of a key that this dict doesn't have itself."""
        got = self.older.get(key)
        if got is not None:
            self.keep(key, got)
        return got

    def keep(self, key: str, value: bytes) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it is printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by the tokenizer in a file of the tokenizers library.

    A byte-level tokenizer splits a text before any white space that follows other characters, and
    what it does to one side doesn't depend on the other. So a text is cut at such spaces, and
    each different piece goes through the library once. Tokenizers of other kinds, and texts with
    runs of white space, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        split, bpe, self.added = kind.get("pre_tokenizer") or {}, kind.get("model") or {}, [x["content"] for x in kind.get("added_tokens") or []]
        self.by_pieces = (
            kind.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
            and bpe.get("type") == "BPE" and not bpe.get("dropout")
            and not any(WHITE & set(x["content"]) or x["single_word"] or x["lstrip"] or x["rstrip"] for x in kind.get("added_tokens") or [])
        )
        # added tokens that letters and marks alone might hold
        self.added_marks = any(not x.rstrip(MARKS) or x.rstrip(MARKS).isalpha() for x in self.added)
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.pieces, self.words = _Memory(PIECES), _Memory(WORDS)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Letters, or a space and letters: one entry of the split pattern, so that the model's merges are all there is to do."""
        got = self.words.get(word) or self.words.seek(word)
        if got is None:
            got = array("I", [x.id for x in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
            self.words.keep(word, got)
        return got

    def _mark(self, mark: str) -> bytes:
        """An ASCII mark between letters and white space, or a line feed between others: an entry of its own."""
        got = self.words.get(mark) or self.words.seek(mark)
        if got is None:
            got = self._whole(mark)
            self.words.keep(mark, got)
        return got

    def _apart(self, space: str, piece: str) -> bytes:
        """The ids of a space (or none) and a piece."""
        word = piece.rstrip(MARKS)
        if not word.isalpha() or self.added_marks:
            return self._whole(space + piece)
        return self._word(space + word) + (self._mark(piece[len(word) :]) if len(word) < len(piece) else b"")

    def _piece(self, piece: str) -> bytes | None:
        """The ids of a piece with the space before it (a piece at a line's start has its line feed instead); None where it can't be cut off."""
        got = self.pieces.seek(piece)
        if got is not None:
            return got
        if not piece or piece[-1] in WHITE:
            return None
        if piece[0] != "\n":
            got = self._apart(" ", piece)
        else:
            got = self._whole(piece) if piece[1] in WHITE else self._mark("\n") + self._apart("", piece[1:])
        self.pieces.keep(piece, got)
        return got

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_pieces:
            return self._whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        found = [*map(self.pieces.get, rest)]
        if None in found:
            found = [self._piece(p) if v is None else v for p, v in zip(rest, found)]
        if (rest and (not first or first[-1] in WHITE)) or None in found:
            return self._whole(text)
        return b"".join([self._apart("", first), *found])


def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id", shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every whole text, each with end_id after it, as shards to a folder that Spark can write.

    Documents come in ascending order of id, nulls first; rows that share an id are documents of
    their own, ordered by the hash of their texts (rows with equal texts are interchangeable). Null
    and empty texts have the end id alone; unpaired surrogates become '?'. An empty table
    gives a folder without shards. Other columns are ignored. The tokenizer's file must be at the
    same path on all executors. Texts pass one at a time; a task holds one shard and a batch of texts.
    """

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), array("I", [end_id]).tobytes()
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        ids, sizes, held, total = [], [], [], 0

        def shard() -> pd.DataFrame:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"))
            return pd.DataFrame({"part": [part], "seq": [seq], "base": [base], "n_ids": [total], "doc_ids": [ids], "sizes": [sizes], "ids": [matrix]})

        for b in batches:
            missing = b["__missing"].to_numpy()
            for d, gone, t in zip(b["__id"].to_numpy(), missing, b["__text"]):
                if isinstance(t, str) and not t.isascii():
                    t = t.encode("utf-8", "replace").decode()
                got = encode(t) + end
                if total and total + len(got) // 4 > shard_ids:
                    yield shard()
                    seq, base = seq + 1, base + total
                    ids, sizes, held, total = [], [], [], 0
                ids.append(None if gone else int(d))
                sizes.append(len(got) // 4)
                held.append(got)
                total += len(got) // 4
        if total:
            yield shard()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("__id"), F.col(id_col).isNull().alias("__missing"), text.alias("__text"))
    order = [F.desc("__missing"), F.asc("__id")]
    # ranges are dealt by the id alone, so that the sample of the ranges reads no texts
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64("__text"))
    out = rows.mapInPandas(shards, "part int, seq int, base long, n_ids long, doc_ids array<bigint>, sizes array<bigint>, ids binary")
    # one row, one file; the planes are packed already
    out.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(folder)


def _parts(spark: SparkSession, folder: str) -> dict[int, int]:
    """Ids before each part: one number a partition of the writing job."""
    out, before = {}, 0
    for r in spark.read.parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        out[r["part"]] = before
        before += r["n"]
    return out


SHARD = "part int, seq int, base long, n_ids long, doc_ids array<bigint>, sizes array<bigint>, ids binary"


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, token_ids]) of every document in the shards of a folder.

    start counts the ids of all documents before it; the crc is of the ids as little-endian
    unsigned 32-bit integers, end id included. A folder without shards gives no rows.
    """
    before = _parts(spark, folder)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids = WaveletMatrix.load(r.ids).decode().astype("<u4", copy=False)
                sizes = np.asarray(r.sizes, np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                starts = ends - sizes
                out = pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "start": starts + (before[r.part] + r.base), "n_tokens": sizes})
                out["ids_crc32"] = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                if with_ids:
                    out["token_ids"] = [ids[s:e].astype(np.int64) for s, e in zip(starts.tolist(), ends.tolist())]
                yield out

    schema = "doc_id bigint, start long, n_tokens long, ids_crc32 long" + ", token_ids array<bigint>" * with_ids
    return spark.read.schema(SHARD).parquet(folder).select("part", "base", "doc_ids", "sizes", "ids").mapInPandas(documents, schema)


def count_tokens(spark: SparkSession, folder: str, wanted: list[int]) -> DataFrame:
    """(token, n): how often each wanted id occurs, by rank in every shard, without decoding. Ids that don't occur have 0."""
    wanted = sorted(set(wanted))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(wanted), np.int64)
        for b in batches:
            for data in b["ids"]:
                matrix = WaveletMatrix.load(data)
                sums += [matrix.rank(x) for x in wanted]
        yield pd.DataFrame({"token": wanted, "n": sums})

    known = spark.createDataFrame([(x, 0) for x in wanted], "token bigint, n bigint")
    return known.unionByName(spark.read.schema(SHARD).parquet(folder).select("ids").mapInPandas(counts, "token bigint, n bigint")).groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, folder: str, wanted: list[int]) -> DataFrame:
    """(token, doc_id, place): every occurrence of the wanted ids, by select in every shard; place counts from 0 in its document."""
    wanted = sorted(set(wanted))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                matrix = WaveletMatrix.load(r.ids)
                ends, docs = np.cumsum(np.asarray(r.sizes, np.int64)), pd.array(list(r.doc_ids), dtype="Int64")
                for x in wanted:
                    at = np.sort(matrix.select(x))
                    home = np.searchsorted(ends, at, side="right")
                    yield pd.DataFrame({"token": x, "doc_id": docs[home], "place": at - np.r_[0, ends][home]})

    return spark.read.schema(SHARD).parquet(folder).select("doc_ids", "sizes", "ids").mapInPandas(places, "token bigint, doc_id bigint, place bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder)
