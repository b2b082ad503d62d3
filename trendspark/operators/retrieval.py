"""Batched retrieval: dense, sparse and fused top-k, source caps, facet merges, context budgets."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, MapType, StructField, StructType

from trendspark.functions import text as tx
from trendspark.functions import urls

RRF = 60
FACETS = ("meaning", "why_popular", "usage", "who")
QUERY_BYTES = 16 << 20  # vectors of queries that a task of the dense search holds
SCORED = 2048  # chunks that are scored at once
MAX_SOURCES, MAX_SOURCE_CHARS, MAX_CHARS = 6, 1800, 8000


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which of them had a length."""
    v = np.vstack(vectors.to_numpy()).astype(float)
    length = np.sqrt((v * v).sum(1))
    return v / np.where(length > 0, length, 1)[:, None], length > 0


class _Best:
    """The k best (query, id, score) of what was added, ties by id; queries are numbers under n."""

    def __init__(self, n: int, k: int):
        self.k, self.waits, self.waiting = k, [], 0
        self.least = np.full(n, -np.inf)  # of the k-th best score a lower bound
        self.held = pd.DataFrame({"q": np.zeros(0, np.int64), "id": [], "score": np.zeros(0)})

    def add(self, queries: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """score: a row for each of these queries, a column for each id; -inf is no hit."""
        least = self.least[queries]
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        q, at = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        if len(q):
            self.waits.append(pd.DataFrame({"q": queries[q], "id": ids[at], "score": score[q, at]}))
            self.waiting += len(q)
        if self.waiting > len(self.held) // 2:
            self.settle()

    def settle(self) -> pd.DataFrame:
        both = pd.concat([x for x in (self.held, *self.waits) if len(x)] or [self.held]).sort_values(["q", "score", "id"], ascending=[True, False, True])
        self.held, self.waits, self.waiting = both[both.groupby("q").cumcount() < self.k], [], 0
        full = self.held.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.least[full.index.to_numpy(int)] = full["min"].to_numpy()
        return self.held


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, within: str | None = "keyword", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine (to nine decimals), within the query's keyword or, with within=None, among all chunks.

    The chunks' vectors stay where they are read: each task scores its batches by matrix products
    against a block of queries that it holds, keeps the k best of every query, and sends only
    those. A block has query_bytes of vectors at most; more queries take more blocks, each one
    pass over the chunks. Vectors of length 0, and null ones, match nothing.
    """
    key = F.col(within).cast("string") if within else F.lit("")
    q = queries.where("vec is not null").select("query_id", key.alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    c = chunks.where("vec is not null").select("chunk_id", key.alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double"
    size = q.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    blocks = max(1, -(-(size["n"] * 8 * (size["d"] or 1)) // query_bytes))

    def search(block: DataFrame) -> DataFrame:
        asked = block.toPandas()  # query_bytes at most
        ids, codes = asked["query_id"].to_numpy(), pd.Index(asked["key"].unique())
        vectors, ok = _unit(asked["vec"]) if len(asked) else (np.zeros((0, 1)), np.zeros(0, bool))
        ids, keys, vectors = ids[ok], codes.get_indexer(asked["key"])[ok], vectors[ok]

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found, all_of_them = _Best(len(ids), k), np.arange(len(ids))
            for b in batches:
                for s in range(0, len(b) if len(ids) else 0, SCORED):
                    part = b.iloc[s : s + SCORED]
                    v, fits = _unit(part["vec"])
                    own = codes.get_indexer(part["key"])
                    fits &= own >= 0
                    if fits.any():
                        score = np.round(vectors @ v[fits].T, 9)
                        score[keys[:, None] != own[fits][None]] = -np.inf
                        found.add(all_of_them, part["chunk_id"].to_numpy()[fits], score)
            held = found.settle()
            if len(held):
                yield pd.DataFrame({"query_id": ids[held["q"].to_numpy(int)], "chunk_id": held["id"], "score": held["score"]})

        return c.mapInPandas(best, schema)

    out = None
    for n in range(blocks):
        one = search(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else q)
        out = one if out is None else out.unionByName(one)
    return _ranked(out, k)


class _TokenLists:
    """For each token the queries that hold it, with their weights; use_only drops queries."""

    def __init__(self, token: np.ndarray, query: np.ndarray, weight: np.ndarray, n: int):
        order = np.argsort(token, kind="stable")
        self.all = token[order], query[order], weight[order]
        self.n_tokens = int(token.max(initial=-1)) + 1
        self.norm = np.sqrt(np.bincount(query, weight * weight, minlength=n))
        self.use_only(np.arange(n))

    def use_only(self, queries: np.ndarray) -> None:
        self.queries, place = queries, np.full(len(self.norm), -1)
        place[queries] = np.arange(len(queries))
        token, query, weight = self.all
        stays = place[query] >= 0
        self.query, self.weight = place[query[stays]], weight[stays]
        self.starts = np.searchsorted(token[stays], np.arange(self.n_tokens + 1))

    def score(self, token: np.ndarray, chunk: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """A row a query in use, a column a chunk; -inf where no token is common."""
        often = np.diff(self.starts)[token]
        ends = np.cumsum(often)
        at = np.repeat(self.starts[token] - (ends - often), often) + np.arange(ends[-1] if len(ends) else 0)
        cell = self.query[at] * n + np.repeat(chunk, often)
        size, each = len(self.queries) * n, self.weight[at] * np.repeat(weight, often)
        out = np.bincount(cell, each, minlength=size).astype(float, copy=False)  # bincount of nothing counts in integers
        out[(out == 0) if (each > 0).all() else np.bincount(cell, minlength=size) == 0] = -np.inf
        return out.reshape(len(self.queries), n)


def sparse_topk(queries: DataFrame, postings: DataFrame, k: int, within: str | None = "keyword", query_bytes: int = 2 * QUERY_BYTES, cells: int = SCORED << 9) -> DataFrame:
    """By the product of token weights. queries: (query_id, keyword, token, weight); postings: (chunk_id, keyword, token, weight); within as in dense_topk.

    Nothing is joined by tokens, as frequent ones are in most queries and chunks. The postings are gathered by
    chunk; a task holds the token lists of a block of queries (query_bytes at most, as in dense_topk), takes its chunks
    by falling length of their weights and keeps the k best of every query. A product is at most that of the two
    lengths, so a query whose k-th best is over that for the next chunk is through with this task: no pair is lost,
    ties included. Matrices of scores have cells entries. Null tokens and weights match nothing.
    """
    token = F.concat(F.length(F.col(within).cast("string")).cast("string"), F.lit(":"), F.col(within).cast("string"), "token") if within else F.col("token")
    q = queries.select("query_id", token.alias("token"), F.col("weight").cast("double").alias("weight")).where("token is not null and weight is not null")
    c = postings.select("chunk_id", token.alias("token"), F.col("weight").cast("double").alias("weight")).where("token is not null and weight is not null")
    c = c.groupBy("chunk_id").agg(F.collect_list(F.struct("token", "weight")).alias("p"))
    c = c.select("chunk_id", F.col("p.token").alias("token"), F.col("p.weight").alias("weight"), F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"])).alias("norm")).sortWithinPartitions(F.desc("norm"))
    fields = {x: next(f.dataType for f in df.schema if f.name == x) for df, x in ((queries, "query_id"), (postings, "chunk_id"))}
    schema = f"query_id {fields['query_id'].simpleString()}, chunk_id {fields['chunk_id'].simpleString()}, score double"
    blocks = max(1, -(-(q.agg(F.sum(F.octet_length("token") + 16)).first()[0] or 0) // query_bytes))

    def search(block: DataFrame) -> DataFrame:
        asked = block.toPandas()  # query_bytes at most
        at, ids = pd.factorize(asked["query_id"])
        codes, tokens = pd.factorize(asked["token"])
        tokens, weights = pa.array(tokens, pa.string()), asked["weight"].to_numpy(float)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, lists = _Best(len(ids), k), _TokenLists(codes, at, weights, len(ids))
            for b in batches:
                for s in range(0, b.num_rows if len(lists.queries) else 0, 256):
                    part = b.slice(s, 256)
                    norm, own = part["norm"].to_numpy(), part["chunk_id"].to_pandas().to_numpy()
                    code = pc.index_in(part["token"].flatten(), value_set=tokens).fill_null(-1).to_numpy()
                    chunk = np.repeat(np.arange(len(norm)), pc.list_value_length(part["token"]).to_numpy())
                    known = code >= 0
                    code, chunk, weight = code[known], chunk[known], part["weight"].flatten().to_numpy()[known]
                    first = 0
                    while first < len(norm):
                        # what rounding may add is far under this
                        open_ = np.flatnonzero(lists.norm[lists.queries] * norm[first] * (1 + 1e-9) >= found.least[lists.queries])
                        if 2 * len(open_) <= len(lists.queries):
                            lists.use_only(lists.queries[open_])
                        if not len(lists.queries):
                            break
                        last = min(len(norm), first + max(1, cells // len(lists.queries)))
                        low, high = np.searchsorted(chunk, [first, last])
                        if high > low:
                            found.add(lists.queries, own[first:last], lists.score(code[low:high], chunk[low:high] - first, weight[low:high], last - first))
                        first = last
            held = found.settle()
            if len(held):
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": ids[held["q"].to_numpy(int)], "chunk_id": held["id"], "score": held["score"]}), pa_schema, preserve_index=False)

        return c.mapInArrow(best, schema)

    pa_schema = to_arrow_schema(StructType([StructField("query_id", fields["query_id"]), StructField("chunk_id", fields["chunk_id"]), StructField("score", DoubleType())]))
    out = None
    for n in range(blocks):
        one = search(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else q)
        out = one if out is None else out.unionByName(one)
    return _ranked(out, k)


def rrf_fuse(lists: list[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists."""
    both = lists[0].select("query_id", "chunk_id", "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select("query_id", "chunk_id", "rank"))
    return _ranked(both.groupBy("query_id", "chunk_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score")), k)


def min_dense_score(hits: DataFrame, dense: DataFrame, least: float) -> DataFrame:
    """Candidates that the dense list does not have score 0 there."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"))
    return hits.join(d, ["query_id", "chunk_id"], "left").withColumn("dense_score", F.coalesce("dense_score", F.lit(0.0))).where(F.col("dense_score") >= least)


def topk_with_cap(hits: DataFrame, k: int, cap: int | None, by: str = "query_id") -> DataFrame:
    """The best k, at most cap of a source first; what goes over the cap only fills up, after all others."""
    if not cap:
        order = ["rank"]
        out = hits
    else:
        out = hits.withColumn("__n", F.row_number().over(Window.partitionBy(by, "source").orderBy("rank"))).withColumn("__over", F.col("__n") > cap)
        order = ["__over", "rank"]
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)
    return out.drop("__n", "__over")


def hybrid_search(queries: DataFrame, sparse_queries: DataFrame, chunks: DataFrame, postings: DataFrame, k: int, valid: Column, over_fetch: int = 3, cap: int | None = None, least_dense: float = 0.0, within: str | None = "keyword") -> DataFrame:
    """Both lists with 2 * raw candidates, fused to raw = k * over_fetch, floor, validity, source cap."""
    raw = k * over_fetch
    dense = dense_topk(queries, chunks, 2 * raw, within)
    fused = rrf_fuse([dense, sparse_topk(sparse_queries, postings, 2 * raw, within)], raw)
    if least_dense:
        fused = min_dense_score(fused, dense, least_dense)
    good = fused.join(chunks.drop("vec"), "chunk_id").where(valid)
    return topk_with_cap(good, k, cap)


def facet_queries(queries: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    return queries.select("*", F.posexplode(F.array(*map(F.lit, facets))).alias("facet_no", "facet")).withColumn("query_id", F.concat_ws("__", "query_id", "facet"))


def merge_facets(hits: DataFrame, cap: int = 3, least: int = 8, near: float | None = None) -> DataFrame:
    """Merge the facets' hits of each keyword in order (facet_no, rank): repeats go, at most cap of a source, then fill up to least.

    near=None needs two windows. With a similarity, near-duplicate texts go too; that rule
    depends on what was accepted before, so each keyword's few hits are folded in one group.
    Columns added: place, deferred, facets.
    """
    order = F.struct("facet_no", "rank")
    rest = [c for c in hits.columns if c not in ("keyword", "chunk_id", "facet_no", "rank", "facet")]
    one = hits.groupBy("keyword", "chunk_id").agg(F.min(order).alias("__o"), F.array_sort(F.collect_set("facet")).alias("facets"), *[F.min_by(c, order).alias(c) for c in rest])
    if near is None:
        n = F.row_number().over(Window.partitionBy("keyword", "source").orderBy("__o"))
        out = one.withColumn("deferred", n > cap)
        out = out.withColumn("place", F.row_number().over(Window.partitionBy("keyword").orderBy("deferred", "__o")))
        return out.where(~F.col("deferred") | (F.col("place") <= least)).drop("__o")
    schema = one.withColumn("deferred", F.lit(False)).withColumn("place", F.lit(0)).drop("__o").schema

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(__f=[o["facet_no"] for o in frame["__o"]], __r=[o["rank"] for o in frame["__o"]]).sort_values(["__f", "__r"])
        texts, counts, chosen, later = [], {}, [], []
        similar = lambda t: any(difflib.SequenceMatcher(None, t, a).ratio() >= near for a in texts)
        for row in frame.itertuples():
            t = (row.text or "").strip()
            if similar(t):
                continue
            if counts.get(row.source, 0) >= cap:
                later.append((row.Index, t))
                continue
            counts[row.source] = counts.get(row.source, 0) + 1
            texts.append(t)
            chosen.append((row.Index, False))
        for index, t in later:
            if len(chosen) >= least:
                break
            if not similar(t):
                texts.append(t)
                chosen.append((index, True))
        out = frame.loc[[i for i, _ in chosen]].assign(deferred=[d for _, d in chosen], place=range(1, len(chosen) + 1))
        return out[[f.name for f in schema]]

    return one.groupBy("keyword").applyInPandas(fold, schema)


def assemble_context(hits: DataFrame, by: str = "query_id", numbered: bool = False) -> DataFrame:
    """(by, context): the hits in order, with source lines, in tags that mark them as untrusted."""
    head = F.concat(F.lit("[source: "), F.coalesce("title", F.lit("")), F.lit(" / "), F.coalesce("url", F.lit("")), F.lit("]\n"), F.col("text"))
    if numbered:
        head = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), head)
    g = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", head.alias("t")))).alias("h"))
    return g.select(by, F.concat(F.lit("<untrusted_data>\n"), F.array_join(F.transform("h", lambda x: x["t"]), "\n\n---\n\n"), F.lit("\n</untrusted_data>")).alias("context"))


def budget_evidence(hits: DataFrame, by: str = "query_id", most: int = MAX_SOURCES, source_chars: int = MAX_SOURCE_CHARS, chars: int = MAX_CHARS) -> DataFrame:
    """(by, place, url, title, text): hits joined by post, cut to the budgets, in order of rank.

    A fold over each query's ranked hits with built-in functions: up to `most` posts, a text
    that its post already holds is skipped, pieces of a post are joined by a blank line, and the
    fold stops at the total.
    """
    url = urls.repair_url(F.col("url"))
    good = hits.withColumn("url", url).where(urls.is_absolute(F.col("url")) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    key = F.to_json(urls.source_identity(F.col("url")))
    item = F.struct("rank", key.alias("key"), "url", F.coalesce("title", F.lit("")).alias("title"), F.trim("text", F.lit(" \t\r\n")).alias("text"))
    g = good.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("hits"))
    empty = F.array().cast("array<struct<key:string,url:string,title:string,text:string>>")

    def add(state, hit):
        posts, total = state["posts"], state["total"]
        old = F.get(F.filter(posts, lambda p: p["key"] == hit["key"]), F.lit(0))
        had = F.coalesce(old["text"], F.lit(""))
        room = F.greatest(F.lit(0), F.least(F.lit(source_chars) - F.length(had), F.lit(chars) - total))
        piece = F.substring(F.concat(F.when(had != "", F.lit("\n\n")).otherwise(""), hit["text"]), F.lit(1), room)
        skip = (total >= chars) | (old.isNull() & (F.size(posts) >= most)) | ((had != "") & F.contains(had, hit["text"]))
        new = F.struct(hit["key"].alias("key"), hit["url"].alias("url"), hit["title"].alias("title"), piece.alias("text"))
        grown = F.transform(posts, lambda p: F.when(p["key"] == hit["key"], F.struct(p["key"].alias("key"), p["url"].alias("url"), p["title"].alias("title"), F.concat(p["text"], piece).alias("text"))).otherwise(p))
        after = F.when(old.isNull(), F.concat(posts, F.array(new))).otherwise(grown)
        return F.when(skip, state).otherwise(F.struct(after.alias("posts"), (total + F.length(piece)).alias("total")))

    folded = F.aggregate("hits", F.struct(empty.alias("posts"), F.lit(0).alias("total")), add, lambda s: s["posts"])
    out = g.select(by, F.posexplode(folded).alias("i", "p"))
    return out.select(by, (F.col("i") + 1).alias("place"), "p.url", "p.title", "p.text").where("text <> ''")


def supplement_evidence(evidence: DataFrame, web: DataFrame, due: DataFrame, by: str = "query_id", least_score: float = 0.3, least_chars: int = 500) -> DataFrame:
    """Thin queries get good web results before their own evidence; all is budgeted again."""
    keyword = F.contains(tx.normalize(F.concat_ws(" ", "title", "text"), False), tx.normalize(F.col("keyword"), False))
    fit = web.where((F.col("score") >= least_score) & urls.is_content(F.col("url")) & urls.is_absolute(F.col("url")) & keyword & (F.length("text") >= least_chars))
    more = fit.join(due.select(by), by, "left_semi").select(by, (F.col("rank") - 1_000_000).alias("rank"), "url", "title", "text")
    return budget_evidence(evidence.select(by, F.col("place").alias("rank"), "url", "title", "text").unionByName(more), by)


def analysis_sources(evidence: DataFrame, by: str = "query_id") -> DataFrame:
    item = F.struct("place", tx.soften_profanity(F.col("title")).alias("title"), urls.repair_url(F.col("url")).alias("url"))
    return evidence.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("sources"))


def build_points(chunks: DataFrame, encoder, most: int = 1024, most_bytes: int = 4 << 20) -> DataFrame:
    """Vector rows: encoder maps a list of texts to (dense vectors, sparse maps). A call has `most` texts and most_bytes of them at most (one text, if that has more), so neither a task's memory nor a call grows with the table or its texts."""
    rest = [f for f in chunks.schema if f.name != "encoding_text"]
    fields = StructType([*rest, StructField("dense", ArrayType(FloatType())), StructField("sparse", MapType(IntegerType(), FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(fields)
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b["encoding_text"]), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < b.num_rows:
                room = np.searchsorted(ends, (ends[first - 1] if first else 0) + most_bytes, side="right")
                last = min(max(first + 1, int(room)), first + most, b.num_rows)
                part = b.slice(first, last - first)
                dense, sparse = encoder(part["encoding_text"].to_pylist())
                made = [pa.array(dense, schema.field("dense").type), pa.array([None if m is None else list(m.items()) for m in sparse], schema.field("sparse").type)]
                yield pa.RecordBatch.from_arrays([*(part[f.name].cast(schema.field(f.name).type) for f in rest), *made], schema=schema)
                first = last

    return chunks.mapInArrow(run, fields)
