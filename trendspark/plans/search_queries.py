"""Queries of chunking, near-duplicate, retrieval, evaluation and stream operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.functions import text
from trendspark.functions.lineage import checkpoint, scratch
from trendspark.operators import chunks, dedup, evaluation, retrieval
from trendspark.plans.common import channel_of, daily_sql, table
from trendspark.plans.text_queries import HOST, KEYWORDS, NORM, ORACLE_CLEAN, PATH, POSTS, posts
from trendspark.sources import io
from trendspark.streaming import jobs

QUERIES, ORACLES = {}, {}
r6 = lambda c: F.round(F.col(c), 6).alias(c)
K = 5


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ------------------------------------------------------------------ chunks

WINDOWS = "win as (select doc_id, i::int as piece_index, substr(text, i * 450 + 1, 500) as chunk from (select doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 50) / 450)::int))) as i from documents where length(text) > 0))"


def windows(spark, d):
    return chunks.chunk_windows(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("t07_chunk_windows", f"with {WINDOWS} select * from win")
def t07(spark, d):
    return windows(spark, d)


def _level_sql(k: int, sep: str) -> str:
    """Pieces of the texts of level k, and a recursion from chunk to chunk: the next one starts at the first piece that leaves room for the piece after the last."""
    own = "p.id = {0}.id and p.path = {0}.path and p.run = {0}.run"
    return f"""
lu{k} as (select id, path, unnest(string_split(text, {sep})) as part, generate_subscripts(string_split(text, {sep}), 1) as i from lt{k}),
lv{k} as (select id, path, i, case when i = 1 then part else {sep} || part end as piece from lu{k}),
lw{k} as (select id, path, i, piece, length(piece) as n, (sum(length(piece)) over (partition by id, path order by i))::int as e, length(piece) >= 500 as deep from lv{k} where piece <> ''),
lp{k} as (select *, e - n as s, coalesce(sum(deep::int) over (partition by id, path order by i rows between unbounded preceding and 1 preceding), 0)::int as run from lw{k}),
lt{k + 1} as (select id, list_append(path, s) as path, piece as text from lp{k} where deep),
la{k} as (select id, path, run, min(s) as s from lp{k} where not deep group by all),
lf{k} as (
  select a.id, a.path, a.run, a.s, max(p.e) as e from la{k} a join lp{k} p on {own.format('a')} and not p.deep and p.e <= a.s + 500 group by all
  union all
  select x.id, x.path, x.run, x.s, max(p.e) from (
    select f.id, f.path, f.run, min(p.s) as s from lf{k} f join lp{k} nx on nx.id = f.id and nx.path = f.path and nx.run = f.run and not nx.deep and nx.s = f.e
    join lp{k} p on {own.format('f')} and not p.deep and p.s between greatest(f.s, f.e - least(50, 500 - nx.n)) and f.e group by f.id, f.path, f.run, f.e) x
  join lp{k} p on {own.format('x')} and not p.deep and p.s >= x.s and p.e <= x.s + 500 group by x.id, x.path, x.run, x.s),
lc{k} as (select f.id, list_append(f.path, f.s) as path, substr(t.text, f.s + 1, f.e - f.s) as chunk from lf{k} f join lt{k} t on t.id = f.id and t.path = f.path)"""


def recursive_sql(source: str) -> str:
    """Tables that end in pieces(id, piece_index, chunk); source: the text of a table (id, text)."""
    seps = ["chr(10) || chr(10)", "chr(10)", "'. '", "' '"]
    white = " || ".join(f"chr({ord(c)})" for c in chunks.WHITE)
    return f"""lt0 as (select id, []::int[] as path, text from ({source}) where length(text) > 0),{','.join(_level_sql(k, s) for k, s in enumerate(seps))},
lc4 as (select id, list_append(path, i::int) as path, substr(text, i * 450 + 1, 500) as chunk from (select *, unnest(range(0, greatest(1, ceil((length(text) - 50) / 450)::int))) as i from lt4)),
pieces as (select id, row_number() over (partition by id order by path)::int - 1 as piece_index, trim(chunk, {white}) as chunk from ({' union all '.join(f'select * from lc{k}' for k in range(5))}) where trim(chunk, {white}) <> '')"""


@query("t07_chunk_recursive", f"with recursive {recursive_sql('select doc_id as id, text from documents')} select id as doc_id, piece_index, chunk from pieces")
def t07r(spark, d):
    return chunks.chunk_recursive(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("t08_drop_and_number", f"with {WINDOWS} select doc_id as parent_id, row_number() over (partition by doc_id order by piece_index)::int - 1 as chunk_index, chunk from win where length(trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 30")
def t08(spark, d):
    return chunks.drop_and_number(windows(spark, d).withColumnRenamed("doc_id", "parent_id"), ["piece_index"]).select("parent_id", "chunk_index", "chunk")


@query("m12_process_documents", f"""with {POSTS}, raw as (select doc_id, body from posts), {ORACLE_CLEAN},
win as (select doc_id, i::int as i, substr(clean_content, i * 450 + 1, 500) as chunk from (select doc_id, clean_content, unnest(range(0, greatest(1, ceil((length(clean_content) - 50) / 450)::int))) as i from cleaned where length(clean_content) > 0)),
n as (select c.doc_id, {NORM.format(c='keyword')} as k, {NORM.format(c='title')} as t, {NORM.format(c='clean_content')} as b from cleaned c join posts using (doc_id))
select doc_id as parent_id, row_number() over (partition by doc_id order by i)::int - 1 as chunk_index, chunk, contains(t, k) or contains(b, k) as is_relevant,
  case when contains(t, k) then 'title' when not contains(b, k) then 'none' when strpos(b, k) - 1 < 200 then 'early' else 'late' end as relevance_position
from win join n using (doc_id) where length(trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 30""")
def m12(spark, d):
    p = posts(spark, d).select(F.col("doc_id").alias("_id"), "keyword", "source", F.lit("").alias("url"), "title", F.col("body").alias("content"))
    return chunks.process_documents(p, recursive=False, nfc=False).select("parent_id", "chunk_index", "chunk", "is_relevant", "relevance_position")


@query("m12_process_documents_default", f"""with recursive {POSTS}, raw as (select doc_id, body from posts), {ORACLE_CLEAN},
{recursive_sql('select doc_id as id, clean_content as text from cleaned')},
n as (select c.doc_id, {NORM.format(c='keyword')} as k, {NORM.format(c='title')} as t, {NORM.format(c='clean_content')} as b from cleaned c join posts using (doc_id))
select doc_id as parent_id, row_number() over (partition by doc_id order by piece_index)::int - 1 as chunk_index, chunk, contains(t, k) or contains(b, k) as is_relevant,
  case when contains(t, k) then 'title' when not contains(b, k) then 'none' when strpos(b, k) - 1 < 200 then 'early' else 'late' end as relevance_position
from pieces join n on n.doc_id = pieces.id where length(trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 30""")
def m12_default(spark, d):
    p = posts(spark, d).select(F.col("doc_id").alias("_id"), "keyword", "source", F.lit("").alias("url"), "title", F.col("body").alias("content"))
    return chunks.process_documents(p).select("parent_id", "chunk_index", "chunk", "is_relevant", "relevance_position")


# ------------------------------------------------------------------ near duplicates


@query("d02_drop_near_duplicates")
def d02(spark, d):
    k = F.element_at(F.array(*map(F.lit, KEYWORDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    c = windows(spark, d).select(k.alias("keyword"), (F.col("doc_id") * 1_000_000 + F.col("piece_index")).alias("seq"), F.col("doc_id").alias("parent_id"), F.col("chunk").alias("text"))
    bench = table(spark, d, "benchmark").select(F.col("item_id"), F.col("text"))
    old = bench.select(F.element_at(F.array(*map(F.lit, KEYWORDS)), (F.col("item_id") % 6 + 1).cast("int")).alias("keyword"), (-F.col("item_id") - 1).alias("parent_id"), "text")
    return dedup.drop_near_duplicates(c, old).select("keyword", "seq", "parent_id")


# ------------------------------------------------------------------ retrieval

BASE = """ch as (select vec_id as chunk_id, 'label' || e.label as keyword, embedding::double[] as vec, d.source, split_part(d.text, chr(10), 1) as title, 'https://' || d.source || '.example/' || (vec_id // 2) as url, d.text
  from embeddings e join documents d on d.doc_id = e.vec_id),
q as (select 'q_' || chunk_id as query_id, keyword, vec, text from ch where chunk_id % 50 = 0),
post as (select chunk_id, keyword, token, count(*)::double as weight from (select chunk_id, keyword, unnest(string_split(lower(replace(text, chr(10), ' ')), ' ')) as token from ch) where length(token) >= 4 group by all),
qs as (select 'q_' || chunk_id as query_id, keyword, token, weight from post where chunk_id % 50 = 0),
ds as (select query_id, chunk_id, list_dot_product(q.vec, ch.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(ch.vec, ch.vec))) as score from q, ch),
dense as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from ds) where rank <= 30),
ss as (select query_id, chunk_id, sum(qs.weight * post.weight) as score from qs join post using (token) group by all),
sparse as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ss) where rank <= 30),
fs as (select query_id, chunk_id, sum(1 / (60 + rank)) as score from (select query_id, chunk_id, rank from dense union all select query_id, chunk_id, rank from sparse) group by all),
fused as (select * from (select *, row_number() over (partition by query_id order by round(score, 12) desc, chunk_id) as rank from fs) where rank <= 15),
good as (select f.*, ch.source, ch.title, ch.url, ch.text from fused f join ch using (chunk_id) where length(trim(ch.text)) >= 30),
capped as (select *, row_number() over (partition by query_id, source order by rank) > 1 as over from good),
hybrid as (select * from (select *, row_number() over (partition by query_id order by over, rank) as place from capped) where place <= 5)"""


def base(spark, d):
    """(chunks, queries, postings, sparse queries): vectors with the text of the document of the same id; every one with an id divisible by 50 is a query."""
    e, doc = table(spark, d, "embeddings"), table(spark, d, "documents")
    c = e.join(doc, e.vec_id == doc.doc_id).select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("keyword"), F.col("embedding").cast("array<double>").alias("vec"), "source",
        F.substring_index("text", "\n", 1).alias("title"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.floor(F.col("vec_id") / 2).cast("string")).alias("url"), "text",
    )
    name = F.concat(F.lit("q_"), F.col("chunk_id").cast("string")).alias("query_id")
    q = c.where("chunk_id % 50 = 0").select(name, "keyword", "vec", "text")
    tokens = c.select("chunk_id", "keyword", F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("token"))
    p = tokens.where(F.length("token") >= 4).groupBy("chunk_id", "keyword", "token").agg(F.count("*").cast("double").alias("weight"))
    return c, q, p, p.where("chunk_id % 50 = 0").select(name, "keyword", "token", "weight")


def dense(spark, d, k=30, within=None):
    c, q, _, _ = base(spark, d)
    return retrieval.dense_topk(q, c, k, within)


def sparse(spark, d, k=30, within=None):
    _, _, p, qs = base(spark, d)
    return retrieval.sparse_topk(qs, p, k, within)


def hybrid(spark, d, cap=1):
    c, q, p, qs = base(spark, d)
    return retrieval.hybrid_search(q, qs, c, p, K, F.length(F.trim("text")) >= 30, cap=cap, within=None)


@query("r01_dense_within_keyword", f"with {BASE}, kd as (select query_id, chunk_id, list_dot_product(q.vec, ch.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(ch.vec, ch.vec))) as score from q join ch using (keyword)), kr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from kd) select query_id, chunk_id, round(score, 6) as score, rank::int as rank from kr where rank <= 30")
def r01k(spark, d):
    return dense(spark, d, within="keyword").select("query_id", "chunk_id", r6("score"), "rank")


@query("r02_sparse_within_keyword", f"with {BASE}, ks as (select query_id, chunk_id, sum(qs.weight * post.weight) as score from qs join post using (keyword, token) group by all), kr as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ks) select query_id, chunk_id, score, rank::int as rank from kr where rank <= 30")
def r02k(spark, d):
    return sparse(spark, d, within="keyword")


@query("r01_dense_topk", f"with {BASE} select query_id, chunk_id, round(score, 6) as score, rank::int as rank from dense")
def r01(spark, d):
    return dense(spark, d).select("query_id", "chunk_id", r6("score"), "rank")


@query("r02_sparse_topk", f"with {BASE} select query_id, chunk_id, score, rank::int as rank from sparse")
def r02(spark, d):
    return sparse(spark, d)


@query("r03_rrf_fuse", f"with {BASE} select query_id, chunk_id, round(score, 9) as score, rank::int as rank from fused")
def r03(spark, d):
    return retrieval.rrf_fuse([dense(spark, d), sparse(spark, d)], 15).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("r04_min_dense_score", f"with {BASE} select query_id, chunk_id, round(coalesce(d.score, 0), 6) as dense_score from fused f left join dense d using (query_id, chunk_id) where coalesce(d.score, 0) >= 0.1")
def r04(spark, d):
    de = dense(spark, d)
    return retrieval.min_dense_score(retrieval.rrf_fuse([de, sparse(spark, d)], 15), de, 0.1).select("query_id", "chunk_id", r6("dense_score"))


@query("r05_hybrid_search", f"with {BASE} select query_id, chunk_id, place::int as place from hybrid")
def r05(spark, d):
    return hybrid(spark, d).select("query_id", "chunk_id", "place")


@query("w03_topk_with_cap", f"with {BASE}, c as (select *, row_number() over (partition by query_id, source order by rank) > 2 as ov from good), p as (select *, row_number() over (partition by query_id order by ov, rank) as place from c) select query_id, chunk_id, place::int as place from p where place <= 8")
def w03(spark, d):
    c, _, _, _ = base(spark, d)
    good = retrieval.rrf_fuse([dense(spark, d), sparse(spark, d)], 15).join(c.drop("vec"), "chunk_id").where("length(trim(text)) >= 30")
    return retrieval.topk_with_cap(good, 8, 2).select("query_id", "chunk_id", "place")


FACET_SQL = f"""{BASE}, fq as (select kq.*, i - 1 as facet_no, f.facet from (select distinct keyword from ch) kq, (values (1, 'meaning'), (2, 'why_popular'), (3, 'usage'), (4, 'who')) f(i, facet)),
fsr as (select fq.keyword, facet_no, facet, chunk_id, ch.source, ch.title, ch.url, ch.text, row_number() over (partition by fq.keyword, facet_no order by md5(facet || chunk_id)) as rank from fq join ch using (keyword)),
hits as (select * from fsr where rank <= 5)"""


def facet_hits(spark, d):
    """Five hits for each facet of each keyword, in an order that differs by facet."""
    c, _, _, _ = base(spark, d)
    f = retrieval.facet_queries(c.select(F.concat(F.lit("q_"), "keyword").alias("query_id"), "keyword").distinct())
    scored = f.join(c.drop("vec"), "keyword").withColumn("o", F.md5(F.concat("facet", F.col("chunk_id").cast("string"))))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("o"))
    return scored.withColumn("rank", rank).where("rank <= 5").drop("o", "query_id")


@query("r06_facet_search", f"with {FACET_SQL} select keyword, facet, chunk_id, rank::int as rank from hits")
def r06(spark, d):
    return facet_hits(spark, d).select("keyword", "facet", "chunk_id", "rank")


MERGE_SQL = f"""{FACET_SQL}, one as (select keyword, chunk_id, min(facet_no * 100 + rank) as o, any_value(source) as source, any_value(title) as title, any_value(url) as url, any_value(text) as text, string_agg(facet, ',' order by facet) as facets from hits group by all),
df as (select *, row_number() over (partition by keyword, source order by o) > 1 as deferred from one), mg as (select *, row_number() over (partition by keyword order by deferred, o) as place from df), merged as (select * from mg where not deferred or place <= 8)"""


@query("r07_merge_facets", f"with {MERGE_SQL} select keyword, chunk_id, facets, deferred, place::int as place from merged")
def r07(spark, d):
    return retrieval.merge_facets(facet_hits(spark, d), cap=1).select("keyword", "chunk_id", F.concat_ws(",", "facets").alias("facets"), "deferred", "place")


@query("r07_merge_facets_near_dup")
def r07n(spark, d):
    return retrieval.merge_facets(facet_hits(spark, d), cap=3, near=0.8).select("keyword", "chunk_id", "deferred", "place")


@query("r08_assemble_context", f"""with {BASE} select query_id, '<untrusted_data>' || chr(10) || string_agg('[' || place || '] [source: ' || title || ' / ' || url || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place) || chr(10) || '</untrusted_data>' as context from hybrid group by query_id""")
def r08(spark, d):
    return retrieval.assemble_context(hybrid(spark, d), numbered=True)


BUDGET_SQL = f"""{BASE}, bg as (select query_id, rank, url, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text, row_number() over (partition by query_id order by rank) as i from (select query_id, chunk_id, rank from dense) join ch using (chunk_id) where trim(text) <> ''),
fold(query_id, i, urls, texts, total) as (
  select query_id, 0, []::varchar[], []::varchar[], 0 from (select distinct query_id from bg)
  union all
  select query_id, i2, case when skip or p0 is not null then urls else list_append(urls, url) end,
    case when skip then texts when p0 is null then list_append(texts, piece) else list_transform(texts, lambda x, j: case when j = p0 then x || piece else x end) end, case when skip then total else total + length(piece) end
  from (select *, left(case when had <> '' then chr(10) || chr(10) else '' end || text, greatest(0, least(1800 - length(had), 8000 - total))) as piece,
      total >= 8000 or (p0 is null and len(urls) >= 6) or (had <> '' and contains(had, text)) as skip
    from (select f.query_id, b.i as i2, urls, texts, total, b.url, b.text, list_position(urls, b.url) as p0, coalesce(texts[list_position(urls, b.url)], '') as had from fold f join bg b on b.query_id = f.query_id and b.i = f.i + 1))),
last as (select * from fold qualify row_number() over (partition by query_id order by i desc) = 1),
ev as (select query_id, unnest(range(1, len(urls) + 1))::int as place, urls, texts from last), evidence as (select query_id, place, urls[place] as url, texts[place] as text from ev where texts[place] <> '')"""


def _evidence(spark, d):
    c, _, _, _ = base(spark, d)
    return retrieval.budget_evidence(dense(spark, d).select("query_id", "chunk_id", "rank").join(c.drop("vec"), "chunk_id"))


@query("r09_budget_evidence", f"with recursive {BUDGET_SQL} select * from evidence")
def r09(spark, d):
    return _evidence(spark, d).select("query_id", "place", "url", "text")


#: A second fold, over the evidence of thin queries with the fitting pages before it; posts are told by host, path and query of their links.
SUPPLEMENT_SQL = f"""{BUDGET_SQL}, due as (select query_id from evidence group by 1 having sum(length(text)) < 7900 or max(length(text)) < 500),
web as (select 'q_' || (page_id % 10 * 50) as query_id, page_id % 100 / 100 as score, page_id as rank, url, regexp_replace(html, '<[^>]+>', ' ', 'g') as text from pages),
more as (select query_id, rank - 1000000 as rank, url, text from web where score >= 0.3 and regexp_matches(url, '^(?i:https?)://[^/?#]+') and contains({NORM.format(c='text')}, 'the') and length(text) >= 500 and query_id in (select query_id from due)),
items as (select *, row_number() over (partition by query_id order by rank) as i, {HOST.format(u='url')} || '|' || regexp_replace({PATH.format(u='url')}, '/+$', '') || '|' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as key
  from (select query_id, rank, trim(url) as url, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text from (select query_id, place as rank, url, text from evidence union all select * from more)) where trim(text) <> ''),
fold2(query_id, i, keys, urls, texts, total) as (
  select query_id, 0, []::varchar[], []::varchar[], []::varchar[], 0 from (select distinct query_id from items)
  union all
  select query_id, i2, case when skip or p0 is not null then keys else list_append(keys, key) end, case when skip or p0 is not null then urls else list_append(urls, url) end,
    case when skip then texts when p0 is null then list_append(texts, piece) else list_transform(texts, lambda x, j: case when j = p0 then x || piece else x end) end, case when skip then total else total + length(piece) end
  from (select *, left(case when had <> '' then chr(10) || chr(10) else '' end || text, greatest(0, least(1800 - length(had), 8000 - total))) as piece,
      total >= 8000 or (p0 is null and len(urls) >= 6) or (had <> '' and contains(had, text)) as skip
    from (select f.query_id, b.i as i2, keys, urls, texts, total, b.key, b.url, b.text, list_position(keys, b.key) as p0, coalesce(texts[list_position(keys, b.key)], '') as had from fold2 f join items b on b.query_id = f.query_id and b.i = f.i + 1))),
last2 as (select * from fold2 qualify row_number() over (partition by query_id order by i desc) = 1),
ev2 as (select query_id, unnest(range(1, len(urls) + 1))::int as place, urls, texts from last2)"""


@query("r10_supplement_evidence", f"with recursive {SUPPLEMENT_SQL} select query_id, place, urls[place] as url, length(texts[place])::int as n_chars from ev2 where texts[place] <> ''")
def r10(spark, d):
    from trendspark.operators import tables

    ev = _evidence(spark, d)
    due = tables.needs_evidence(ev, ["query_id"], 7900, 500).where("due")
    web = table(spark, d, "pages").select(
        F.concat(F.lit("q_"), (F.col("page_id") % 10 * 50).cast("string")).alias("query_id"), F.lit("the").alias("keyword"), (F.col("page_id") % 100 / 100).alias("score"), F.col("page_id").alias("rank"), "url", F.lit("").alias("title"), F.regexp_replace("html", "<[^>]+>", " ").alias("text"))
    return retrieval.supplement_evidence(ev, web, due).select("query_id", "place", "url", F.length("text").alias("n_chars"))


@query("r11_analysis_sources", f"with recursive {BUDGET_SQL}, t as (select ev.*, (select title from ch where ch.url = ev.url order by chunk_id limit 1) as x from evidence ev) select query_id, string_agg(url, ',' order by place) as urls from t group by 1")
def r11(spark, d):
    s = retrieval.analysis_sources(_evidence(spark, d))
    return s.select("query_id", F.array_join(F.transform("sources", lambda x: x["url"]), ",").alias("urls"))


# ------------------------------------------------------------------ evaluation

EVAL = f"""{BASE}, ranked as (select query_id, 'dense' as method, chunk_id, rank from dense where rank <= 5 union all select query_id, 'sparse', chunk_id, rank from sparse where rank <= 5 union all select query_id, 'hybrid', chunk_id, place from hybrid),
grades as (select query_id, chunk_id, quality + 1 - toxic as rel from q join ch using (keyword) join labels l on l.doc_id = chunk_id),
graded as (select r.*, coalesce(rel, 0) as rel from ranked r left join grades using (query_id, chunk_id)),
ideal as (select query_id, sum(rel / log2(rn + 1)) as ideal, sum((2 ** rel - 1) / log2(rn + 1)) as ideal_exp from (select *, row_number() over (partition by query_id order by rel desc, chunk_id) as rn from grades) where rn <= 5 group by 1),
pq as (select query_id, method, sum((rel >= 2)::int) / 5 as p2, sum((rel >= 1)::int) / 5 as p1, sum(rel) / 5 as mean_rel, coalesce(1 / min(rank) filter (rel >= 2), 0) as mrr, coalesce(1 / min(rank) filter (rel >= 1), 0) as mrr1,
  coalesce(sum(rel / log2(rank + 1)) / nullif(any_value(ideal), 0), 0) as ndcg, coalesce(sum((2 ** rel - 1) / log2(rank + 1)) / nullif(any_value(ideal_exp), 0), 0) as ndcg_exp
  from graded left join ideal using (query_id) group by all)"""


def ranked(spark, d):
    """Results of three methods; the two searches run once, deep enough for the fused one, and their lists are written."""
    one = lambda df, m, r: df.where(F.col(r) <= K).select("query_id", F.lit(m).alias("method"), "chunk_id", F.col(r).alias("rank"))
    c, _, _, _ = base(spark, d)
    de, sp = checkpoint(dense(spark, d)), checkpoint(sparse(spark, d))
    good = retrieval.rrf_fuse([de, sp], 15).join(c.drop("vec"), "chunk_id").where(F.length(F.trim("text")) >= 30)
    return checkpoint(one(de, "dense", "rank").unionByName(one(sp, "sparse", "rank")).unionByName(one(retrieval.topk_with_cap(good, K, 1), "hybrid", "place")))


def labelled(spark, d):
    """(queries, graded chunks): a chunk's grade counts for all queries of its keyword."""
    c, q, _, _ = base(spark, d)
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") + 1 - F.col("toxic")).alias("rel"))
    return q.select("query_id", "keyword"), c.select("chunk_id", "keyword").join(labels, "chunk_id")


def graded(spark, d):
    r = ranked(spark, d)
    return evaluation.grade_results(r, evaluation.grades_of(r, *labelled(spark, d)))


def ideals(spark, d):
    return evaluation.best_grades(*labelled(spark, d), K)


@query("j14_grade_results", f"with {EVAL} select query_id, method, chunk_id, rank::int as rank, rel from graded")
def j14(spark, d):
    return graded(spark, d)


@query("e01_precision_at_k", f"with {EVAL} select query_id, method, p2 as precision from pq")
def e01(spark, d):
    return graded(spark, d).groupBy("query_id", "method").agg(evaluation.precision_at_k(K).alias("precision"))


@query("e02_mean_relevance_at_k", f"with {EVAL} select query_id, method, mean_rel from pq")
def e02(spark, d):
    return graded(spark, d).groupBy("query_id", "method").agg(evaluation.mean_relevance_at_k(K).alias("mean_rel"))


@query("e03_ndcg_at_k", f"with {EVAL} select query_id, method, round(ndcg, 6) as ndcg from pq")
def e03(spark, d):
    return evaluation.ndcg_at_k(graded(spark, d), ideals(spark, d), K).select("query_id", "method", r6("ndcg"))


@query("e04_mrr", f"with {EVAL} select query_id, method, round(mrr, 6) as mrr from pq")
def e04(spark, d):
    return graded(spark, d).groupBy("query_id", "method").agg(evaluation.mrr().alias("mrr")).select("query_id", "method", r6("mrr"))


@query("e05_paired_bootstrap", """with x as (select doc_id, quality - toxic * 0.5 - 0.4 as diff, row_number() over (order by doc_id) - 1 as pos from labels), n as (select count(*) as n from labels),
pick as (select b, ('0x' || substr(md5('0:' || b || ':' || i), 1, 8))::bigint % n as pos from n, range(200) r(b), lateral (select unnest(range(n)) as i) t), m as (select b, avg(diff) as m from pick join x using (pos) group by b),
o as (select list(m order by m) as ms from m)
select (select n from n) as n, round((select avg(diff) from x), 6) as mean_diff, round(ms[5 + 1], 6) as ci_low, round(ms[195 + 1], 6) as ci_high, (select count(*) from x where diff > 0) as wins, ms[6] > 0 or ms[196] < 0 as significant from o""")
def e05(spark, d):
    l = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), (F.col("quality") - F.col("toxic") * 0.5 - 0.4).alias("diff"))  # noqa: E741
    return evaluation.paired_bootstrap(l, 200).select("n", r6("mean_diff"), r6("ci_low"), r6("ci_high"), "wins", "significant")


@query("e06_method_summary", f"""with {EVAL}, lat as (select *, 100 + ('0x' || substr(md5(query_id || method), 1, 4))::bigint % 900 + 0.0 as l from pq)
select method, round(avg(p2), 6) as precision, round(avg(mean_rel), 6) as mean_rel, round(avg(ndcg), 6) as ndcg, round(avg(mrr), 6) as mrr, quantile_cont(l, 0.5)::double as latency_median, list(l order by l)[round_even(0.95 * (count(*) - 1), 0)::int + 1]::double as latency_p95 from lat group by method""")
def e06(spark, d):
    per = evaluation.per_query(graded(spark, d), ideals(spark, d), K)
    ms = (100 + F.conv(F.substring(F.md5(F.concat("query_id", "method")), 1, 4), 16, 10).cast("long") % 900).cast("double")
    return evaluation.method_summary(per.withColumn("latency_ms", ms)).select("method", r6("precision"), r6("mean_rel"), r6("ndcg"), r6("mrr"), "latency_median", "latency_p95")


@query("e07_method_overlap", f"""with {EVAL}, s as (select query_id, method, list(chunk_id) as ids from ranked group by all)
select a.method as a, b.method as b, round(avg(len(list_intersect(a.ids, b.ids)) / greatest(1, len(list_distinct(list_concat(a.ids, b.ids))))), 6) as overlap from s a join s b on a.query_id = b.query_id and a.method < b.method group by all""")
def e07(spark, d):
    return evaluation.method_overlap(ranked(spark, d)).select("a", "b", r6("overlap"))


@query("d07_jaccard", f"""with {EVAL}, s as (select query_id, method, list(chunk_id) as ids from ranked group by all)
select a.query_id, round(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))), 6) as overlap from s a join s b on a.query_id = b.query_id and a.method = 'dense' and b.method = 'sparse'""")
def d07(spark, d):
    ids = ranked(spark, d).groupBy("query_id").agg(*[F.collect_set(F.when(F.col("method") == m, F.col("chunk_id"))).alias(m) for m in ("dense", "sparse")])
    return ids.where("size(dense) > 0 and size(sparse) > 0").select("query_id", F.round(dedup.jaccard(F.col("dense"), F.col("sparse")), 6).alias("overlap"))


@query("e08_sensitivity", f"""with {EVAL}, m as (select method, avg(p1) as precision_1, avg(p2) as precision_2, avg(mrr1) as mrr_1, avg(mrr) as mrr_2, avg(ndcg) as ndcg_linear, avg(ndcg_exp) as ndcg_exp from pq group by 1),
u as (unpivot m on precision_1, precision_2, mrr_1, mrr_2, ndcg_linear, ndcg_exp into name k value v) select method, split_part(k, '_', 1) as metric, split_part(k, '_', 2) as setting, round(v, 6) as "value" from u""")
def e08(spark, d):
    return evaluation.sensitivity(graded(spark, d), ideals(spark, d), K).select("method", "metric", "setting", r6("value"))


@query("e09_compare_methods", f"with {EVAL} select query_id, method, p2 as precision, mean_rel, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg from pq")
def e09(spark, d):
    return evaluation.per_query(graded(spark, d), ideals(spark, d), K).select("query_id", "method", "precision", "mean_rel", r6("mrr"), r6("ndcg"))


@query("e10_pending_grades", f"with {EVAL} select distinct query_id, chunk_id, md5('m|' || md5('grade') || '|' || query_id || '|' || chunk_id) as key from ranked where chunk_id % 2 = 0")
def e10(spark, d):
    pool = ranked(spark, d).select("query_id", "chunk_id").distinct()
    cache = pool.where("chunk_id % 2 = 1").select(evaluation.grade_key("m", "grade").alias("key"), F.lit(1).alias("score"))
    return evaluation.pending_grades(pool, cache, "m", "grade")[0]


# ------------------------------------------------------------------ streams, as the same functions give them in batch


@query("st02_first_of_id", "select distinct user_id from events")
def st02(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.first_of_id(e, "ts", "2 days", "user_id").select("user_id")


@query("st03_daily_mentions", f"with {daily_sql()} select * from daily")
def st03(spark, d):
    e = table(spark, d, "events").where(channel_of(F.col("event_type")).isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.daily_mentions(e, F.concat(F.lit("kw"), (F.col("user_id") % 6).cast("string")), channel_of(F.col("event_type")))


@query("st04_gate_against", "select event_id from events where user_id not in (select user_id from events where event_type = 'error' and value > 95)")
def st04(spark, d):
    e = table(spark, d, "events")
    return jobs.gate_against(e, e.where("event_type = 'error' and value > 95"), ["user_id"]).select("event_id")


@query("st05_flag_bursts", """with recursive h as (select (user_id % 20)::varchar as key, epoch_us(ts::timestamp) as hit, row_number() over (partition by user_id % 20 order by ts) as i from events),
f as (
  select distinct key, 0::bigint as i, null::bigint as hit, null::boolean as accepted, []::bigint[] as recent from h
  union all
  select key, i, hit, len(recent) < 5, case when len(recent) < 5 then list_append(recent, hit) else recent end
  from (select h.key, h.i, h.hit, list_filter(f.recent, lambda r: r > h.hit - 3600000000) as recent from f join h on h.key = f.key and h.i = f.i + 1))
select key, hit, accepted from f where i > 0""")
def st05(spark, d):
    out = jobs.flag_bursts(table(spark, d, "events").select((F.col("user_id") % 20).alias("key"), "ts"), 5, 3600)
    return out.select("key", F.unix_micros("ts").alias("hit"), "accepted")


@query("st01_replayed_batches", f"""with {POSTS}, raw as (select doc_id, body from posts), {ORACLE_CLEAN},
win as (select doc_id, i::int as i, substr(clean_content, i * 450 + 1, 500) as chunk from (select doc_id, clean_content, unnest(range(0, greatest(1, ceil((length(clean_content) - 50) / 450)::int))) as i from cleaned where length(clean_content) > 0))
select doc_id as parent_id, row_number() over (partition by doc_id order by i)::int - 1 as chunk_index, chunk
from win where length(trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 30 and doc_id % 5 <> 0""")
def st01(spark, d):
    """Two micro-batches and a compaction: the first has old texts of every document with an even id, the second the true ones of all, and none of every fifth; the second comes twice."""
    p = posts(spark, d).select(F.col("doc_id").alias("_id"), "keyword", "source", F.lit("").alias("url"), "title", F.col("body").alias("content"))
    out = scratch(spark)
    jobs.commit_chunks(p.where("_id % 2 = 0").withColumn("content", F.concat(F.lit("an older version of this text: "), "content")), 0, out, False, False)
    jobs.compact_chunks(spark, out)
    second = p.withColumn("content", F.when(F.col("_id") % 5 == 0, "").otherwise(F.col("content")))
    for _ in range(2):
        jobs.commit_chunks(second, 1, out, False, False)
    return jobs.latest_chunks(spark, out).select("parent_id", "chunk_index", "chunk")


# ------------------------------------------------------------------ files, read back from where they were written


@query("s02_fixture_round_trip", "select 'd' || doc_id as _id, lang as keyword, source, text as content, (1700000000 + doc_id * 86400)::bigint as published, doc_id % 3 = 0 as is_embedded from documents where lang = 'en'")
def s02(spark, d):
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("_id"), F.col("lang").alias("keyword"), "source", F.lit(None).cast("string").alias("url"), F.lit("").alias("title"), F.col("text").alias("content"),
        F.lit(None).cast("double").alias("score"), F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 86_400).alias("published_date"), F.lit(None).cast("timestamp").alias("crawled_at"), (F.col("doc_id") % 3 == 0).alias("is_embedded"),
    )
    at = scratch(spark)
    for _ in range(2):  # a second dump replaces the first
        io.write_fixture(docs, at, keyword="en")
    return io.read_fixture(spark, at).select("_id", "keyword", "source", "content", F.unix_seconds("published_date").alias("published"), "is_embedded")


@query("s03_keyword_lines", "select trim(source) || doc_id as keyword from documents where doc_id % 3 = 0")
def s03(spark, d):
    name = F.concat("source", F.col("doc_id").cast("string"))
    lines = F.array(F.concat(F.lit("  "), name, F.lit(" ")), F.lit("   "), F.concat(F.lit("# "), name))
    at = scratch(spark)
    table(spark, d, "documents").select(F.get(lines, (F.col("doc_id") % 3).cast("int")).alias("line")).write.text(at)
    return io.read_keywords(spark, at, comments=True)


@query("s10_metrics_round_trip", f"with {EVAL} select query_id, method, p2 as precision, mean_rel, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg from pq")
def s10(spark, d):
    at, metrics = scratch(spark), checkpoint(e09(spark, d))
    for _ in range(2):
        io.write_metrics(metrics, at)
    return spark.read.schema("query_id string, method string, precision double, mean_rel double, mrr double, ndcg double").option("header", True).csv(at)


@query("s12_appended_runs", """select run_id, 'k=' || k as config, count(*) as n_docs, sum(length(text)) as n_chars from documents, (values ('2024-01-01T00:00', 5), ('2024-01-02 run/b', 7)) r(run_id, k)
where doc_id % k = 0 group by all""")
def s12(spark, d):
    at = scratch(spark)
    docs = table(spark, d, "documents")
    for run_id, k in (("2024-01-01T00:00", 5), ("2024-01-02 run/b", 7), ("2024-01-01T00:00", 5)):  # the first is tried twice
        one = docs.where(F.col("doc_id") % k == 0).agg(F.lit(f"k={k}").alias("config"), F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))
        io.append_run(one, at, run_id)
    return io.read_runs(spark, at, "config string, n_docs bigint, n_chars bigint").select("run_id", "config", "n_docs", "n_chars")


@query("s07_build_points")
def s07(spark, d):
    def encoder(texts):
        dense = [[float(len(t)), float(t.count(" ")), float(sum(map(ord, t[:8])))] for t in texts]
        return dense, [{len(w): float(t.count(w)) for w in t.split()[:5]} for t in texts]

    c = table(spark, d, "documents").select("doc_id", F.col("text").alias("encoding_text"))
    return retrieval.build_points(c, encoder).select("doc_id", "dense", F.size("sparse").alias("n_sparse"))


@query("nfc_match_keyword", f"with {POSTS} select doc_id, {NORM.format(c='title')} as title from posts")
def nfc(spark, d):
    return posts(spark, d).select("doc_id", text.normalize(F.col("title")).alias("title"))
