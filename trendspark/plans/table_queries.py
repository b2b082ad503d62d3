"""Queries of the source and table-maintenance operators, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.functions import text
from trendspark.operators import tables
from trendspark.plans.common import table
from trendspark.plans.text_queries import KEYWORDS, MATCH, NORM, POSTS, posts
from trendspark.sources import io

QUERIES, ORACLES = {}, {}
NOW = "2024-01-30 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


now = lambda: F.lit(NOW).cast("timestamp_ntz")
r6 = lambda c: F.round(F.col(c), 6).alias(c)
_any = lambda p, xs: F.element_at(F.array(*map(F.lit, xs)), (p % len(xs) + 1).cast("int"))


def raw(spark, d):
    """documents as raw posts: url by source and id, collected in the last 60 days, two of three processed."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        tables.doc_id(_any(i, KEYWORDS), F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), i.cast("string"))).alias("_id"), "doc_id", _any(i, KEYWORDS).alias("keyword"), "source",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), i.cast("string")).alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        (now() - F.make_dt_interval((i % 60).cast("int"), (i % 24).cast("int"))).alias("crawled_at"), (i % 3 > 0).alias("is_embedded"),
    )


RAW = f"""raw as (select md5(k || '::' || u) as _id, doc_id, k as keyword, source, u as url, split_part(text, chr(10), 1) as title, text as content,
  timestamp '{NOW}' - to_days((doc_id % 60)::int) - to_hours((doc_id % 24)::int) as crawled_at, doc_id % 3 > 0 as is_embedded
  from (select *, list_extract({list(KEYWORDS)}, (doc_id % 6 + 1)::int) as k, 'https://' || source || '.example/' || doc_id as u from documents))"""


def lit_keywords(spark, d, n=6):
    return raw(spark, d).where(F.col("doc_id") % 6 < n).select("keyword").distinct()


# ------------------------------------------------------------------ sources


@query("s01_read_pending", f"with {RAW} select doc_id from raw where not is_embedded and trim(content) <> ''")
def s01(spark, d):
    return io.read_pending(raw(spark, d)).select("doc_id")


@query("s09_keyword_scan", f"with {RAW} select keyword, doc_id, content from raw where keyword = 'inging'")
def s09(spark, d):
    return raw(spark, d).where("keyword = 'inging'").select("keyword", "doc_id", "content")


@query("s04_upsert", f"""with {RAW}, b as (select doc_id % 500 as k, crawled_at, content from raw where doc_id % 2 = 0), u as (select doc_id % 500 as k, crawled_at, title as content from raw where doc_id % 2 = 1),
x as (select *, 0 as g from b union all select *, 1 from u) select k, max(crawled_at) as crawled_at from x group by k""")
def s04(spark, d):
    r = raw(spark, d).withColumn("k", F.col("doc_id") % 500)
    out = tables.upsert(r.where("doc_id % 2 = 0").select("k", "crawled_at", "content"), r.where("doc_id % 2 = 1").select("k", "crawled_at", F.col("title").alias("content")), ["k"], "crawled_at")
    return out.select("k", "crawled_at")


@query("s05_insert_new", f"""with {RAW}, inc as (select doc_id % 700 as k, min(doc_id) as doc_id from raw group by 1), base as (select distinct doc_id % 300 as k from raw where doc_id % 4 = 0),
new as (select * from inc where k not in (select k from base)) select count(*) as saved, (select count(*) from raw) - count(*) as skipped from new""")
def s05(spark, d):
    r = raw(spark, d)
    base = r.where("doc_id % 4 = 0").select((F.col("doc_id") % 300).alias("k")).distinct()
    return tables.insert_new(base, r.select((F.col("doc_id") % 700).alias("k"), "doc_id"), "k", "doc_id")[1]


@query("s06_insert_defaults", f"""with {RAW}, base as (select doc_id as k, 'done' as status from raw where doc_id % 3 = 0) select * from base union all select doc_id, 'queued' from raw where doc_id % 2 = 0 and doc_id % 3 > 0""")
def s06(spark, d):
    r = raw(spark, d)
    return tables.insert_defaults(r.where("doc_id % 3 = 0").select(F.col("doc_id").alias("k"), F.lit("done").alias("status")), r.where("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.lit("queued").alias("status")), "k")


@query("s08_replace_by_parent", f"""with {RAW}, p as (select doc_id // 4 as parent_id, doc_id, 'old' as v from raw), n as (select doc_id // 4 as parent_id, doc_id, 'new' as v from raw where doc_id % 8 = 1)
select * from p where parent_id % 2 = 1 union all select * from n where parent_id % 2 = 0""")
def s08(spark, d):
    p = raw(spark, d).select(F.floor(F.col("doc_id") / 4).cast("long").alias("parent_id"), "doc_id", F.lit("old").alias("v"))
    new = p.where("doc_id % 8 = 1 and parent_id % 2 = 0").withColumn("v", F.lit("new"))
    return tables.replace_by_parent(p, new, p.where("parent_id % 2 = 0").select("parent_id").distinct())


@query("s11_usable_labels", "select doc_id, case doc_id % 3 when 0 then quality else toxic end as human_label from labels where doc_id % 3 < 2")
def s11(spark, d):
    k = F.col("doc_id") % 3
    l = table(spark, d, "labels").select("doc_id", F.when(k == 0, F.col("quality").cast("string")).when(k == 1, F.col("toxic").cast("string")).otherwise("").alias("human_label"))  # noqa: E741
    return io.usable_labels(l)


@query("s13_export_recent", f"with {RAW} select doc_id from raw where keyword = 'ention' and crawled_at >= timestamp '{NOW}' - interval 20160 minutes")
def s13(spark, d):
    return io.export_recent(raw(spark, d), "ention", 20160, now()).select("doc_id")


@query("s14_to_documents", """select page_id, 'T ' || page_id as title, 'desc & "x" ' || left(html, 15) as content, strftime(timestamp '2024-01-01 00:00:00' + to_days((page_id % 30)::int) - interval 9 hours, '%Y-%m-%d %H:%M:%S') as published from pages where length('desc & "x" ' || left(html, 15)) >= 20""".replace("left(html, 15)", "url"))
def s14(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), F.concat(F.lit("<b>T</b> "), F.col("page_id").cast("string")).alias("title"), F.concat(F.lit("<b>desc</b> &amp; &quot;x&quot; "), F.col("url")).alias("description"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")), "yyyyMMdd").alias("postdate"))
    out = io.to_documents(p, "blog", 20)
    return out.select(F.col("url").cast("long").alias("page_id"), "title", "content", F.date_format("published_date", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("s15_extract_pages", r"""with x as (select page_id, case when page_id % 9 = 0 then '<article><img src="a"></article>' when page_id % 9 = 1 then replace(html, 'article', 'main') else html end as h from pages),
y as (select page_id, h, trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, regexp_extract(h, '(?is)<article\b[^>]*>(.*?)</article>', 1) as i, regexp_matches(h, '(?is)<article\b[^>]*>.*?</article>') as has from x),
z as (select *, trim(regexp_replace(regexp_replace(regexp_replace(i, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>', '', 'g'), '(?s)<[^>]+>', chr(10), 'g'), '[ \t]*\n\s*', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) as body from y)
select page_id, title, body, case when not has then 'missing' when body = '' then 'empty' else 'ok' end as state from z""")
def s15(spark, d):
    k, h = F.col("page_id") % 9, F.col("html")
    html = F.when(k == 0, '<article><img src="a"></article>').when(k == 1, F.replace(h, F.lit("article"), F.lit("main"))).otherwise(h)
    return table(spark, d, "pages").select("page_id", io.extract_page(html).alias("p")).select("page_id", "p.title", "p.body", "p.state")


@query("s16_extract_sections", r"""with x as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<details\b[^>]*>.*?</details>', '', 'g'), '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', chr(10) || '[[SECTION]] \1' || chr(10), 'g'), '(?s)<[^>]+>', chr(10), 'g') as t from pages)
select page_id, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) as body from x""")
def s16(spark, d):
    return table(spark, d, "pages").select("page_id", io.extract_sections(F.col("html")).alias("body"))


@query("s17_parse_comments", """select conv_id, turn, case when turn % 3 = 1 or trim(text) = '' then '' else trim(replace(text, chr(10), ' ')) end as comment from conversations""")
def s17(spark, d):
    c = table(spark, d, "conversations").withColumn("memo", F.replace("text", F.lit("\n"), F.lit(" ")))
    j = F.to_json(F.array(F.struct(F.col("memo"), F.when(F.col("turn") % 3 == 1, "Y").otherwise("N").alias("del_yn"), F.lit("u").alias("user")), F.struct(F.lit(" ").alias("memo"), F.lit("N").alias("del_yn"), F.lit("v").alias("user"))))
    return c.select("conv_id", "turn", F.concat_ws("|", io.parse_comments(j)).alias("comment"))


@query("s18_table_counts", "select 'documents' as \"table\", count(*) as n from documents union all select 'pages', count(*) from pages union all select 'events', count(*) from events")
def s18(spark, d):
    return io.table_counts({t: table(spark, d, t) for t in ("documents", "pages", "events")})


# ------------------------------------------------------------------ joins


@query("j01_skip_saved", f"with {RAW} select keyword, count(*) as n_skipped from raw where doc_id % 3 = 0 group by 1")
def j01(spark, d):
    r = raw(spark, d)
    return tables.skip_saved(r.select("keyword", "url"), r.where("doc_id % 3 = 0"))[1]


@query("j02_skip_rejected", f"with {RAW} select doc_id from raw where not (doc_id % 4 = 0 and crawled_at >= timestamp '{NOW}' - interval 30 days)")
def j02(spark, d):
    r = raw(spark, d)
    return tables.skip_rejected(r, r.where("doc_id % 4 = 0").select("_id", F.col("crawled_at").alias("rejected_at")), now()).select("doc_id")


@query("j03_recently_collected", f"with {RAW}, k as (select distinct keyword from raw), f as (select distinct keyword from raw where source = 'src3' and crawled_at >= timestamp '{NOW}' - interval 3 days) select keyword, f.keyword is not null as recent from k left join f using (keyword)")
def j03(spark, d):
    r = raw(spark, d)
    return tables.recently_collected(r.select("keyword").distinct(), r, "src3", now())


@query("j04_with_parents", f"with {RAW} select doc_id, title, url from raw where doc_id % 7 = 0")
def j04(spark, d):
    r = raw(spark, d)
    return tables.with_parents(r.where("doc_id % 7 = 0").select(F.col("_id").alias("parent_id"), "doc_id"), r, ["title", "url"]).select("doc_id", "title", "url")


@query("j05_pending_cleaned", f"with {RAW} select count(*) filter (doc_id % 5 > 0) as n_pending, count(*) filter (doc_id % 5 = 0) as n_unprocessed from raw where not is_embedded")
def j05(spark, d):
    r = raw(spark, d)
    ready, rest = tables.pending_cleaned(r, r.where("doc_id % 5 > 0"))
    return ready.agg(F.count("*").alias("n_pending")).join(F.broadcast(rest))


@query("j06_visible_keywords", f"with {RAW} select distinct keyword from raw where is_embedded and keyword <> 'enlich'")
def j06(spark, d):
    r = raw(spark, d)
    return tables.visible_keywords(r, r.where("keyword = 'enlich'").select("keyword").distinct())


@query("j09_cross_df", f"""with {MATCH}, k as (select distinct keyword from posts), n as (select doc_id, keyword, {NORM.format(c="title || body")} as norm from posts),
h as (select k.keyword, count(*) as cross_match from k join n on n.keyword <> k.keyword and contains(norm, k.keyword) group by 1), o as (select keyword, count(*) as own_docs from posts group by 1)
select keyword, own_docs, coalesce(cross_match, 0) as cross_match, round(coalesce(cross_match, 0) / ((select count(*) from posts) - own_docs), 6) as cross_df, coalesce(cross_match, 0) / ((select count(*) from posts) - own_docs) >= 0.1 as demote from k join o using (keyword) left join h using (keyword)""")
def j09(spark, d):
    p = posts(spark, d).select("keyword", text.normalize(F.concat("title", "body"), nfc=False).alias("norm"))
    k = posts(spark, d).select("keyword").distinct()
    return tables.cross_df(p, k.withColumn("norm", text.normalize(F.col("keyword"), nfc=False))).select("keyword", "own_docs", "cross_match", r6("cross_df"), "demote")


WORDS_SQL = "w as (select distinct lower(regexp_extract(text, '[A-Za-z]+', 0)) as keyword from documents), wi as (select keyword || ' ' as keyword from w where length(keyword) >= 5)"


def _first_words(spark, d):
    return table(spark, d, "documents").select(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("keyword")).distinct()


@query("j10_similar_keywords", f"with {WORDS_SQL} select i.keyword as input, k.keyword from wi i join w k on length(k.keyword) >= 2 and (contains(trim(i.keyword), k.keyword) or contains(k.keyword, trim(i.keyword))) and i.keyword <> k.keyword")
def j10(spark, d):
    w = _first_words(spark, d)
    return tables.similar_keywords(w.where("length(keyword) >= 5").select(F.concat("keyword", F.lit(" ")).alias("keyword")), w, nfc=False)


TEMPLATES = ("what does {keyword} mean?", "why is {keyword} popular?", "how is {keyword} used?", "who uses {keyword}?")


@query("j11_eval_set", f"with {WORDS_SQL}, t(i, template) as (values {', '.join(str((i, t)) for i, t in enumerate(TEMPLATES))}) select keyword || '__t' || i as query_id, keyword, template, replace(template, '{{keyword}}', keyword) as question from w, t")
def j11(spark, d):
    return tables.eval_set(_first_words(spark, d), list(TEMPLATES))


@query("j12_usable_keywords", f"with {RAW}, {WORDS_SQL}, h as (select distinct lower(regexp_extract(content, '[A-Za-z]+', 0)) as keyword from raw where is_embedded) select keyword, keyword in (select keyword from h) as usable from w")
def j12(spark, d):
    r = raw(spark, d).withColumn("keyword", F.lower(F.regexp_extract("content", "[A-Za-z]+", 0)))
    return tables.usable_keywords(_first_words(spark, d), r)


@query("j13_keyword_inventory", f"with {RAW}, a as (select distinct keyword from raw where doc_id % 6 < 4), c as (select distinct source as keyword from raw), e as (select * from a union select * from c), n as (select keyword, count(*) as n_docs from raw group by 1) select keyword, coalesce(n_docs, 0) as n_docs, keyword in (select keyword from c) as configured from e left join n using (keyword)")
def j13(spark, d):
    r = raw(spark, d)
    return tables.keyword_inventory(lit_keywords(spark, d, 4), r.select(F.col("source").alias("keyword")).distinct(), r)


@query("j17_audit_lineage", f"with {RAW} select doc_id, case doc_id % 10 when 0 then 'parent_missing' else case when doc_id % 4 = 1 and not contains(content, left(upper(content), 30)) then 'altered' else 'ok' end end as lineage from raw")
def j17(spark, d):
    r = raw(spark, d)
    chunks = r.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("gone")).otherwise(F.col("_id")).alias("parent_id"), F.when(F.col("doc_id") % 4 == 1, F.upper("content")).otherwise(F.col("content")).alias("text"))
    return tables.audit_lineage(chunks, r).select("doc_id", "lineage")


# ------------------------------------------------------------------ identities and unions


@query("d01_union_first", "select regexp_replace(url, '[?#].*$', '') as u, min(page_id % 3) as list_no from pages group by 1")
def d01(spark, d):
    p = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("u"), (F.col("page_id") % 3).alias("list_no"), F.col("page_id").alias("pos"))
    return tables.union_first(p, "u").select("u", "list_no")


@query("d05_doc_id", f"with {RAW} select doc_id, _id from raw")
def d05(spark, d):
    return raw(spark, d).select("doc_id", "_id")


@query("d06_point_id", r"""with h as (select doc_id, sha1('\x6B\xA7\xB8\x10\x9D\xAD\x11\xD1\x80\xB4\x00\xC0\x4F\xD4\x30\xC8'::blob || encode(doc_id || '::' || (doc_id % 5))) as h from documents)
select doc_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', strpos('0123456789abcdef', substr(h, 17, 1))::int - 1 - 4 * ((strpos('0123456789abcdef', substr(h, 17, 1))::int - 1) // 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id from h""")
def d06(spark, d):
    return table(spark, d, "documents").select("doc_id", tables.point_id(F.col("doc_id"), F.col("doc_id") % 5).alias("point_id"))


@query("d08_cache_key", "select doc_id, sha256('v1|' || lang || '|' || case doc_id % 3 when 0 then '' when 1 then 'a,b' else '' end) as cache_key from documents")
def d08(spark, d):
    k = F.col("doc_id") % 3
    names = F.when(k == 0, F.array(F.lit("c"), F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("b"), F.lit("a")))
    return table(spark, d, "documents").select("doc_id", tables.cache_key("v1", F.col("lang"), names, ["a", "b", "c"]).alias("cache_key"))


@query("d09_keyword_set_change", f"with {RAW}, {WORDS_SQL} select keyword from (select keyword from w union select keyword from raw) where keyword not in (select source from raw) and keyword not in ('inging')")
def d09(spark, d):
    r = raw(spark, d)
    return tables.keyword_set_change(_first_words(spark, d), r, r.where("keyword = 'inging'").select("keyword").distinct())


# ------------------------------------------------------------------ counts and reports


@query("a01_analyzable_keywords", f"with {RAW} select distinct keyword from raw where is_embedded")
def a01(spark, d):
    return tables.analyzable_keywords(raw(spark, d))


@query("a02_docs_by_source", f"with {RAW}, k as (select distinct keyword from raw union select distinct source from raw), c as (select keyword, source, count(*) as n from raw group by all), g as (select keyword, sum(n)::bigint as total, string_agg(source || '=' || n, ',' order by source) as by_source from c group by 1) select keyword, coalesce(total, 0) as total, coalesce(by_source, '') as by_source from k left join g using (keyword)")
def a02(spark, d):
    r = raw(spark, d)
    out = tables.docs_by_source(r, r.select("keyword").union(r.select("source")).distinct())
    entries = F.transform(F.array_sort(F.map_entries("by_source")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("keyword", "total", F.array_join(entries, ",").alias("by_source"))


COUNTS = "counts as (select keyword || (doc_id % 30) as keyword, source, count(*) as n from raw group by all)"


def _counts(spark, d):
    return raw(spark, d).groupBy(F.concat("keyword", (F.col("doc_id") % 30).cast("string")).alias("keyword"), "source").agg(F.count("*").alias("n"))


@query("a05_needs_supplement", f"with {RAW}, {COUNTS}, g as (select keyword, sum(n)::bigint as total, coalesce(sum(n) filter (source = 'src7'), 0)::bigint as wiki from counts group by 1) select *, total < 30 or wiki = 0 as due from g")
def a05(spark, d):
    return tables.needs_supplement(_counts(spark, d), "src7", 30)


@query("a06_collection_report", f"with {RAW}, l as (select keyword, source, count(*) as n from raw where (doc_id % 6 + substr(source, 4)::int) % 5 > 0 group by all), s(place, source) as (values (0, 'src1'), (1, 'src2'), (2, 'src9')), k as (select distinct keyword from l) select keyword, place, source, coalesce(n, 0) as \"count\", case when n is null then 'not_run' else 'ok' end as status from k cross join s left join l using (keyword, source)")
def a06(spark, d):
    log = raw(spark, d).where("(doc_id % 6 + substring(source, 4, 9)) % 5 > 0").groupBy("keyword", "source").agg(F.count("*").alias("count")).withColumn("status", F.lit("ok"))
    return tables.collection_report(log, ["src1", "src2", "src9"])


@query("a07_funnel", "select 'r' || (user_id % 4) as run, event_type as stage, count(*) filter (event_id % 3 = 0) as n_in, count(*) filter (event_id % 3 = 1) as n_out, count(*) filter (event_id % 3 = 2 and event_id % 2 = 0) as dropped_even from events group by all")
def a07(spark, d):
    k = F.col("event_id") % 3
    e = table(spark, d, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("run"), F.col("event_type").alias("stage"), F.when(k == 0, "in").when(k == 1, "out").otherwise("drop").alias("event"), F.when(k == 2, F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")).alias("reason"), F.lit(1).alias("n"))
    return tables.funnel(e).select("run", "stage", "n_in", "n_out", F.coalesce(F.col("dropped")["even"], F.lit(0)).alias("dropped_even"))


def _rated(spark, d):
    from trendspark.plans.text_queries import _violations

    return _violations(spark, d).withColumn("run", F.when(F.col("doc_id") % 2 == 0, "before").otherwise("after")).withColumn("chunk_id", F.col("doc_id"))


def _rated_sql():
    from trendspark.plans.text_queries import SIGNALS, VIOLATIONS

    return f"{SIGNALS}, rated as (select doc_id, case when doc_id % 2 = 0 then 'before' else 'after' end as run, char_count, string_split({VIOLATIONS}, ',') as v, {VIOLATIONS} as vs from si), summary as (select run, count(*) as n_chunks, floor(quantile_cont(char_count, 0.5))::bigint as median_length, count(*) filter (list_contains(v, 'short')) as short, count(*) filter (list_contains(v, 'spam')) as spam, count(*) filter (list_contains(v, 'low_hangul')) as low_hangul, count(*) filter (list_contains(v, 'boilerplate')) as boilerplate from rated group by run)"


@query("a08_quality_summary", f"with {_rated_sql()} select * from summary")
def a08(spark, d):
    return tables.quality_summary(_rated(spark, d)).drop("no_keyword", "late_match")


@query("a09_compare_runs", f"with {_rated_sql()}, l as (unpivot (select * from summary) on n_chunks, median_length, short, spam, low_hangul, boilerplate into name metric value value) select metric, max(value) filter (run = 'before') as before, max(value) filter (run = 'after') as after, max(value) filter (run = 'after') - max(value) filter (run = 'before') as delta from l group by metric")
def a09(spark, d):
    return tables.compare_runs(a08(spark, d), "before", "after")


@query("w05_worst_chunks", f"with {_rated_sql()} select doc_id, vs as violations from rated order by case when vs = '' then 0 else len(v) end desc, doc_id limit 50")
def w05(spark, d):
    return tables.worst_chunks(_rated(spark, d), 50).select("doc_id", F.concat_ws(",", "violations").alias("violations"))


def _labels(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("human_label"), ((F.col("quality") + F.col("doc_id")) % 4 > 0).cast("int").alias("judge_matched"))


LABELS = "lab as (select l.doc_id, lang, source, quality as h, ((quality + l.doc_id) % 4 > 0)::int as j from labels l join documents using (doc_id))"


@query("a10_judge_score", f"with {LABELS}, c as (select count(*) filter (h = 0 and j = 0) as tp, count(*) filter (h = 1 and j = 0) as fp, count(*) filter (h = 0 and j = 1) as fn, count(*) filter (h = 1 and j = 1) as tn from lab) select *, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall from c")
def a10(spark, d):
    return tables.judge_score(_labels(spark, d)).select("tp", "fp", "fn", "tn", r6("accuracy"), r6("precision"), r6("recall"))


@query("a11_agreement_by", f"with {LABELS}, g as (select 'lang' as dimension, lang as value, h, j from lab union all select 'source', source, h, j from lab) select dimension, value, count(*) as n, round(avg((h = j)::int), 6) as agreement, round(avg(h), 6) as relevant from g group by all")
def a11(spark, d):
    return tables.agreement_by(_labels(spark, d), ["lang", "source"]).select("dimension", "value", "n", r6("agreement"), r6("relevant"))


@query("a12_relevance_distribution", f"with {MATCH} select matched as is_relevant, position as relevance_position, count(*) as n, round(count(*) / (select count(*) from mt), 6) as share from mt group by all")
def a12(spark, d):
    m = posts(spark, d).select(text.match_keyword(F.col("keyword"), F.col("title"), F.col("body"), nfc=False).alias("m"))
    return tables.relevance_distribution(m.select(F.col("m.matched").alias("is_relevant"), F.col("m.position").alias("relevance_position"))).select("is_relevant", "relevance_position", "n", r6("share"))


@query("a13_affected_keywords", f"with {RAW} select keyword, count(*) as document_count, count(distinct source) as source_count from raw where is_embedded group by 1")
def a13(spark, d):
    return tables.affected_keywords(raw(spark, d).where("is_embedded"))


@query("a14_low_confidence", f"with {RAW} select keyword || (doc_id % 70) as q, count(distinct url) as n_urls, count(distinct url) < 5 as low_confidence from raw group by 1")
def a14(spark, d):
    return tables.low_confidence(raw(spark, d).withColumn("q", F.concat("keyword", (F.col("doc_id") % 70).cast("string"))), ["q"])


@query("a15_stage_timings", "select event_type as stage, round(sum(value), 4) as seconds, count(*) as calls, round(100 * sum(value) / (select sum(value) from events), 6) as share from events group by 1")
def a15(spark, d):
    return tables.stage_timings(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))).select("stage", F.round("seconds", 4).alias("seconds"), "calls", r6("share"))


JOBS = f"""jobs as (select conv_id as _id, list_extract({list(KEYWORDS)}, (conv_id % 6 + 1)::int) || (conv_id % 9) as keyword, case conv_id % 4 when 0 then 'queued' when 1 then 'running' when 2 then 'done' else 'failed' end as status,
  case when conv_id % 2 = 0 then 'analysis' else 'crawl' end as kind, case when conv_id % 12 > 0 then timestamp '{NOW}' - to_minutes((conv_id % 200)::int) end as requested_at, timestamp '{NOW}' - to_minutes((conv_id % 100)::int) as started_at from conversations where turn = (select min(turn) from conversations))"""


def jobs(spark, d):
    c, i = table(spark, d, "conversations"), F.col("conv_id")
    first = c.agg(F.min("turn").alias("t"))
    k = i % 4
    return c.join(F.broadcast(first), F.col("turn") == F.col("t")).select(
        i.alias("_id"), F.concat(_any(i, KEYWORDS), (i % 9).cast("string")).alias("keyword"), F.when(k == 0, "queued").when(k == 1, "running").when(k == 2, "done").otherwise("failed").alias("status"), F.when(i % 2 == 0, "analysis").otherwise("crawl").alias("kind"),
        F.when(i % 12 > 0, now() - F.make_dt_interval(mins=(i % 200).cast("int"))).alias("requested_at"), (now() - F.make_dt_interval(mins=(i % 100).cast("int"))).alias("started_at"),
    )


@query("a16_cache_snapshot", f"with {JOBS}, {WORDS_SQL}, k as (select keyword from w union select keyword from jobs), j as (select keyword, max(status) as status from jobs group by 1) select coalesce(status, 'missing') as status, count(*) as n from k left join j using (keyword) group by 1")
def a16(spark, d):
    j = jobs(spark, d).groupBy("keyword").agg(F.max("status").alias("status"))
    return tables.cache_snapshot(_first_words(spark, d).union(j.select("keyword")).distinct(), j)


@query("a17_eval_history", "with r as (select 'kw' || (user_id % 6) as keyword, ts::date as run_at, round(100 * avg((event_type = 'error')::int), 6) as warned_pct from events group by all) select * from r where run_at in (select distinct run_at from r order by run_at desc limit 5)")
def a17(spark, d):
    e = table(spark, d, "events").groupBy(F.concat(F.lit("kw"), (F.col("user_id") % 6).cast("string")).alias("keyword"), F.col("ts").cast("date").alias("run_at"))
    return tables.eval_history(e.agg(F.round(100 * F.avg((F.col("event_type") == "error").cast("double")), 6).alias("warned_pct")), 5)


@query("a18_context_noise", f"with {MATCH} select keyword, count(*) as total, count(*) filter (not (length(body) >= 30 and matched)) as warned, round(100 * avg((not (length(body) >= 30 and matched))::int), 6) as warned_pct from posts join mt using (doc_id) group by 1")
def a18(spark, d):
    p = posts(spark, d).withColumn("ok", (F.length("body") >= 30) & text.match_keyword(F.col("keyword"), F.col("title"), F.col("body"), nfc=False)["matched"])
    return tables.context_noise(p, F.col("ok")).select("keyword", "total", "warned", r6("warned_pct"))


@query("a19_needs_evidence", f"with {RAW}, g as (select doc_id // 2 as q, sum(length(content))::bigint as chars, max(length(content))::int as longest from raw group by 1) select *, chars < 1500 or longest < 500 as due from g")
def a19(spark, d):
    return tables.needs_evidence(raw(spark, d).select(F.floor(F.col("doc_id") / 2).cast("long").alias("q"), F.col("content").alias("text")), ["q"])


@query("a20_run_metrics", f"with {RAW} select doc_id // 4 as job, sum(length(content))::bigint as context_chars, count(*) as source_count from raw group by 1")
def a20(spark, d):
    return tables.run_metrics(raw(spark, d).select(F.floor(F.col("doc_id") / 4).cast("long").alias("job"), F.col("content").alias("text")), ["job"])


@query("a21_fallback_due", "with l as (select 'kw' || (user_id % 40) as keyword, arg_max(case when event_type = 'error' then 'failed(Timeout)' else 'ok' end, event_id) as status from events where event_type in ('error', 'view') group by 1) select * from l where status like 'failed%'")
def a21(spark, d):
    e = table(spark, d, "events").where("event_type in ('error', 'view')")
    return tables.fallback_due(e.select(F.concat(F.lit("kw"), (F.col("user_id") % 40).cast("string")).alias("keyword"), F.lit("web").alias("source"), F.when(F.col("event_type") == "error", "failed(Timeout)").otherwise("ok").alias("status"), F.col("event_id").alias("ran_at")), "web")


# ------------------------------------------------------------------ ranks and samples


@query("w04_split_budget", "with x as (select regexp_replace(url, '[?#].*$', '') as u, page_id % 2 as list_no, page_id as pos from pages), y as (select *, row_number() over (partition by list_no order by pos) as rn from x) select u, min(list_no) as list_no from y where rn <= 50 group by u")
def w04(spark, d):
    p = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("u"), (F.col("page_id") % 2).alias("list_no"), F.col("page_id").alias("pos"))
    return tables.split_budget(p, "u", 100).select("u", "list_no")


@query("w06_stratified_sample", f"""with {MATCH}, b as (select doc_id, source, position, row_number() over (partition by source, position order by md5('s' || doc_id)) - 1 as k from posts join mt using (doc_id)),
x as (select *, case when source in ('src1', 'src2', 'src3') then k // 4 else k end as round, case when source in ('src1', 'src2', 'src3') then k % 4 else 0 end as slot from b)
select doc_id, source, position from x order by round, list_position(['title', 'early', 'late', 'none'], position), case when source in ('src1', 'src2', 'src3') and slot < 3 then list_position(['src1', 'src2', 'src3'], source) * 3 + slot else 1000000 end, source limit 200""")
def w06(spark, d):
    m = text.match_keyword(F.col("keyword"), F.col("title"), F.col("body"), nfc=False)
    p = posts(spark, d).select("doc_id", "source", m["position"].alias("position"))
    return tables.stratified_sample(p, 200, ["src1", "src2", "src3"], F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))))


@query("w07_queue_positions", f"with {JOBS}, q as (select _id, row_number() over (order by requested_at nulls first, _id)::int as position from jobs where status = 'queued') select *, position * 20 as wait_least, position * 40 as wait_most from q")
def w07(spark, d):
    return tables.queue_positions(jobs(spark, d)).select("_id", "position", "wait_least", "wait_most")


# ------------------------------------------------------------------ keywords and jobs


@query("m01_hidden_keywords", f"with {RAW} select keyword, keyword in ('ention', 'inging') as hidden from (select distinct keyword from raw)")
def m01(spark, d):
    r = raw(spark, d).select("keyword").distinct()
    hidden = tables.insert_defaults(r.where("keyword = 'ention'"), r.where("keyword in ('ention', 'inging')"), "keyword")
    shown = r.join(hidden, "keyword", "left_anti")
    return hidden.withColumn("hidden", F.lit(True)).unionByName(shown.withColumn("hidden", F.lit(False)))


@query("m02_merge_keywords", f"with {RAW} select doc_id, case keyword when 'ention' then 'edtion' else keyword end as keyword from raw")
def m02(spark, d):
    r = raw(spark, d)
    mapping = r.where("keyword in ('ention', 'inging')").select(F.col("keyword").alias("source_keyword"), F.when(F.col("keyword") == "ention", "edtion").otherwise("inging").alias("target_keyword")).distinct()
    return tables.merge_keywords(r, mapping).select("doc_id", "keyword")


@query("m03_delete_hidden", f"with {RAW} select doc_id from raw where keyword <> 'ention'")
def m03(spark, d):
    r = raw(spark, d)
    k = r.select("keyword").distinct()
    return tables.delete_hidden(r, k.where("keyword in ('ention', 'inging')"), k.where("keyword in ('ention', 'edtion')")).select("doc_id")


@query("m04_purge", f"with {MATCH} select doc_id, not matched as judge_excluded from posts join mt using (doc_id)")
def m04(spark, d):
    p = posts(spark, d).withColumn("_id", F.col("doc_id"))
    m = text.match_keyword(F.col("keyword"), F.col("title"), F.col("body"), nfc=False)["matched"]
    return tables.purge(p, p.where(~m).select(F.col("_id").alias("parent_id"))).select("doc_id", "judge_excluded")


@query("m05_reset_for_reprocessing", f"with {RAW} select count(*) filter (keyword = 'inging' and is_embedded) as changed, count(*) filter (keyword <> 'inging' and is_embedded) as embedded from raw")
def m05(spark, d):
    return tables.reset_for_reprocessing(raw(spark, d), keyword="inging").agg(F.count_if("changed").alias("changed"), F.count_if("is_embedded").alias("embedded"))


@query("m06_backfill_relevance", f"with {MATCH} select doc_id, case when doc_id % 3 = 0 then true else matched end as is_relevant, case when doc_id % 3 = 0 then 'title' else position end as relevance_position, doc_id % 3 > 0 as filled from mt")
def m06(spark, d):
    p = posts(spark, d).withColumn("_id", F.col("doc_id")).withColumn("is_relevant", F.when(F.col("doc_id") % 3 == 0, True)).withColumn("relevance_position", F.when(F.col("doc_id") % 3 == 0, "title"))
    points = p.select(F.col("_id").alias("parent_id"), F.lit(None).cast("boolean").alias("is_relevant"))
    filled, _ = tables.backfill_relevance(p, points, text.match_keyword(F.col("keyword"), F.col("title"), F.col("body"), nfc=False))
    return filled.select("doc_id", "is_relevant", "relevance_position", "filled")


@query("m07_stuck_jobs", f"with {JOBS} select kind, count(*) as n, min(started_at) as oldest from jobs where status = 'running' and started_at < timestamp '{NOW}' - interval 20 minutes group by 1")
def m07(spark, d):
    return tables.stuck_jobs(jobs(spark, d), now(), 20)


@query("m08_refresh_on_evidence", f"with {RAW}, q as (select keyword || (doc_id % 200) as keyword, count(*) as document_count, count(distinct source) as source_count from raw group by 1) select *, case when document_count >= 2 and source_count >= 2 then 'refresh' else 'unchanged' end as outcome from q")
def m08(spark, d):
    q = tables.affected_keywords(raw(spark, d).withColumn("keyword", F.concat("keyword", (F.col("doc_id") % 200).cast("string"))))
    return tables.refresh_on_evidence(q)


@query("m09_invalidate_cache", f"with {JOBS} select _id, status from jobs where not (status = 'done' and starts_with(keyword, 'e'))")
def m09(spark, d):
    j = jobs(spark, d)
    return tables.invalidate_cache(j, j.where("keyword like 'e%'").select("keyword")).select("_id", "status")


@query("m10_promote_keywords", f"with {RAW}, c as (select keyword || (doc_id % 50) as keyword, count(*) as n from raw group by 1), l as (select distinct keyword from c where keyword like 'enlich%'), x as (select *, row_number() over (order by n desc, keyword) as r from c where n >= 5 and keyword not in (select keyword from l)) select keyword, n, case when (select count(*) from l) + r <= 60 then 'promoted' else 'cap' end as outcome from x")
def m10(spark, d):
    c = raw(spark, d).groupBy(F.concat("keyword", (F.col("doc_id") % 50).cast("string")).alias("keyword")).agg(F.count("*").alias("n"))
    return tables.promote_keywords(c, c.where("keyword like 'enlich%'").select("keyword"))


@query("m11_record_rejects", f"with {RAW} select _id, case when length(trim(content)) < 30 then 'too_short' else 'irrelevant' end as reason from raw where length(trim(content)) < 30 or doc_id % 5 = 0")
def m11(spark, d):
    reason = F.when(F.length(F.trim("content")) < 30, "too_short").when(F.col("doc_id") % 5 == 0, "irrelevant").when(F.col("doc_id") % 5 == 1, "network")
    return tables.record_rejects(raw(spark, d).withColumn("reason", reason), now()).select("_id", "reason")


@query("m13_keyword_readiness", f"with {RAW}, {WORDS_SQL}, k as (select keyword from w union select keyword from raw), d as (select keyword, count(*) as n from raw group by 1), c as (select keyword, count(*) as n from raw where keyword in ('inging', 'ention') group by 1) select keyword, coalesce(d.n, 0) as n_docs, coalesce(c.n, 0) as n_chunks, case when d.n is null then 'nothing_collected' when c.n is null then 'nothing_left' else 'ready' end as verdict from k left join d using (keyword) left join c using (keyword)")
def m13(spark, d):
    r = raw(spark, d)
    return tables.keyword_readiness(_first_words(spark, d).union(r.select("keyword")).distinct(), r, r.where("keyword in ('inging', 'ention')"))
