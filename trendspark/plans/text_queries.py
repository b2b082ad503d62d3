"""Queries of the text, URL and gate operators, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.functions import text, urls
from trendspark.operators import gates
from trendspark.plans.common import table

QUERIES, ORACLES = {}, {}
KEYWORDS = ("ention", "edtion", "intion", "inging", "enlich", "queque")
NOW = "2024-01-30 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


def posts(spark, d):
    """documents as posts: keyword by id, title from the first line."""
    k = F.element_at(F.array(*map(F.lit, KEYWORDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs(spark, d).select("doc_id", k.alias("keyword"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "source")


POSTS = f"posts as (select doc_id, list_extract({list(KEYWORDS)}, (doc_id % 6 + 1)::int) as keyword, split_part(text, chr(10), 1) as title, text as body, source from documents)"
NORM = "translate(regexp_replace(replace(lower(nfc_normalize(coalesce({c}, ''))), 'ß', 'ss'), '[\\s\\p{{Z}}]+', '', 'g'), '~〜﹏∼', '')"
norm = lambda c: NORM.format(c=c)
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# ------------------------------------------------------------------ cleaning and signals

_phrases = "c5"
for _p in text.BOILERPLATE:
    _phrases = f"replace({_phrases}, '{_p}', ' ')"
ORACLE_CLEAN = rf"""
c1 as (select doc_id, replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(coalesce(body, ''), '&eacute;', 'é'), '&#9733;', '★'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '<[^>]+>', ' ', 'g'), chr(160), ' ') as c from raw),
c4 as (select doc_id, regexp_replace(regexp_replace(regexp_replace(c, '{text.URL}', '', 'g'), '{text.EMAIL}', '[EMAIL]', 'g'), '{text.PHONE}', '[PHONE]', 'g') as c from c1),
ch as (select doc_id, unnest(string_split(c, '')) as x, generate_subscripts(string_split(c, ''), 1) as i from c4),
lg as (select *, lag(x, 1) over w as a, lag(x, 2) over w as b, lag(x, 3) over w as e from ch window w as (partition by doc_id order by i)),
sq as (select doc_id, string_agg(x, '' order by i) as c5 from lg where not coalesce(x = a and x = b and x = e and x <> chr(10), false) group by doc_id),
c6 as (select doc_id, regexp_replace(regexp_replace({_phrases}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') as c from c4 left join sq using (doc_id)),
cleaned as (select doc_id, trim(array_to_string(list_transform(string_split(coalesce(c, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), chr(10)), {BLANK}) as clean_content from c6)"""
RAW = "raw as (select doc_id, case doc_id % 4 when 0 then '<p>' || text || '&amp;&nbsp;x&eacute;&#9733;&amp;lt;</p> https://a.example/b?c=d soooooo' when 1 then text || ' user.name+tag@mail.example.org 이웃추가 010-1234-5678!!!!!!' else text end as body from documents)"


def _raw(spark, d):
    t = F.col("text")
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<p>"), t, F.lit("&amp;&nbsp;x&eacute;&#9733;&amp;lt;</p> https://a.example/b?c=d soooooo"))).when(F.col("doc_id") % 4 == 1, F.concat(t, F.lit(" user.name+tag@mail.example.org 이웃추가 010-1234-5678!!!!!!"))).otherwise(t)
    return docs(spark, d).select("doc_id", body.alias("body"))


@query("t01_clean_text", f"with {RAW}, {ORACLE_CLEAN} select doc_id, clean_content from cleaned")
def t01(spark, d):
    return _raw(spark, d).select("doc_id", text.clean_text(F.col("body")).alias("clean_content"))


@query("t02_normalize", f"select doc_id, {norm('text')} as normal from documents")
def t02(spark, d):
    return docs(spark, d).select("doc_id", text.normalize(F.col("text")).alias("normal"))


SIGNAL_TEXT = "sg as (select doc_id, source, case when doc_id % 5 = 0 then text || ' 대출 ★☆ 사/고-자 카톡 구독하기 최신순' when doc_id % 7 = 0 then '한글 본문 ' || text else text end as t from documents)"


def _signal_text(spark, d):
    t = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" 대출 ★☆ 사/고-자 카톡 구독하기 최신순"))).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("한글 본문 "), "text")).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", "source", t.alias("t"))


_boiler = " + ".join(f"contains(t, '{p}')::int" for p in text.BOILERPLATE)
_count = lambda p: f"len(regexp_extract_all(t, '{p}'))"
SIGNALS = rf"""{SIGNAL_TEXT}, si as (select doc_id, source, t, length(t)::int as char_count,
  round(coalesce({_count('[가-힣]')} / nullif(length(regexp_replace(t, '[\s\p{{Z}}]+', '', 'g')), 0), 0.0), 3) as hangul_ratio,
  ({_count(text.SPAM[0])} + {_count(text.SPAM[1])} + {_count(text.SPAM[2])})::int as spam_hits, ({_boiler})::int as boilerplate_hits from sg)"""


def _signals(spark, d):
    return _signal_text(spark, d).withColumns(text.signals(F.col("t")))


@query("t03_signals", f"with {SIGNALS} select doc_id, char_count, hangul_ratio, spam_hits, boilerplate_hits from si")
def t03(spark, d):
    return _signals(spark, d).drop("t", "source")


VIOLATIONS = """concat_ws(',', case when char_count < 30 then 'short' end, case when spam_hits >= 3 then 'spam' end,
  case when source in ('src1', 'src2', 'src3') and hangul_ratio < 0.3 then 'low_hangul' end, case when boilerplate_hits > 0 then 'boilerplate' end)"""


def _violations(spark, d):
    s = _signals(spark, d).withColumn("match_position", F.lit("early"))
    return s.withColumn("violations", text.violations(F.col("source").isin("src1", "src2", "src3")))


@query("t04_violations", f"with {SIGNALS} select doc_id, {VIOLATIONS} as violations from si")
def t04(spark, d):
    return _violations(spark, d).select("doc_id", F.concat_ws(",", "violations").alias("violations"))


SECTIONED = "sx as (select doc_id, replace(text, chr(10), case when doc_id % 2 = 0 then chr(10) || '[[SECTION]] part ' || (doc_id % 3) || chr(10) else chr(10) end) as t from documents)"


@query("t05_split_sections", f"""with {SECTIONED}, s as (select doc_id, string_split(chr(10) || t, chr(10) || '[[SECTION]] ') as parts from sx),
p as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1)::int - 1 as section_index from s),
q as (select doc_id, section_index, case when section_index > 0 then trim(split_part(part, chr(10), 1), {BLANK}) end as section_title,
  trim(case when section_index = 0 then part when contains(part, chr(10)) then substr(part, strpos(part, chr(10)) + 1) else '' end, {BLANK}) as section_text from p)
select * from q where section_text <> ''""")
def t05(spark, d):
    mark = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n[[SECTION]] part "), (F.col("doc_id") % 3).cast("string"), F.lit("\n"))).otherwise("\n")
    return text.split_sections(docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), mark).alias("t")), "t").select("doc_id", "section_index", "section_title", "section_text")


@query("t06_split_comments", """with x as (select doc_id, case when doc_id % 3 = 0 then text || chr(10) || chr(10) || '[댓글]' || chr(10) || text || chr(10) || chr(10) || '[댓글]' || chr(10) || 'more' else text end as t from documents),
y as (select *, strpos(t, chr(10) || chr(10) || '[댓글]' || chr(10)) as pos from x)
select doc_id, 'body' as content_type, case when pos > 0 then left(t, pos - 1) else t end as part from y union all select doc_id, 'comment', substr(t, pos + 7) from y where pos > 0""")
def t06(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(text.COMMENTS), "text", F.lit(text.COMMENTS + "more"))).otherwise(F.col("text"))
    return text.split_comments(docs(spark, d).select("doc_id", t.alias("t")), "t").select("doc_id", "content_type", "part")


@query("t09_encoding_text", "select doc_id, case when doc_id % 2 = 0 then source || ' - ' || lang || chr(10) || text else text end as encoding_text from documents")
def t09(spark, d):
    return docs(spark, d).select("doc_id", text.encoding_text(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("text")).alias("encoding_text"))


@query("t10_search_query", "select doc_id, concat_ws(' ', nullif(trim(lang), ''), case when doc_id % 3 > 0 then nullif(trim(text), '') end) as q from documents")
def t10(spark, d):
    return docs(spark, d).select("doc_id", text.search_query(F.col("lang"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(" ")).alias("q"))


@query("t13_soften_profanity", f"""with x as (select doc_id, text || case doc_id % 3 when 0 then ' 개새끼 병신아' when 1 then ' 좆같은' else '' end as t from documents)
select doc_id, regexp_replace(t, '{"|".join(sorted(text.PROFANITY, key=len, reverse=True))}', '[욕설]', 'g') as masked from x""")
def t13(spark, d):
    k = F.col("doc_id") % 3
    t = F.concat("text", F.when(k == 0, " 개새끼 병신아").when(k == 1, " 좆같은").otherwise(""))
    return docs(spark, d).select("doc_id", text.soften_profanity(t, lookahead=False).alias("masked"))


CITED = "cx as (select doc_id, text || case doc_id % 4 when 0 then ' [자료 1] and [자료 3].' when 1 then ' [자료 9]' when 2 then ' [자료2].' else '' end as t from documents)"


def _cited(spark, d):
    k = F.col("doc_id") % 4
    t = F.concat("text", F.when(k == 0, " [자료 1] and [자료 3].").when(k == 1, " [자료 9]").when(k == 2, " [자료2].").otherwise(""))
    return docs(spark, d).select("doc_id", t.alias("t"))


@query("t14_citation_audit", rf"""with {CITED}, y as (select doc_id, t, list_transform(regexp_extract_all(t, '\[자료\s*(\d+)\]', 1), lambda x: x::int) as ids from cx)
select doc_id, len(ids) = 0 or len(list_filter(ids, lambda i: i < 1 or i > 3)) > 0 as warning,
  regexp_replace(regexp_replace(t, '\[자료\s*(?:0|[4-9]|[1-9]\d+)\]', '[출처 확인 필요]', 'g'), '\[자료\s*([1-3])\]', '[자료 \1](#source-\1)', 'g') as linked from y""")
def t14(spark, d):
    return _cited(spark, d).select("doc_id", text.citation_warning(F.col("t"), F.lit(3)).alias("warning"), text.link_citations(F.col("t"), F.lit(3)).alias("linked"))


def _answers(spark, d):
    whole = F.regexp_replace("text", "[.!?\n]", " ")
    cut = F.col("doc_id") % 5
    return docs(spark, d).select("doc_id", "n_chars", F.concat(
        F.lit("### 1. 의미\n"), whole, F.lit("다.\n## 2. 유행 이유\n"), whole, F.when(cut == 1, "and").otherwise("요. [자료 1]"), F.when(cut == 2, "").otherwise("\n**3. 사용법**\n좋음.\n4) 확인된 사용 맥락\n있음"),
        F.when(cut == 3, "\n5. 트렌드 맥락\n2024-01-30 기준 hot, z=1.25 이다.").when(cut == 4, "\n5. 트렌드 맥락\n2024년 1월 29일 flat z 3.1 and").otherwise(""),
    ).alias("t"))


# The answers as text, split again at their headings: parts, sentence ends, dates and scores are read from them.
ANSWERS = r"""an as (select doc_id, n_chars, '### 1. 의미' || chr(10) || w || '다.' || chr(10) || '## 2. 유행 이유' || chr(10) || w || case when doc_id % 5 = 1 then 'and' else '요. [자료 1]' end
    || case when doc_id % 5 = 2 then '' else chr(10) || '**3. 사용법**' || chr(10) || '좋음.' || chr(10) || '4) 확인된 사용 맥락' || chr(10) || '있음' end
    || case doc_id % 5 when 3 then chr(10) || '5. 트렌드 맥락' || chr(10) || '2024-01-30 기준 hot, z=1.25 이다.' when 4 then chr(10) || '5. 트렌드 맥락' || chr(10) || '2024년 1월 29일 flat z 3.1 and' else '' end as t
  from (select doc_id, n_chars, regexp_replace(text, '[.!?
]', ' ', 'g') as w from documents)),
pt as (select doc_id, n_chars, regexp_split_to_array(t, '(?m)^5[.)][ \t]*트렌드[ \t]*맥락[ \t]*
') as p from an)"""


@query("t15_audit_answer", rf"""with {ANSWERS}, hs as (select doc_id, p[2] as extra, regexp_extract_all(p[1], '(?m)^(?:#+\s*)?(?:\*\*)?([1-4])[.)]\s*(?:의미|유행\s*이유|사용법|확인된\s*사용\s*맥락)', 1) as heads,
  regexp_split_to_array(trim(p[1], chr(10) || ' '), '(?m)^(?:#+\s*)?(?:\*\*)?[1-4][.)]\s*(?:의미|유행\s*이유|사용법|확인된\s*사용\s*맥락)(?:\*\*)?[ 	]*
')[2:] as bodies from pt)
select doc_id, case when array_to_string(heads, ',') <> '1,2,3,4' then 'headings'
  when len(list_filter(bodies, lambda b: not regexp_matches(regexp_replace(b, '\[자료\s*\d+\]', '', 'g'), '[.!?다요죠음함됨임]\s*$'))) > 0 then 'cut_off'
  when extra is not null and not regexp_matches(extra, '[.!?다요죠음함됨임]\s*$') then 'trend_cut_off' else 'ok' end as audit from hs""")
def t15(spark, d):
    return _answers(spark, d).select("doc_id", text.audit_answer(F.col("t")).alias("audit"))


@query("t15_unify_headings", rf"""with {ANSWERS}, hs as (select doc_id, p[2] as extra, array_to_string(regexp_extract_all(p[1], '(?m)^(?:#+\s*)?(?:\*\*)?([1-4])[.)]\s*(?:의미|유행\s*이유|사용법|확인된\s*사용\s*맥락)', 1), ',') as heads,
  regexp_split_to_array(trim(p[1], chr(10) || ' '), '(?m)^(?:#+\s*)?(?:\*\*)?[1-4][.)]\s*(?:의미|유행\s*이유|사용법|확인된\s*사용\s*맥락)(?:\*\*)?[ 	]*
')[2:] as bodies from pt),
al as (select doc_id, heads, list_concat(bodies, case when extra is null then [] else [extra] end) as texts from hs)
select doc_id, case when heads = '1,2,3,4' and len(list_filter(texts, lambda b: not regexp_matches(regexp_replace(b, '\[자료\s*\d+\]', '', 'g'), '[.!?다요죠음함됨임]\s*$'))) = 0 then
  array_to_string(list_transform(texts, lambda b, i: '### ' || i || '. ' || (['의미', '유행 이유', '사용법', '확인된 사용 맥락', '트렌드 맥락'])[i] || chr(10) || chr(10) || trim(b, {BLANK})), chr(10) || chr(10)) end as unified from al""")
def t15_unified(spark, d):
    return _answers(spark, d).select("doc_id", text.unify_headings(F.col("t")).alias("unified"))


@query("t16_audit_trend_claims", rf"""with {ANSWERS}, cl as (select doc_id, n_chars, coalesce(p[2], '') as e from pt),
v as (select doc_id, n_chars, e, list_transform(regexp_extract_all(e, '(\d+\D+\d+\D+\d+)'), lambda x: list_transform(regexp_split_to_array(x, '\D+'), lambda n: n::int)) as days, list_transform(regexp_extract_all(e, 'z[ =]*(\d+\.\d+)', 1), lambda x: x::double) as z from cl)
select doc_id, case when trim(e) = '' then 'missing' when not list_contains(days, [2024, 1, 30]) then 'date' when not contains(e, 'hot') then 'status'
  when len(list_filter(z, lambda x: abs(x - case when n_chars % 2 = 0 then 1.2512 else 1.9 end) > 0.005 and abs(x + 0.4) > 0.05)) > 0 then 'score' else 'ok' end as audit from v""")
def t16(spark, d):
    scores = F.array(F.when(F.col("n_chars") % 2 == 0, 1.2512).otherwise(1.9), F.lit(-0.4))
    return _answers(spark, d).select("doc_id", text.audit_trend_claims(F.col("t"), F.lit("2024-01-30").cast("date"), F.lit("hot"), scores).alias("audit"))


@query("t17_parse_grade", r"""with x as (select doc_id, case doc_id % 4 when 0 then '점수: ' || (doc_id % 3) || chr(10) || '인용: ' || replace(text, chr(10), ' ') || chr(10) || '이유: ok' when 1 then 'grade ' || (doc_id % 3) when 2 then 'none' else '점수: 7' end as t from documents)
select doc_id, case when regexp_matches(t, '점수\s*:\s*[012]') then regexp_extract(t, '점수\s*:\s*([012])', 1)::int when regexp_matches(t, '[012]') then regexp_extract(t, '([012])', 1)::int end as score,
  case when regexp_matches(t, '점수\s*:\s*[012]') then trim(regexp_extract(t, '인용\s*:\s*([^\n]+)', 1)) when regexp_matches(t, '[012]') then '' end as quote,
  case when regexp_matches(t, '점수\s*:\s*[012]') then trim(regexp_extract(t, '이유\s*:\s*([^\n]+)', 1)) when regexp_matches(t, '[012]') then '' end as reason from x""")
def t17(spark, d):
    k, n = F.col("doc_id") % 4, (F.col("doc_id") % 3).cast("string")
    t = F.when(k == 0, F.concat(F.lit("점수: "), n, F.lit("\n인용: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n이유: ok"))).when(k == 1, F.concat(F.lit("grade "), n)).when(k == 2, "none").otherwise("점수: 7")
    return docs(spark, d).select("doc_id", text.parse_grade(t).alias("g")).select("doc_id", "g.score", "g.quote", "g.reason")


# ------------------------------------------------------------------ urls

HOST = "lower(regexp_extract({u}, '^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
PATH = "regexp_extract({u}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
WRAPPED = "ux as (select page_id, url, case page_id % 4 when 0 then url when 1 then '/goto?x=1&url=' || url_encode(url) when 2 then 'https:///nohost' else '/l/?u=' || url_encode(url_encode(url)) end as raw from pages)"


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


def _wrapped(spark, d):
    k, u = F.col("page_id") % 4, F.col("url")
    raw = F.when(k == 0, u).when(k == 1, F.concat(F.lit("/goto?x=1&url="), F.url_encode(u))).when(k == 2, "https:///nohost").otherwise(F.concat(F.lit("/l/?u="), F.url_encode(F.url_encode(u))))
    return _pages(spark, d).select("page_id", raw.alias("raw"))


@query("t11_repair_url", "select page_id, case when page_id % 4 = 2 then '링크 없음' else url end as fixed from pages")
def t11(spark, d):
    return _wrapped(spark, d).select("page_id", urls.repair_url(F.col("raw")).alias("fixed"))


@query("t12_source_label", f"select page_id, case when contains({HOST.format(u='url')}, 'blog.') then 'blog' when contains({HOST.format(u='url')}, 'example.org') then 'org' else 'web' end as label from pages")
def t12(spark, d):
    return _pages(spark, d).select("page_id", urls.source_label(F.col("url"), {"blog.": "blog", "example.org": "org"}).alias("label"))


@query("d03_canonical_key", "select page_id, case page_id % 3 when 0 then 'naver_blog::u' || (page_id % 7) || '::' || page_id when 1 then 'naver_blog::u' || (page_id % 7) || '::' || (page_id - 1) end as canonical from pages")
def d03(spark, d):
    i, user = F.col("page_id"), F.concat(F.lit("u"), (F.col("page_id") % 7).cast("string"))
    u = F.when(i % 3 == 0, F.concat(F.lit("https://m.blog.naver.com/"), user, F.lit("/"), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("http://blog.naver.com/PostView.naver?blogId="), user, F.lit("&logNo="), (i - 1).cast("string"))).otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", urls.canonical_key(u).alias("canonical"))


@query("d04_source_identity", f"select page_id, {HOST.format(u='url')} as host, regexp_replace({PATH.format(u='url')}, '/+$', '') as path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as query from pages")
def d04(spark, d):
    return _pages(spark, d).select("page_id", urls.source_identity(F.col("url")).alias("s")).select("page_id", "s.host", "s.path", "s.query")


# ------------------------------------------------------------------ gates

GATE = "lower(regexp_replace(coalesce({c}, ''), '[\\s~!?.,''\"…]+', '', 'g'))"


@query("f01_gate_relevant", f"with {POSTS} select doc_id, contains({GATE.format(c='''concat_ws(' ', title, body)''')}, {GATE.format(c='keyword')}) as relevant from posts")
def f01(spark, d):
    return posts(spark, d).select("doc_id", gates.relevant(F.col("keyword"), F.col("title"), F.col("body")).alias("relevant"))


@query("f02_gate_min_length", f"select doc_id from documents where length(trim(text, {BLANK})) >= 30")
def f02(spark, d):
    return docs(spark, d).where(gates.long_enough(F.col("text"))).select("doc_id")


@query("f03_gate_age", "select event_id from events where ts >= timestamp '2027-01-15 00:00:00' - interval 1095 days")
def f03(spark, d):
    return table(spark, d, "events").where(gates.recent(F.col("ts"), F.lit("2027-01-15 00:00:00").cast("timestamp_ntz"))).select("event_id")


@query("f04_parse_post_date", """select event_id, case event_id % 5 when 0 then date_trunc('minute', ts) when 1 then date_trunc('day', ts) when 2 then date_trunc('minute', ts) when 3 then timestamp '2024-01-30 12:00:00' end as posted from events where event_id % 10 <> 9""")
def f04(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.date_format("ts", "yyyy.MM.dd HH:mm")).when(k == 1, F.date_format("ts", " yy.MM.dd")).when(k == 2, F.date_format("ts", "yy/MM/dd HH:mm")).when(k == 3, F.date_format("ts", "HH:mm")).otherwise("yesterday")
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"), F.when(F.col("event_id") % 10 == 9, "drops").otherwise("keeps").alias("source"))
    out = gates.dated(rows, "raw", "posted", F.lit("2024-01-30 12:00:00").cast("timestamp"), dropping=("drops",))
    return out.select("event_id", F.col("posted").cast("timestamp_ntz").alias("posted"))


@query("f05_gate_score", "select event_id from events where value / 100 >= 0.3")
def f05(spark, d):
    return table(spark, d, "events").where(F.col("value") / 100 >= 0.3).select("event_id")


@query("f06_gate_fetchable", f"with {WRAPPED} select page_id, regexp_matches(raw, '^(?i:https?)://') as fetchable from ux")
def f06(spark, d):
    return _wrapped(spark, d).select("page_id", gates.fetchable(F.col("raw")).alias("fetchable"))


@query("f07_gate_content_url", "select page_id, page_id % 4 <> 1 as content from pages")
def f07(spark, d):
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    u = F.when(k == 0, F.concat(F.lit("https://www.instagram.com/p/"), i, F.lit("/"))).when(k == 1, F.concat(F.lit("https://instagram.com/user"), i)).when(k == 2, F.concat(F.lit("https://instagram.com/reel/"), i)).otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", urls.is_content(u).alias("content"))


@query("f08_keyword_shape", r"""with x as (select doc_id, trim(case when doc_id % 3 = 0 then source else split_part(text, chr(10), 1) end) as k from documents), y as (select doc_id, len(list_filter(regexp_split_to_array(k, '[\s\p{Z}]+'), lambda w: w <> ''))::int as n from x)
select doc_id, n <= 3 as accepted, n as n_words, case when n > 3 then 'sentence_like' end as reason from y""")
def f08(spark, d):
    k = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.substring_index("text", "\n", 1))
    return docs(spark, d).select("doc_id", gates.keyword_shape(k).alias("s")).select("doc_id", "s.accepted", "s.n_words", "s.reason")


@query("f09_keyword_error", """with x as (select doc_id, trim(case doc_id % 4 when 0 then source when 1 then '' else text end) as k from documents)
select doc_id, case when k = '' then 'empty' when length(k) > 50 then 'too_long' when regexp_matches(k, '[\\x00-\\x1f]') then 'control_character' end as error from x""".replace("\\\\", "\\"))
def f09(spark, d):
    return docs(spark, d).select("doc_id", gates.keyword_error(F.when(F.col("doc_id") % 4 == 0, F.col("source")).when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("text"))).alias("error"))


MATCH = f"""{POSTS}, nm as (select doc_id, {norm('keyword')} as k, {norm('title')} as t, {norm('body')} as b from posts),
mt as (select doc_id, contains(t, k) or contains(b, k) as matched, case when contains(t, k) then 'title' when not contains(b, k) then 'none' when strpos(b, k) - 1 < 200 then 'early' else 'late' end as position,
  (((length(t) - length(replace(t, k, ''))) + (length(b) - length(replace(b, k, '')))) / length(k))::int as "count" from nm)"""


@query("f10_match_keyword", f"with {MATCH} select * from mt")
def f10(spark, d):
    m = text.match_keyword(F.col("keyword"), F.col("title"), F.col("body"))
    return posts(spark, d).select("doc_id", m.alias("m")).select("doc_id", "m.matched", "m.position", "m.count")


@query("f11_judge_documents", f"""with {MATCH}, ck as (select doc_id, unnest(range(0, greatest(1, (length(text) + 499) // 500))) as chunk_index from documents)
select doc_id as parent_id, chunk_index::int as chunk_index, matched as is_relevant, position as relevance_position, "count" as relevance_match_count from ck join mt using (doc_id)""")
def f11(spark, d):
    p = posts(spark, d).select(F.col("doc_id").alias("_id"), "keyword", "title", F.col("body").alias("clean_content"))
    n = F.greatest(F.lit(1), F.floor((F.length("text") + 499) / 500)).cast("int")
    chunks = docs(spark, d).select(F.col("doc_id").alias("parent_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return gates.judge_documents(p, chunks)


CHUNKS = f"{MATCH}, ch as (select doc_id as chunk_id, p.keyword, p.source, p.title, p.body as text, case when doc_id % 5 < 4 then matched end as is_relevant from posts p join mt using (doc_id))"


def chunks(spark, d):
    m = text.match_keyword(F.col("keyword"), F.col("title"), F.col("body"), nfc=False)["matched"]
    return posts(spark, d).select(F.col("doc_id").alias("chunk_id"), "keyword", "source", "title", F.col("body").alias("text"), F.when(F.col("doc_id") % 5 < 4, m).alias("is_relevant"))


def _search_queries(spark, d):
    """A query for each keyword and language that the documents have; some with a source list, some with a relevance filter."""
    x = posts(spark, d).join(docs(spark, d).select("doc_id", "lang"), "doc_id").select("keyword", "lang").distinct()
    return x.select(
        F.concat_ws("__", "keyword", "lang").alias("query_id"), "keyword",
        F.when(F.col("lang") == "de", F.array(F.lit("src1"), F.lit("src2"), F.lit("src3"))).alias("sources"), F.when(F.col("lang") == "fr", True).alias("is_relevant"),
    )


@query("f12_search_filter", f"""with {CHUNKS}, q as (select distinct p.keyword || '__' || lang as query_id, p.keyword, lang from posts p join documents using (doc_id))
select query_id, chunk_id from q join ch using (keyword) where (lang <> 'de' or ch.source in ('src1', 'src2', 'src3')) and (lang <> 'fr' or is_relevant)""")
def f12(spark, d):
    return gates.search_filter(chunks(spark, d), _search_queries(spark, d)).select("query_id", "chunk_id")


@query("f13_valid_chunk", f"""with {CHUNKS} select chunk_id from ch where length(trim(text, {BLANK})) >= 30 and is_relevant is distinct from false and contains({norm("text || title")}, {norm('keyword')})""")
def f13(spark, d):
    c = chunks(spark, d)
    return c.where(gates.valid_chunk(F.col("keyword"), F.lit("https://a.example/x"), F.col("title"), F.col("text"), F.col("is_relevant"))).select("chunk_id")


@query("f14_exclude_homonyms", f"with {POSTS} select doc_id from posts where not (keyword = 'ention' and (contains({norm('title')}, 'theon') or contains({norm('title')}, 'thewh'))) and not (keyword = 'inging' and contains({norm('title')}, 'anthe'))")
def f14(spark, d):
    p = posts(spark, d)
    h = p.select("keyword").distinct().select("keyword", F.explode(F.when(F.col("keyword") == "ention", F.array(F.lit("the on"), F.lit("The wh"))).when(F.col("keyword") == "inging", F.array(F.lit("an The")))).alias("expression"))
    return gates.exclude_homonyms(p, h).select("doc_id")


@query("f15_flag_blocked", f"""with x as (select page_id, case page_id % 6 when 0 then 403 when 1 then 503 else 200 end as status, case when page_id % 5 = 0 then html || ' Access Denied ' else html end as body from pages)
select page_id, status in (403, 429, 503) or (length(body) <= 3000 and regexp_matches(body, '{"|".join(gates.BLOCK_SIGNALS)}')) as blocked from x""")
def f15(spark, d):
    k = F.col("page_id") % 6
    body = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(" Access Denied "))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", gates.blocked(F.when(k == 0, 403).when(k == 1, 503).otherwise(200), body).alias("blocked"))


@query("f16_fully_irrelevant", f"""with {CHUNKS} select source as parent_id, count(*) as n_chunks from (select chunk_id // 3 as source, is_relevant from ch) group by 1 having bool_and(coalesce(not is_relevant, false))""")
def f16(spark, d):
    return gates.fully_irrelevant(chunks(spark, d).select(F.floor(F.col("chunk_id") / 3).cast("long").alias("parent_id"), "is_relevant"))
