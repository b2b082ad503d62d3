"""Shared pieces of the registered queries: tables, the driver tables as series, SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.operators import series

AS_OF = "2024-01-30"
CHANNELS = {"view": "search", "click": "blog", "signup": "cafe", "purchase": "third"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(text: str = AS_OF):
    return F.lit(text).cast("date")


def channel_of(event_type):
    out = F.when(event_type == "view", "search")
    for kind, channel in list(CHANNELS.items())[1:]:
        out = out.when(event_type == kind, channel)
    return out


def daily(spark: SparkSession, sf_dir: str, keywords: int = 6) -> DataFrame:
    """events as daily series of `keywords` keywords and four channels."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*CHANNELS))
    return series.daily_counts(e, F.concat(F.lit("kw"), F.col("user_id") % keywords), channel_of(F.col("event_type")), F.col("ts"))


def daily_sql(keywords: int = 6, name: str = "daily") -> str:
    cases = " ".join(f"when '{k}' then '{c}'" for k, c in CHANNELS.items())
    return f"""{name} as (
  select 'kw' || (user_id % {keywords}) as keyword, case event_type {cases} end as channel, ts::date as day, count(*)::double as value
  from events where event_type in ('view', 'click', 'signup', 'purchase') group by all)"""


STATS_SQL = """st as (
  select keyword, channel, count(*) as n, max(value) filter (rn = 1) as today, coalesce(avg(value) filter (rn > 1), 0) as bavg,
    coalesce(avg((value > 0)::int) filter (rn > 1), 0) as nz, max(value) as mx, count(*) filter (rn > 1) as nb,
    quantile_cont(value, 0.5) filter (rn > 1) as med, quantile_cont(value, 0.75) filter (rn > 1) - quantile_cont(value, 0.25) filter (rn > 1) as iqr
  from (select *, row_number() over (partition by keyword, channel order by day desc) as rn from s) group by keyword, channel),
zs as (
  select keyword, channel, n, bavg, nz, n >= 7 and mx > 0 as active,
    case when nb < 2 then 0.0 else (today - med) / greatest(iqr, case when channel in ('blog', 'cafe') then 5.0 else 2.0 end) end as z from st)"""

BAND_SQL = "case when {z} > 2 then 'hot' when {z} >= 0.5 then 'rising' when {z} > -0.5 then 'flat' when {z} >= -2 then 'declining' when {z} is not null then 'gone' end"

SCORE_SQL = (
    """s as (select * from daily where day < date '2024-01-30'),
"""
    + STATS_SQL
    + """,
kws as (select distinct keyword from s),
p as (
  select keyword, coalesce(max(z) filter (channel = 'search'), 0.0) as search_z, coalesce(bool_or(active) filter (channel = 'search'), false) as search_usable,
    coalesce(max(z) filter (channel = 'blog' and active), 0.0) as blog_z, coalesce(max(z) filter (channel = 'cafe' and active), 0.0) as cafe_z,
    count(*) filter (channel in ('blog', 'cafe') and active) as m_on,
    sum(case when channel in ('blog', 'cafe') and active then 0.5 * z else 0 end) as m_z, sum(case when channel in ('blog', 'cafe') and active then 0.5 * bavg else 0 end) as m_avg,
    coalesce(bool_or(active) filter (channel = 'third'), false) as t_on, coalesce(max(z) filter (channel = 'third'), 0.0) as t_z,
    coalesce(max(bavg) filter (channel = 'third'), 0.0) as t_avg, coalesce(max(nz) filter (channel = 'third'), 0.0) as t_nz
  from zs group by keyword),
g as (
  select p.keyword, search_z, search_usable, blog_z, cafe_z, case when m_on > 0 then m_z / (0.5 * m_on) else 0.0 end as mention_z,
    case when status = 'unavailable' or not t_on then 0.0 else t_z end as third_z,
    case when not search_usable then 'search_excluded_no_signal' end as search_note,
    case when m_on = 0 then 'mention_excluded_no_signal' when m_avg / (0.5 * m_on) < 10 then 'mention_excluded_low_baseline' end as mention_note,
    case when status = 'unavailable' then 'third_unavailable' when not t_on then 'third_excluded_no_signal' when t_avg < 10 then 'third_excluded_low_baseline'
      when t_nz < 0.5 then 'third_excluded_sparse_signal' end as third_note
  from p left join status using (keyword)),
w as (
  select *, case when mention_note is null and third_note is not null then 0.6 else 0.4 end as ws,
    case when mention_note is not null then 0.0 when third_note is not null then 0.4 else 0.3 end as wm, case when third_note is null then 0.2 else 0.0 end as wt,
    case when abs(blog_z) >= abs(cafe_z) then blog_z else cafe_z end as loud from g),
f as (
  select *, case when search_usable then greatest(least((ws * search_z + wm * mention_z + wt * third_z) / (ws + wm + wt), 8.0), -8.0) else 0.0 end as final_z,
    search_usable and mention_note is null as has_m, search_usable and third_note is null as has_t from w),
score as (
  select keyword, search_z, blog_z, cafe_z, mention_z, third_z, final_z,
    case when search_usable then """
    + BAND_SQL.format(z="final_z")
    + """ else 'insufficient' end as status,
    case when not search_usable then '' when has_m and has_t then 'search+mention+third' when has_m then 'search+mention' when has_t then 'search+third' else 'search' end as sources,
    case when (has_m and abs(search_z - loud) > 10 and search_z * loud < 0) or (has_t and abs(search_z - third_z) > 10 and search_z * third_z < 0)
      or (has_m and has_t and abs(loud - third_z) > 10 and loud * third_z < 0) then 'supply_demand_divergence' else '' end as flags,
    coalesce(nullif(concat_ws('+', search_note, mention_note, third_note), ''), 'ensemble') as ensemble_note
  from f)"""
)
STATUS_SQL = "status as (select 'kw' || (user_id % {n}) as keyword, case when count(*) filter (event_type = 'error') % 2 = 1 then 'unavailable' else 'ok' end as status from events group by 1)"


def third_status(spark: SparkSession, sf_dir: str, keywords: int = 6) -> DataFrame:
    """The third source counts as failed for keywords with an odd number of error events."""
    e = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("kw"), F.col("user_id") % keywords).alias("keyword"))
    return e.agg(F.count_if(F.col("event_type") == "error").alias("n")).select("keyword", F.when(F.col("n") % 2 == 1, "unavailable").otherwise("ok").alias("status"))
