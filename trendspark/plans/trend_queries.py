"""Queries of the series and trend operators, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.operators import series, trend
from trendspark.plans.common import BAND_SQL, SCORE_SQL, STATS_SQL, STATUS_SQL, daily, daily_sql, day, table, third_status

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


r6 = lambda c: F.round(F.col(c), 6).alias(c)


@query("a04_daily_counts", f"with {daily_sql()} select * from daily")
def a04(spark, d):
    return daily(spark, d)


@query("ts01_fill_search_series", f"""with {daily_sql(150)},
s as (select * from daily where channel = 'search' and day between date '2023-12-31' and date '2024-01-30'),
b as (select keyword, greatest(date '2024-01-28', max(day)) as last from s group by 1),
d as (select keyword, unnest(generate_series(timestamp '2023-12-31', last::timestamp, interval 1 day))::date as day from b)
select d.keyword, 'search' as channel, d.day, coalesce(value, 0.0) as value from d left join s using (keyword, day)""")
def ts01(spark, d):
    return series.fill_search_series(daily(spark, d, 150).where("channel = 'search'"), day())


META_SQL = """meta as (select 'kw' || (user_id % 20) as keyword, case event_type when 'click' then 'blog' else 'cafe' end as channel, count(*) as total, 100 as pageable
  from events where event_type in ('click', 'signup') group by all)"""


def _meta(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "signup"))
    return e.groupBy(F.concat(F.lit("kw"), F.col("user_id") % 20).alias("keyword"), F.when(F.col("event_type") == "click", "blog").otherwise("cafe").alias("channel")).agg(F.count("*").alias("total")).withColumn("pageable", F.lit(100))


COMPLETE_SQL = f"""{daily_sql(20)}, {META_SQL},
old as (select keyword, channel, bool_or(day < date '2024-01-10' - 5) as old from daily where day >= date '2024-01-04' group by all),
complete as (select keyword, channel, coalesce(total <= pageable, false) or coalesce(old, false) as complete from meta left join old using (keyword, channel))"""


@query("ts03_series_completeness", f"with {COMPLETE_SQL} select * from complete")
def ts03(spark, d):
    return series.series_completeness(_meta(spark, d), daily(spark, d, 20).where(F.col("day") >= day("2024-01-04")), day("2024-01-10"), 5)


@query("ts02_fill_mention_series", f"""with {COMPLETE_SQL},
s as (select * from daily where day between date '2024-01-05' and date '2024-01-10'),
b as (select c.keyword, c.channel, case when complete or min(day) is null then date '2024-01-05' else (min(day) + 1)::date end as first
  from complete c left join s using (keyword, channel) group by c.keyword, c.channel, complete),
x as (select keyword, channel, unnest(generate_series(first::timestamp, timestamp '2024-01-10', interval 1 day))::date as day from b)
select x.keyword, x.channel, x.day, coalesce(value, 0.0) as value from x left join s using (keyword, channel, day)""")
def ts02(spark, d):
    base = daily(spark, d, 20)
    return series.fill_mention_series(base, ts03(spark, d), day("2024-01-10"), 5)


@query("ts04_drop_incomplete", f"with {daily_sql()} select * from daily where day < date '2024-01-30' and not (day = date '2024-01-29' and value < 5)")
def ts04(spark, d):
    marked = daily(spark, d).withColumn("partial", (F.col("day") == day("2024-01-29")) & (F.col("value") < 5))
    return series.drop_incomplete(marked, day(), "partial").drop("partial")


Z_SQL = f"with {daily_sql(20)}, s as (select * from daily where channel = 'search' and day < date '2024-01-30'), {STATS_SQL} "


def _z(spark, d):
    return trend.robust_z(series.drop_incomplete(daily(spark, d, 20).where("channel = 'search'"), day()), ["keyword"], 2.0)


@query("ts05_robust_z", Z_SQL + "select keyword, round(z, 6) as z from zs")
def ts05(spark, d):
    return _z(spark, d).select("keyword", r6("z"))


@query("ts06_classify_trend", Z_SQL + f"select keyword, {BAND_SQL.format(z='z')} as status from zs")
def ts06(spark, d):
    return _z(spark, d).select("keyword", trend.classify_trend(F.col("z")).alias("status"))


@query("ts07_signal_gate", Z_SQL + "select keyword, n::int as n, active from zs")
def ts07(spark, d):
    return _z(spark, d).select("keyword", "n", "active")


@query("ts08_baseline", Z_SQL + "select keyword, round(bavg, 6) as baseline_avg, round(nz, 6) as nonzero from zs")
def ts08(spark, d):
    return _z(spark, d).select("keyword", r6("baseline_avg"), r6("nonzero"))


FULL_SQL = f"with {daily_sql()}, {STATUS_SQL.format(n=6)}, {SCORE_SQL} "


def _scores(spark, d):
    return trend.score_trends(daily(spark, d), third_status(spark, d), day())


@query("ts09_combine_channels", FULL_SQL + "select keyword, round(blog_z, 6) as blog_z, round(cafe_z, 6) as cafe_z, round(mention_z, 6) as mention_z from score")
def ts09(spark, d):
    return _scores(spark, d).select("keyword", r6("blog_z"), r6("cafe_z"), r6("mention_z"))


@query("ts10_gate_sources", FULL_SQL + "select keyword, ensemble_note from score")
def ts10(spark, d):
    return _scores(spark, d).select("keyword", "ensemble_note")


@query("ts11_ensemble", FULL_SQL + "select keyword, round(final_z, 6) as final_z, status, sources from score")
def ts11(spark, d):
    return _scores(spark, d).select("keyword", r6("final_z"), "status", F.concat_ws("+", "sources").alias("sources"))


@query("ts12_divergence_flags", FULL_SQL + "select keyword, flags from score")
def ts12(spark, d):
    return _scores(spark, d).select("keyword", F.concat_ws(",", "flags").alias("flags"))


@query("ts13_score_trends", f"with {daily_sql(40)}, {STATUS_SQL.format(n=40)}, {SCORE_SQL} select keyword, round(search_z, 6) as search_z, round(mention_z, 6) as mention_z, round(third_z, 6) as third_z, round(final_z, 6) as final_z, status, sources, flags, ensemble_note from score")
def ts13(spark, d):
    s = trend.score_trends(daily(spark, d, 40), third_status(spark, d, 40), day())
    return s.select("keyword", r6("search_z"), r6("mention_z"), r6("third_z"), r6("final_z"), "status", F.concat_ws("+", "sources").alias("sources"), F.concat_ws(",", "flags").alias("flags"), "ensemble_note")


OBS_SQL = f"""with {daily_sql(20)}, r as (select *, max(day) over (partition by keyword, channel) - day as ago from daily where day < date '2024-01-30'),
o as (select keyword, channel, count(*) as n_days, min(day) as first_day, arg_min(value, day) as first_value, max(day) as last_day, arg_max(value, day) as last_value,
  max(value) as peak_value, count(*) filter (ago <= 13) as n14, avg(value) filter (ago <= 6) as recent, avg(value) filter (ago between 7 and 13) as previous from r group by all),
k as (select keyword, channel, min(day) as peak_day from r join o using (keyword, channel) where value = peak_value group by all) """


@query("ts14_observations", OBS_SQL + "select keyword, channel, n_days, first_day, first_value, last_day, last_value, peak_day, peak_value from o join k using (keyword, channel)")
def ts14(spark, d):
    return trend.trend_observations(daily(spark, d, 20), day()).select("keyword", "channel", "n_days", "first_day", "first_value", "last_day", "last_value", "peak_day", "peak_value")


@query("ts15_week_over_week", OBS_SQL + "select keyword, channel, round(case when n14 = 14 then recent end, 6) as recent_avg, round(case when n14 = 14 then previous end, 6) as previous_avg, round(case when n14 = 14 and previous > 0 then (recent / previous - 1) * 100 end, 6) as change_pct from o")
def ts15(spark, d):
    return trend.trend_observations(daily(spark, d, 20), day()).select("keyword", "channel", r6("recent_avg"), r6("previous_avg"), r6("change_pct"))


RATE_SQL = f"""with {daily_sql(20)}, t as (select *, row_number() over (partition by keyword, channel order by day desc) as rn from daily),
c as (select keyword, channel, max(value) filter (rn = 1) as last, avg(value) filter (rn > 1) as base from t group by all),
rate as (select keyword, channel, case when base > 0 then (last - base) / base * 100 end as change_rate from c) """


@query("ts16_change_rate", RATE_SQL + "select keyword, channel, round(change_rate, 6) as change_rate from rate")
def ts16(spark, d):
    return trend.change_rate(daily(spark, d, 20), ["keyword", "channel"]).select("keyword", "channel", r6("change_rate"))


@query("ts17_direction", RATE_SQL + "select keyword, channel, case when change_rate > 5 then 'up' when change_rate < -5 then 'down' when change_rate is not null then 'flat' end as direction from rate")
def ts17(spark, d):
    rates = trend.change_rate(daily(spark, d, 20), ["keyword", "channel"])
    return rates.select("keyword", "channel", trend.direction_label(F.col("change_rate"), F.lit(None).cast("double")).alias("direction"))


@query("ts18_primary_series", f"""with {daily_sql(150)}, c as (select keyword, channel, count(*) as n from daily where channel in ('search', 'cafe', 'third') group by all having count(*) >= 9)
select keyword, arg_min(channel, list_position(['search', 'cafe', 'third'], channel)) as channel, arg_min(n, list_position(['search', 'cafe', 'third'], channel)) as n from c group by 1""")
def ts18(spark, d):
    return trend.primary_series(daily(spark, d, 150), ("search", "cafe", "third"), 9)


@query("ts19_turning_points", f"""with {daily_sql()}, x as (select *, lag(value) over w as b, lead(value) over w as a, max(value) over p - min(value) over p as span from daily
  window w as (partition by keyword, channel order by day), p as (partition by keyword, channel)),
y as (select keyword, channel, day, value, value - least(a, b) as prominence from x where value > b and value > a and span > 0 and value - least(a, b) >= 0.15 * span),
z as (select *, row_number() over (partition by keyword, channel order by prominence desc, day)::int as rank from y) select * from z where rank <= 6""")
def ts19(spark, d):
    return trend.turning_points(daily(spark, d), ["keyword", "channel"])


@query("ts20_tier_lines", f"""with {daily_sql()}, s as (select keyword, channel, avg(value) as m, stddev_pop(value) as sd, min(value) as lo, max(value) as hi from daily group by all),
l as (select *, m + z * sd as line from s, (values (-2.0::double), (-0.5), (0.5), (2.0)) as v(z))
select keyword, channel, z, round(line, 6) as line, round((line - lo) / (hi - lo), 6) as place from l where line >= lo and line <= hi and hi > lo""")
def ts20(spark, d):
    return trend.tier_lines(daily(spark, d), ["keyword", "channel"]).select("keyword", "channel", "z", r6("line"), r6("place"))


@query("ts21_usable_z", FULL_SQL + "select keyword, round(case when status <> 'insufficient' then final_z end, 6) as usable_z from score")
def ts21(spark, d):
    return trend.usable_z(_scores(spark, d).withColumn("z_score", F.col("final_z"))).select("keyword", r6("usable_z"))


@query("ts22_trend_context", FULL_SQL + """select keyword, case when status = 'insufficient' then 'as of 2024-01-30' || chr(10) || 'status: insufficient data; no judgement, no rates or stages to be guessed'
  else '[trend] as of 2024-01-30' || chr(10) || 'status: ' || status || ' (z ' || round(final_z, 2)::decimal(12,2)::varchar || ', sources: ' || sources || ')' || case when flags <> '' then ' (' || flags || ')' else '' end end as context from score""")
def ts22(spark, d):
    return trend.render_trend_context(_scores(spark, d).withColumn("date", day()))


HISTORY_SQL = f"""with {daily_sql(40)}, x as (select keyword, day as date, value from daily where channel = 'search'),
hist as (select keyword, date, case when value::bigint % 7 = 0 then 'insufficient' else 'ok' end as status, value / 4 - 1 as final_z, value as z_score from x),
latest as (select * from hist qualify row_number() over (partition by keyword order by date desc) = 1) """


def _history(spark, d):
    x = daily(spark, d, 40).where("channel = 'search'")
    return x.select("keyword", F.col("day").alias("date"), F.when(F.col("value").cast("long") % 7 == 0, "insufficient").otherwise("ok").alias("status"), (F.col("value") / 4 - 1).alias("final_z"), F.col("value").alias("z_score"))


def _keywords(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("kw"), F.col("user_id") % 50).alias("keyword")).distinct()


def _daily_list(spark, d):
    return table(spark, d, "events").where("user_id % 50 < 45 and user_id % 3 > 0").select(F.concat(F.lit("kw"), F.col("user_id") % 50).alias("keyword")).distinct()


BOARD_SQL = HISTORY_SQL + """, kws as (select distinct 'kw' || (user_id % 50) as keyword from events), dl as (select distinct 'kw' || (user_id % 50) as keyword from events where user_id % 50 < 45 and user_id % 3 > 0),
board as (select k.keyword, l.date, l.status, l.final_z, l.z_score, dl.keyword is not null as is_daily from kws k left join latest l using (keyword) left join dl using (keyword)) """


def _board(spark, d):
    return trend.leaderboard(_keywords(spark, d), _history(spark, d), _daily_list(spark, d))


@query("a03_latest_rows", HISTORY_SQL + "select * from latest")
def a03(spark, d):
    return trend.latest_rows(_history(spark, d), ["keyword"], "date")


@query("j07_leaderboard", BOARD_SQL + "select * from board")
def j07(spark, d):
    return _board(spark, d)


@query("w01_rank_leaderboard", BOARD_SQL + """, u as (select *, case when coalesce(status, 'insufficient') <> 'insufficient' then coalesce(final_z, z_score) end as usable_z from board)
select keyword, usable_z, row_number() over (order by usable_z is null, usable_z desc, keyword)::int as rank from u""")
def w01(spark, d):
    return trend.rank_leaderboard(_board(spark, d)).select("keyword", "usable_z", "rank")


@query("w02_leaderboard_groups", BOARD_SQL + """, n as (select max(date) filter (is_daily) as newest from board)
select keyword, case when status is null then 'pending' when not coalesce(is_daily and date = newest, false) then 'archived' when status = 'insufficient' then 'no_signal' else 'ranked' end as "group" from board, n""")
def w02(spark, d):
    return trend.leaderboard_groups(_board(spark, d)).select("keyword", "group")


@query("j08_merge_channels", f"with {daily_sql(150)} select keyword, 'merged' as channel, day, sum(value) as value from daily where channel in ('blog', 'cafe') group by keyword, day having count(distinct channel) = 2")
def j08(spark, d):
    return series.merge_channels(daily(spark, d, 150), ["blog", "cafe"])


@query("j15_calendar_spine", f"""with {daily_sql(150)}, s as (select * from daily where channel = 'cafe' and day between date '2023-12-31' and date '2024-01-30'),
k as (select distinct keyword from s), x as (select keyword, unnest(generate_series(timestamp '2023-12-31', timestamp '2024-01-30', interval 1 day))::date as day from k)
select x.keyword, 'cafe' as channel, x.day, coalesce(value, 0.0) as value from x left join s using (keyword, day)""")
def j15(spark, d):
    return series.fill_search_series(daily(spark, d, 150).where("channel = 'cafe'"), day(), lag=0)


@query("leaderboard", FULL_SQL + "select keyword, status, round(final_z, 6) as final_z, row_number() over (order by status = 'insufficient', final_z desc, keyword)::int as rank from score")
def flagship(spark, d):
    scores = _scores(spark, d).withColumn("z_score", F.col("final_z"))
    return trend.rank_leaderboard(scores).select("keyword", "status", r6("final_z"), "rank")
