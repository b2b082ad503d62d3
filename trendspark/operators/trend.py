"""Trend scoring: robust z, signal gates, source ensemble, observations, leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.functions.order import numbered

# Fixed values of the scoring rules.
MIN_POINTS = 7
MIN_IQR = {"search": 2.0, "blog": 5.0, "cafe": 5.0, "third": 2.0}
CHANNEL_WEIGHT = {"blog": 0.5, "cafe": 0.5}
SOURCE_WEIGHT = {"search": 0.4, "mention": 0.3, "third": 0.2}
PAIR_WEIGHT = {"search": 0.6, "mention": 0.4}
MIN_BASELINE = 10.0
MIN_NONZERO = 0.5
CLIP = 8.0
DIVERGENCE = 10.0
INSUFFICIENT = "insufficient"


def sorted_values(day: str = "day", value: str = "value", where: Column | None = None) -> Column:
    """Aggregate: the values of a group in order of days. Series have about as many rows as the window has days."""
    item = F.struct(day, value)
    return F.transform(F.array_sort(F.collect_list(F.when(where, item) if where is not None else item)), lambda x: x[value])


def quantile(values: Column, q: float) -> Column:
    """Inclusive quantile with linear interpolation of a sorted array."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (at - low) * (b - a)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def series_stats(values: Column, min_iqr: float) -> Column:
    """Struct of a sorted-by-day array: n, z, baseline_avg, nonzero, active. The last value is today's, the rest the baseline.

    z is 0 with fewer than two baseline values; a series is active with MIN_POINTS values and one over 0.
    """
    base = F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))
    ordered = F.array_sort(base)
    spread = F.greatest(quantile(ordered, 0.75) - quantile(ordered, 0.25), F.lit(min_iqr))
    z = F.when(F.size(base) < 2, 0.0).otherwise((F.get(values, F.size(values) - 1) - quantile(ordered, 0.5)) / spread)
    some = F.size(base) > 0
    return F.struct(
        F.size(values).alias("n"),
        z.alias("z"),
        F.when(some, _mean(base)).otherwise(0.0).alias("baseline_avg"),
        F.when(some, F.size(F.filter(base, lambda x: x > 0)) / F.size(base)).otherwise(0.0).alias("nonzero"),
        ((F.size(values) >= MIN_POINTS) & F.exists(values, lambda x: x > 0)).alias("active"),
    )


def robust_z(series: DataFrame, by: list[str], min_iqr: float) -> DataFrame:
    stats = series.groupBy(*by).agg(sorted_values().alias("v")).withColumn("s", series_stats(F.col("v"), min_iqr))
    return stats.select(*by, F.col("s.n").alias("n"), F.col("s.z").alias("z"), F.col("s.baseline_avg").alias("baseline_avg"), F.col("s.nonzero").alias("nonzero"), F.col("s.active").alias("active"))


def classify_trend(z: Column) -> Column:
    return F.when(z > 2, "hot").when(z >= 0.5, "rising").when(z > -0.5, "flat").when(z >= -2, "declining").when(z.isNotNull(), "gone")


def combine_channels(blog: Column, cafe: Column) -> tuple[Column, Column, Column]:
    """(active, z, baseline_avg) of two channels' structs, weighted over those that are active."""
    parts = ((blog, CHANNEL_WEIGHT["blog"]), (cafe, CHANNEL_WEIGHT["cafe"]))
    weight = sum((F.when(c["active"], w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    mean = lambda f: F.when(weight > 0, sum((F.when(c["active"], c[f] * w).otherwise(0.0) for c, w in parts), F.lit(0.0)) / weight).otherwise(0.0)
    return weight > 0, mean("z"), mean("baseline_avg")


def score_trends(series: DataFrame, third_status: DataFrame, as_of: Column) -> DataFrame:
    """One row a keyword: z of every source, gates with their reasons, ensemble, status and flags.

    series: channels search, blog, cafe and third, of which days before as_of count.
    third_status: (keyword, status), where 'unavailable' is a failed request. All is found from
    one grouping by keyword.
    """
    values = series.where(F.col("day") < as_of).groupBy("keyword").agg(*[sorted_values(where=F.col("channel") == c).alias(c) for c in MIN_IQR])
    out = values.join(third_status, "keyword", "left").select("keyword", "status", *[series_stats(F.col(c), i).alias(c) for c, i in MIN_IQR.items()])
    search, third = F.col("search"), F.col("third")
    active = lambda c: F.when(F.col(c)["active"], F.col(c)["z"]).otherwise(0.0)
    mention_active, mention_z, mention_avg = combine_channels(F.col("blog"), F.col("cafe"))
    gone = F.coalesce(F.col("status") == "unavailable", F.lit(False))
    third_note = (
        F.when(gone, "third_unavailable").when(~third["active"], "third_excluded_no_signal")
        .when(third["baseline_avg"] < MIN_BASELINE, "third_excluded_low_baseline").when(third["nonzero"] < MIN_NONZERO, "third_excluded_sparse_signal")
    )
    mention_note = F.when(~mention_active, "mention_excluded_no_signal").when(mention_avg < MIN_BASELINE, "mention_excluded_low_baseline")
    out = out.select(
        "keyword", search["z"].alias("search_z"), search["active"].alias("search_usable"), active("blog").alias("blog_z"), active("cafe").alias("cafe_z"), mention_z.alias("mention_z"),
        F.when(gone | ~third["active"], 0.0).otherwise(third["z"]).alias("third_z"),
        F.when(~search["active"], "search_excluded_no_signal").alias("search_note"), mention_note.alias("mention_note"), third_note.alias("third_note"),
    )
    return ensemble(out)


def ensemble(z: DataFrame) -> DataFrame:
    """Add sources, final_z, status, flags and ensemble_note to search/mention/third z and notes."""
    mention, third = F.col("mention_note").isNull(), F.col("third_note").isNull()
    pair = mention & ~third
    weight = lambda s, on: F.when(on, F.when(pair, PAIR_WEIGHT[s]).otherwise(SOURCE_WEIGHT[s]) if s in PAIR_WEIGHT else F.lit(SOURCE_WEIGHT[s])).otherwise(0.0)
    parts = [("search", F.lit(True)), ("mention", mention), ("third", third)]
    total = sum((weight(s, on) for s, on in parts), F.lit(0.0))
    raw = sum((weight(s, on) * F.col(f"{s}_z") for s, on in parts), F.lit(0.0)) / total
    final = F.when(F.col("search_usable"), F.greatest(F.least(raw, F.lit(CLIP)), F.lit(-CLIP))).otherwise(0.0)
    notes = F.array_compact(F.array("search_note", "mention_note", "third_note"))
    loud = F.when(F.abs("blog_z") >= F.abs("cafe_z"), F.col("blog_z")).otherwise(F.col("cafe_z"))
    own = {"search": F.col("search_z"), "mention": loud, "third": F.col("third_z")}
    sources = F.when(F.col("search_usable"), F.array_compact(F.array(F.lit("search"), F.when(mention, "mention"), F.when(third, "third")))).otherwise(F.array().cast("array<string>"))
    has = lambda s: F.array_contains(F.col("sources"), s)
    apart = lambda a, b: has(a) & has(b) & (F.abs(own[a] - own[b]) > DIVERGENCE) & (own[a] * own[b] < 0)
    out = z.withColumn("final_z", final).withColumn("sources", sources)
    return out.select(
        "keyword", "search_z", "blog_z", "cafe_z", "mention_z", "third_z", "final_z",
        F.when(F.col("search_usable"), classify_trend(F.col("final_z"))).otherwise(INSUFFICIENT).alias("status"), "sources",
        F.when(apart("search", "mention") | apart("search", "third") | apart("mention", "third"), F.array(F.lit("supply_demand_divergence"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(F.size(notes) == 0, "ensemble").otherwise(F.concat_ws("+", notes)).alias("ensemble_note"),
    )


def trend_observations(series: DataFrame, as_of: Column) -> DataFrame:
    """First, last and highest value of each (keyword, channel), and the last week against the one before.

    Days from as_of on, negative values and NaN are left out; of values of one day the last in
    order of `seq` counts if there is such a column. The weeks are compared only where all 14
    days exist; the change is null where the earlier mean is 0. Ties of the peak: earliest day.
    """
    rows = series.where((F.col("day") < as_of) & (F.col("value") >= 0) & ~F.isnan("value"))
    if "seq" in series.columns:
        rows = rows.groupBy("keyword", "channel", "day").agg(F.max_by("value", "seq").alias("value"))
    last = F.max("day").over(Window.partitionBy("keyword", "channel"))
    rows = rows.withColumn("ago", F.datediff(last, "day"))
    week = lambda a, b: F.when(F.col("ago").between(a, b), F.col("value"))
    out = rows.groupBy("keyword", "channel").agg(
        F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.min_by("value", "day").alias("first_value"), F.max("day").alias("last_day"), F.max_by("value", "day").alias("last_value"),
        F.max("value").alias("peak_value"), F.max_by(F.struct((-F.unix_date("day")).alias("k"), "day"), F.struct("value", (-F.unix_date("day")).alias("k"))).alias("peak"),
        F.count_if(F.col("ago") <= 13).alias("n14"), F.avg(week(0, 6)).alias("recent"), F.avg(week(7, 13)).alias("previous"),
    )
    full = F.col("n14") == 14
    return out.select(
        "keyword", "channel", "n_days", "first_day", "first_value", "last_day", "last_value", F.col("peak.day").alias("peak_day"), "peak_value",
        F.when(full, F.col("recent")).alias("recent_avg"), F.when(full, F.col("previous")).alias("previous_avg"),
        F.when(full & (F.col("previous") > 0), (F.col("recent") / F.col("previous") - 1) * 100).alias("change_pct"),
    )


def change_rate(series: DataFrame, by: list[str]) -> DataFrame:
    """Latest value against the mean of the earlier ones in percent; null unless that mean is over 0."""
    v = series.groupBy(*by).agg(sorted_values().alias("v"))
    base = F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0)))
    mean = F.when(F.size(base) > 0, _mean(base))
    return v.select(*by, F.when(mean > 0, (F.get("v", F.size("v") - 1) - mean) / mean * 100).alias("change_rate"))


def direction_label(rate: Column, z: Column) -> Column:
    by_rate = F.when(rate > 5, "up").when(rate < -5, "down").otherwise("flat")
    return F.when(rate.isNotNull(), by_rate).when(z > 0.5, "up").when(z < -0.5, "down").when(z.isNotNull(), "flat")


def primary_series(series: DataFrame, order: tuple[str, ...] = ("search", "mention", "third"), least: int = 2) -> DataFrame:
    """(keyword, channel, n): the first channel in order with enough points."""
    n = series.where(F.col("channel").isin(*order)).groupBy("keyword", "channel").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("channel"))
    return n.groupBy("keyword").agg(F.min_by(F.struct("channel", "n"), rank).alias("s")).select("keyword", "s.channel", "s.n")


def turning_points(series: DataFrame, by: list[str], share: float = 0.15, most: int = 6) -> DataFrame:
    """Strict local maxima that stand out by this share of the span; the `most` clearest, earliest first on ties."""
    w = Window.partitionBy(*by)
    t = w.orderBy("day")
    rows = series.withColumns({"before": F.lag("value").over(t), "after": F.lead("value").over(t), "span": F.max("value").over(w) - F.min("value").over(w)})
    rows = rows.where("value > before and value > after").withColumn("prominence", F.col("value") - F.least("before", "after"))
    rows = rows.where((F.col("span") > 0) & (F.col("prominence") >= share * F.col("span")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("prominence"), "day"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select(*by, "day", "value", "prominence", "rank")


def tier_lines(series: DataFrame, by: list[str], levels: tuple[float, ...] = (-2.0, -0.5, 0.5, 2.0)) -> DataFrame:
    """Lines at mean + z * population deviation that lie within the values, with their place on the 0..1 scale."""
    s = series.groupBy(*by).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = s.withColumn("z", F.explode(F.array(*map(F.lit, levels)))).withColumn("line", F.col("m") + F.col("z") * F.col("s"))
    return out.where("line >= lo and line <= hi and hi > lo").select(*by, "z", "line", ((F.col("line") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("place"))


def usable_z(scores: DataFrame) -> DataFrame:
    return scores.withColumn("usable_z", F.when(F.coalesce(F.col("status"), F.lit(INSUFFICIENT)) != INSUFFICIENT, F.coalesce("final_z", "z_score")))


def render_trend_context(scores: DataFrame) -> DataFrame:
    """(keyword, context): a fixed sentence for each scored keyword."""
    some = F.format_string("[trend] as of %s\nstatus: %s (z %s, sources: %s)%s", F.col("date").cast("string"), "status", F.round("final_z", 2).cast("decimal(12,2)").cast("string"), F.concat_ws("+", "sources"), F.when(F.size("flags") > 0, F.concat(F.lit(" ("), F.concat_ws(", ", "flags"), F.lit(")"))).otherwise(""))
    none = F.concat(F.lit("as of "), F.col("date").cast("string"), F.lit("\nstatus: insufficient data; no judgement, no rates or stages to be guessed"))
    return scores.select("keyword", F.when(F.col("status") == INSUFFICIENT, none).otherwise(some).alias("context"))


def latest_rows(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The newest row of each group (A3)."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, *[F.col("r")[c].alias(c) for c in rest])


def rank_leaderboard(scores: DataFrame) -> DataFrame:
    """Add rank: scored rows by falling score, then those without a score, both by keyword on ties."""
    z = usable_z(scores)
    return numbered(z, [F.col("usable_z").isNull(), F.desc("usable_z"), F.col("keyword")], "rank").withColumn("rank", F.col("rank").cast("int"))


def leaderboard(keywords: DataFrame, scores: DataFrame, daily: DataFrame) -> DataFrame:
    """Keywords with their newest score and whether they are on the daily list; null status without a score."""
    newest = latest_rows(scores, ["keyword"], "date")
    return keywords.join(newest, "keyword", "left").join(daily.select("keyword", F.lit(True).alias("is_daily")), "keyword", "left").withColumn("is_daily", F.coalesce("is_daily", F.lit(False)))


def leaderboard_groups(board: DataFrame) -> DataFrame:
    """Add group: ranked, no_signal, pending or archived, by the newest date that a daily row has."""
    newest = board.agg(F.max(F.when(F.col("is_daily"), F.col("date"))).alias("newest"))
    fresh = F.col("is_daily") & (F.col("date") == F.col("newest"))
    group = F.when(F.col("status").isNull(), "pending").when(~F.coalesce(fresh, F.lit(False)), "archived").when(F.col("status") == INSUFFICIENT, "no_signal").otherwise("ranked")
    return board.join(F.broadcast(newest)).withColumn("group", group).drop("newest")
