"""Series cases of the scoring rules, written from their properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendspark.operators import series, trend

AS_OF = dt.date(2024, 3, 1)


def frame(spark, channels, last=AS_OF - dt.timedelta(days=1), keyword="k"):
    rows = []
    for channel, values in channels.items():
        for i, v in enumerate(values):
            rows.append((keyword, channel, last - dt.timedelta(days=len(values) - 1 - i), float(v)))
    return spark.createDataFrame(rows, "keyword string, channel string, day date, value double")


def score(spark, channels, third="ok"):
    status = spark.createDataFrame([("k", third)], "keyword string, status string")
    return trend.score_trends(frame(spark, channels), status, F.lit(AS_OF)).first()


def test_stable_is_flat(spark):
    r = score(spark, {"search": [49, 51, 50] * 10})
    assert (r.status, r.sources) == ("flat", ["search"]) and abs(r.final_z) < 0.5


def test_spike_is_clipped(spark):
    r = score(spark, {"search": [10] * 29 + [100]})
    assert r.status == "hot" and r.final_z == 8.0


def test_no_primary_signal(spark):
    r = score(spark, {"search": [0] * 30, "blog": [20] * 30, "cafe": [20] * 30})
    assert (r.status, r.sources, r.final_z) == ("insufficient", [], 0.0) and "search_excluded_no_signal" in r.ensemble_note


def test_low_mention_baseline_is_excluded(spark):
    r = score(spark, {"search": [50] * 30, "blog": [1] * 30, "cafe": [1] * 30})
    assert r.sources == ["search"] and "mention_excluded_low_baseline" in r.ensemble_note


def test_one_channel_stands_for_both(spark):
    r = score(spark, {"search": [50] * 30, "blog": [20] * 29 + [60], "cafe": [0] * 30})
    assert r.mention_z == r.blog_z == 8.0 and r.final_z == pytest.approx(0.6 * 0 + 0.4 * 8.0)


def test_sparse_third_source(spark):
    r = score(spark, {"search": [50] * 20, "third": [0, 0, 100] * 10})
    assert "third_excluded_sparse_signal" in r.ensemble_note


def test_unavailable_is_not_empty(spark):
    assert "third_unavailable" in score(spark, {"search": [50] * 20}, "unavailable").ensemble_note
    assert "third_excluded_no_signal" in score(spark, {"search": [50] * 20}).ensemble_note


def test_divergence(spark):
    r = score(spark, {"search": [100] * 20 + [20], "blog": [20] * 20 + [150], "cafe": [20] * 21})
    assert r.flags == ["supply_demand_divergence"]


def test_partial_day_is_dropped(spark):
    s = frame(spark, {"search": [50] * 30 + [0]}, last=AS_OF)
    assert trend.robust_z(series.drop_incomplete(s, F.lit(AS_OF)), ["keyword"], 2.0).first().z == 0.0


@pytest.mark.parametrize("z, label", [(2.0, "rising"), (2.01, "hot"), (0.5, "rising"), (-0.5, "declining"), (-2.0, "declining"), (-2.01, "gone"), (0.0, "flat")])
def test_band_edges(spark, z, label):
    assert spark.range(1).select(trend.classify_trend(F.lit(z)).alias("s")).first().s == label


def test_fewer_than_two_baseline_points(spark):
    assert trend.robust_z(frame(spark, {"search": [1, 99]}), ["keyword"], 2.0).first().z == 0.0


def test_old_signal_does_not_become_today(spark):
    s = frame(spark, {"search": [80]}, last=AS_OF - dt.timedelta(days=6))
    f = {r.day: r.value for r in series.fill_search_series(s, F.lit(AS_OF)).collect()}
    assert f[AS_OF - dt.timedelta(days=2)] == 0.0 and len(f) == 29 and f[AS_OF - dt.timedelta(days=6)] == 80.0


def test_newer_value_extends_the_window(spark):
    s = frame(spark, {"search": [80]}, last=AS_OF - dt.timedelta(days=1))
    assert max(r.day for r in series.fill_search_series(s, F.lit(AS_OF)).collect()) == AS_OF - dt.timedelta(days=1)


def test_merge_with_an_empty_channel_is_empty(spark):
    assert series.merge_channels(frame(spark, {"blog": [1, 2]}), ["blog", "cafe"]).count() == 0


def test_observations(spark):
    s = frame(spark, {"search": [1, 9, 9] + [2] * 11 + [float("nan")]})
    r = trend.trend_observations(s, F.lit(AS_OF)).first()
    assert r.n_days == 14 and r.peak_value == 9 and r.peak_day == AS_OF - dt.timedelta(days=14) and r.recent_avg == 2.0
    gap = trend.trend_observations(s.where(F.col("day") != AS_OF - dt.timedelta(days=5)), F.lit(AS_OF)).first()
    assert gap.recent_avg is None and gap.change_pct is None
