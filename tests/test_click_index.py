"""Click index against histories built as lists: contents, tails, donors, hot users, string ids, awkward rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slatewise.operators import click_index as CI

T0 = datetime(2024, 1, 1)


def plain(slates, clicks):
    out = {}
    for key, user, ts in slates:
        past = sorted((t, i) for u, t, i in clicks if u is not None and u == user and ts is not None and t is not None and t < ts)
        out[key] = [i for _, i in past]
    return out


@pytest.fixture(scope="module")
def log():
    rng = random.Random(4)
    users = ["U1"] * 30 + [f"U{k}" for k in range(2, 9)]   # one user has most rows
    at = lambda: T0 + timedelta(seconds=rng.randrange(0, 400) * 600)
    clicks = [(rng.choice(users), at(), f"N{rng.randrange(40)}") for _ in range(700)]
    clicks += clicks[:20] + [(None, T0, "N1")]
    slates = [(k, rng.choice(users), at()) for k in range(250)] + [(900, None, at()), (901, "nobody", at()), (902, "U2", T0 - timedelta(days=1))]
    # users with the same clicks at the same times have equal contents
    clicks += [(u, t, i) for u in ("V1", "V2") for _, t, i in clicks[30:35]]
    slates += [(910 + k, u, T0 + timedelta(days=9)) for k, u in enumerate(("V1", "V2"))]
    return slates, clicks


@pytest.fixture(scope="module")
def frames(spark, log):
    slates, clicks = log
    s = spark.createDataFrame(slates, "impression_id long, user_id string, ts timestamp_ntz").repartition(4)
    c = spark.createDataFrame(clicks, "user_id string, ts timestamp_ntz, item_id string").repartition(3)
    return s, c


def test_points_tails_and_contents(frames, log):
    want = plain(*log)
    index = CI.click_index(frames[1])
    points = CI.history_points(frames[0], index)
    rows = points.collect()
    assert {r.impression_id: r.n for r in rows} == {k: len(h) for k, h in want.items()}
    by_content = {}
    for r in rows:
        by_content.setdefault(r.content, set()).add(tuple(want[r.impression_id]))
    assert all(len(x) == 1 for x in by_content.values()) and len(by_content) == len({tuple(h) for h in want.values()})
    for k in (1, 5, 50):
        got = {r.impression_id: r["items"] for r in CI.last_items(points, index, k, "impression_id").collect()}
        assert got == {key: h[-k:] for key, h in want.items()}


def test_slates_after(frames, log):
    """Summed over a user, clicks weighted by their later slates are the lengths of all histories."""
    want = plain(*log)
    after, points = CI.slates_after(*frames)
    assert after.where("user_id is not null").agg(F.sum("after")).first()[0] == sum(map(len, want.values()))
    assert sorted(r.n for r in points.collect()) == sorted(map(len, want.values()))


def test_day_donors(frames, log):
    want = plain(*log)
    points = CI.history_points(frames[0], CI.click_index(frames[1])).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    day = {r.impression_id: r.day for r in points.collect()}
    owner = {k: u for k, u, _ in log[0]}
    got = {r.impression_id: (r.donor_user, r.donor_n) for r in CI.day_donors(points, 7).collect()}
    assert set(got) == set(want)
    for key, (user, n) in got.items():
        pool = {tuple(want[k]) for k in want if day[k] == day[key] and want[k]}
        if len(pool) > 1:
            lenders = {(owner[k], len(want[k])) for k in want if day[k] == day[key] and want[k]}
            assert (user, n) in lenders
        else:
            assert n == len(want[key])


def test_hot_user_is_spread(spark):
    """One user's clicks are cut by time: no window holds more than a small share of them."""
    clicks = spark.range(20_000).select(F.lit("U").alias("user_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"), F.col("id").alias("item_id"))
    index = CI.click_index(clicks)
    assert index.agg(F.max("pos"), F.countDistinct("pos")).first() == (20_000, 20_000)
    bounds = CI.time_ranges(clicks)
    assert len(bounds) >= 60 and index.groupBy(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("t")))).count().agg(F.max("count")).first()[0] < 1000


def test_no_list_grows_with_a_user(frames):
    """Plans of points and donors gather nothing."""
    points = CI.history_points(frames[0], CI.click_index(frames[1])).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    for df in (points, CI.day_donors(points, 7)):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_empty(spark, frames):
    none = CI.click_index(frames[1].limit(0))
    points = CI.history_points(frames[0], none)
    assert points.where("n > 0 or content != ''").count() == 0
    assert CI.last_items(points, none, 3, "impression_id").where("size(items) > 0").count() == 0
    assert CI.history_points(frames[0].limit(0), none).count() == 0
