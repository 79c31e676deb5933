"""Histories from the strings of a log: the union of overlapping lists in order, against a plain version."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slatewise.operators import click_index as CI

T0 = datetime(2024, 1, 1)


def plain(rows, cutoff):
    seen = {}
    for key, user, ts, text in sorted(rows, key=lambda r: (r[2], r[0])):
        if user is not None and ts <= cutoff:
            have = seen.setdefault(user, [])
            for x in (text or "").split():
                if x not in have:
                    have.append(x)
    return sorted((u, k, x) for u, have in seen.items() for k, x in enumerate(have, 1))


@pytest.fixture(scope="module")
def rows():
    """Growing lists, windows that lose their front, shuffled and unrelated lists, repeats, blanks and nulls; one busy user."""
    rng, out, key = random.Random(8), [], 0
    for user in ["U1"] * 6 + [f"U{k}" for k in range(2, 12)]:
        ids = [f"N{rng.randrange(60)}" for _ in range(rng.randrange(0, 4))]
        for _ in range(rng.randrange(1, 40)):
            ids += [f"N{rng.randrange(60)}" for _ in range(rng.randrange(0, 3))]
            kind = rng.random()
            text = " ".join(ids[-12:])
            if kind < 0.1:
                text = " ".join(rng.sample(ids, len(ids)))
            elif kind < 0.2:
                text = rng.choice(["", None, "  ", "  X1   X2 ", text + " " + text])
            out.append((key, user, T0 + timedelta(hours=rng.randrange(0, 300)), text))
            key += 1
    return [*out, (key, None, T0, "N1 N2")]


@pytest.mark.parametrize("hours", [-1, 150, 1000])
def test_equals_plain(spark, rows, hours):
    log = spark.createDataFrame(rows, "impression_id long, user_id string, ts timestamp_ntz, history string").repartition(3)
    cutoff = T0 + timedelta(hours=hours)
    got = sorted(tuple(r) for r in CI.log_history(log, cutoff).collect())
    assert got == plain(rows, cutoff)


def test_only_new_ids_are_exploded(spark):
    """A user's rows repeat one growing list: about one id a row leaves the comparison, not the whole list."""
    rows = [(k, "U", T0 + timedelta(hours=k), " ".join(f"N{i}" for i in range(max(0, k - 50), k))) for k in range(400)]
    log = spark.createDataFrame(rows, "impression_id long, user_id string, ts timestamp_ntz, history string")
    assert CI.new_ids(log, bounds=[]).count() == 399
    got = CI.log_history(log, T0 + timedelta(days=99), bounds=[])
    assert got.count() == 399 and got.agg(F.max("pos")).first()[0] == 399
