"""Journeys by fingerprints against sequences in Python: ties, nulls, heavy sessions, limits among many equal counts."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from signalfold.operators import journeys, reads

START = datetime(2024, 6, 1)
SCHEMA = "event_id string, event_name string, tenant_id string, actor_id string, session_id string, timestamp_client timestamp"


def expected(rows, limit):
    sessions = {}
    for event, name, _, _, session, at in sorted(rows, key=lambda r: (r[5], r[0])):
        sessions.setdefault(session, []).append(name)
    return sorted(Counter(map(tuple, sessions.values())).items(), key=lambda x: (-x[1], [(n is not None, n or "") for n in x[0]]))[:limit]


def made(rng, sessions, most):
    rows = []
    for s in range(sessions):
        at = START
        for i in range(rng.randint(1, most)):
            at += timedelta(seconds=rng.choice([0, 1]))
            rows.append((f"{rng.randrange(10**9):09}", rng.choice(["open", "view", "buy", "b", "bb"]) if rng.random() < 0.97 else None, None, "a", None if s == 3 else f"s{s}", at))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy, few", [(10**6, 1000), (4, 1000), (10**6, 2), (3, 1)])
def test_journeys_match_sequences(spark, heavy, few):
    for seed, sessions, most, limit in ((1, 150, 3, 7), (2, 80, 12, 5), (3, 60, 6, 500), (4, 200, 2, 3)):
        rows = made(random.Random(seed), sessions, most)
        got = journeys.frequent(spark.createDataFrame(rows, SCHEMA).repartition(3), limit, heavy, few).collect()
        assert [(tuple(r.path), r.occurrences) for r in got] == expected(rows, limit)


def test_journeys_of_nothing(spark):
    assert journeys.frequent(spark.createDataFrame([], SCHEMA), 5).count() == 0
    assert [tuple(r) for r in reads.frequent_journeys(spark.createDataFrame([("1", "a", None, "x", "s", START), ("2", "b", None, "y", "s", START)], SCHEMA), actor="y").collect()] == [(["b"], 1)]


def test_one_long_session_is_spread_over_tasks(spark):
    """A session of 300,000 events: no window holds over a fraction of it, and its path is found exactly."""
    rows = spark.range(300_000).selectExpr("lpad(cast(id as string), 9, '0') as event_id", "concat('e', cast(id % 7 as string)) as event_name", "cast(null as string) as tenant_id", "'a' as actor_id", "'long' as session_id", "timestamp_seconds(1717200000 + id) as timestamp_client")
    rows = rows.unionByName(spark.createDataFrame(made(random.Random(1), 20, 3), SCHEMA))
    placed = journeys.placed(rows.repartition(8), heavy=1000)
    assert placed.where("session = 'long'").selectExpr("count(distinct place)", "max(place)", "count_if(name <> concat('e', cast(place % 7 as string)))").first() == (300_000, 299_999, 0)
    got = journeys.frequent(rows, 400, heavy=1000).collect()
    assert max(len(r.path) for r in got) == 300_000
