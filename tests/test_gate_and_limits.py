"""The SQL gate; admission limits and alert state, alone and as streams."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalfold.operators import liveness
from signalfold.plans.gate import Rejected, check, execute
from signalfold.streaming import alerts, limits


@pytest.mark.parametrize("sql", [
    "drop table events", "insert into events select * from events", "with a as (select 1) insert into events select * from a", "set spark.x=1", "create table x as select 1",
    "insert overwrite directory '/tmp/x' select 1", "explain drop table events", "select 1; drop table events", "select reflect('java.lang.System', 'exit', 1)",
    "select * from parquet.`/etc`", "select (select max(java_method('java.lang.Math', 'random')) from events)", "select * from events where 1 in (select try_reflect('a', 'b'))",
    "select * from secrets", "refresh table events", "cache table events", "use other", "truncate table events", "select * from (select * from csv.`/etc/passwd`) x", "add jar '/x'",
])
def test_gate_refuses(spark, sql):
    spark.range(4).createOrReplaceTempView("events")
    with pytest.raises(Rejected):
        check(spark, sql, {"events"})


_HIDDEN = [
    "select a.* from secret as a cross join (select 1 as x) as secret", "with secret as (select 1 as id) select * from secret union all select * from (with x as (select 1) select s.id from x, `secret` s, hidden)",
    "select * from (with secret as (select 1 as id) select * from secret) a join secret b on a.id = b.id", "with a as (with secret as (select 2 as id) select * from secret) select * from a, secret",
    "select * from events as secret where id in (select id from secret)", "select (select max(secret.id) from secret) from events as secret", "select * from events e, lateral (select id from secret where secret.id = e.id)",
    "with events as (select * from secret) select * from events", "with recursive r(n) as (select id from secret union all select n + 1 from r where n < 3) select * from r", "select exists(select 1 from secret)",
    "select id from events group by id having max(id) > (select min(id) from secret)", "select * from events order by (select min(id) from secret)", "explain select * from secret",
    "select * from global_temp.shared", "select * from outer_view", "table secret", "from secret select *", "select * from kept_table", "select * from default.kept_table", "select * from default.events",
]


@pytest.mark.parametrize("sql", _HIDDEN)
def test_gate_refuses_what_names_hide(spark, sql):
    """Aliases and common table expressions that are named like a hidden view, or a hidden view by another way."""
    for name in ("events", "secret", "hidden"):
        spark.range(4).createOrReplaceTempView(name)
    spark.range(4).createOrReplaceGlobalTempView("shared")
    spark.sql("create or replace temporary view outer_view as select * from secret")
    spark.range(4).write.mode("overwrite").saveAsTable("kept_table")
    try:
        with pytest.raises(Rejected):
            check(spark, sql, {"events", "kept_table"} if "default" in sql or "kept" in sql else {"events"})
    finally:
        spark.sql("drop table kept_table")


@pytest.mark.parametrize("sql", [
    "select mine(id) from events", "select upper(cast(id as string)) from events", "select system.builtin.lower('A') from events", "select session.mine(1)", "select input_file_name() from events", "select version()",
    "select current_user() from events", "select * from mine_table(1)", "select transform(array(id), x -> mine(x)) from events", "select id from events where exists (select 1 where mine(2) = 2)",
    "select aes_encrypt('a', 'abcdefghijklmnop') from events", "select raise_error('x') from events", "select no_such_function(1) from events", "select session_user()",
])
def test_gate_takes_built_in_functions_that_compute(spark, sql):
    """A session's own function is refused, also where it took the name of a built-in one."""
    own = spark.newSession()
    own.range(4).createOrReplaceTempView("events")
    fine = "select {}('a'), typeof(1), count(*), date_trunc('hour', now()), from_json('{{}}', 'a int'), variant_get(parse_json('1'), '$', 'int') from events"
    check(own, fine.format("upper"), {"events"})
    own.udf.register("mine", lambda x: x, "bigint")
    own.udf.register("upper", lambda x: x, "string")
    with pytest.raises(Rejected):
        check(own, sql, {"events"})
    check(own, fine.format("lower"), {"events"})


def test_gate_reads_views_over_views_that_it_may_not_read(spark):
    """A registered view shows what it was made to show, with functions of the session's if its maker used some."""
    spark.range(4).createOrReplaceTempView("secret")
    spark.udf.register("mine", lambda x: x, "bigint")
    spark.sql("create or replace temporary view shown as select mine(max(id)) as most from secret")
    assert execute(spark, "with secret as (select * from shown) select * from secret", {"Shown"}).first().most == 3
    spark.sql("drop temporary function mine")
    with pytest.raises(Rejected):
        check(spark, "select * from secret, shown", {"shown"})


@pytest.mark.parametrize("sql", [
    "select count(*) from events", "with a as (select id from events) select * from a join events on a.id = events.id", "explain select * from events",
    "select id, row_number() over (partition by id % 2 order by id) from events where id in (select max(id) from events) union all select 1, 2",
    "select id % 2 as k, count(*) from events group by grouping sets ((id % 2), ()) having count(*) > 0 order by 1 limit 3", "select * from values (1), (2) as t(a)",
    "select x from events lateral view explode(array(1, 2)) t as x", "select exists(select 1 from events)", "select * from range(3)",
    "with secret as (select id from events), b as (select * from secret) select * from b join secret using (id)", "select secret.id from events as secret", "with events as (select 1 as id) select * from events",
    "with recursive r(n) as (select 1 union all select n + 1 from r where n < 3) select * from r", "select * from events e, lateral (select e.id + 1 as y)", "select * from events pivot (count(*) for id in (1, 2))",
    "select if(id > 1, 'a', 'b'), id between 1 and 2, cast(id as string) like '%1', id in (1, 2), -id, not true from events where id is not null", "select try_cast('x' as int), extract(year from current_date), interval '1' day, current_timestamp",
])
def test_gate_lets_queries_pass(spark, sql):
    spark.range(4).createOrReplaceTempView("events")
    execute(spark, sql, {"events"}).collect()


def test_token_bucket():
    b = limits.TokenBucket(10, 20)
    assert b.take(20, 0) and not b.take(1, 0) and b.take(10, 1) and not b.take(1, 1) and b.take(20, 100)


def test_sessions_of_an_address():
    a = limits.AddressSessions(2, 60)
    assert a.admit("x", 0) and a.admit("y", 10) and not a.admit("z", 20) and a.admit("x", 50) and not a.admit("z", 60) and a.admit("z", 70)


def test_bans():
    b = limits.BadRequests(3, 60, 300)
    assert [b.record(t) for t in (0, 1, 2)] == [False, False, True] and b.banned(301) and not b.banned(302)
    c = limits.BadRequests(3, 60, 300)
    assert [c.record(t) for t in (0, 1, 62, 63)] == [False] * 4


def test_a_later_refusal_gives_nothing_back():
    s, a, g = limits.TokenBucket(0, 10), limits.AddressSessions(1, 60), limits.TokenBucket(0, 5)
    assert limits.admit(s, a, g, "x", 5, 0) is None and limits.admit(s, a, g, "x", 5, 0) == "global" and limits.admit(s, a, g, "x", 1, 0) == "session"


def _stream(spark, tmp_path, rows, schema, make, name):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(rows):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of age
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    q = make(src).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_session_limit_as_a_stream(spark, tmp_path):
    rows = [[{"session": s, "cost": 3, "at": f"2024-06-01T00:00:0{i}Z"} for s in "ab"] for i in range(4)]
    got = _stream(spark, tmp_path, rows, "session string, cost int, at timestamp", lambda s: limits.session_limit(s, 1.0, 5.0), "limited")
    per = got.where("session = 'a'").orderBy("at").select("allowed").collect()
    assert [r.allowed for r in per] == [True, True, False, False] and got.count() == 8


def test_bans_as_a_stream(spark, tmp_path):
    rows = [[{"ip": "1", "bad": i < 2, "at": f"2024-06-01T00:00:0{i}Z"}] for i in range(4)]
    got = _stream(spark, tmp_path, rows, "ip string, bad boolean, at timestamp", lambda s: limits.ban_limit(s, 2, 60, 1.5), "bans")
    assert [r.allowed for r in got.orderBy("at").collect()] == [True, True, False, True]


def test_alert_transitions_as_a_stream(spark, tmp_path):
    rows = [[{"key": "r", "value": v, "breaching": b, "cooldown_secs": 0, "at": f"2024-06-01T00:00:0{i}Z"}] for i, (v, b) in enumerate([(1.0, False), (5.0, True), (6.0, True), (0.0, False)])]
    got = _stream(spark, tmp_path, rows, "key string, value double, breaching boolean, cooldown_secs int, at timestamp", alerts.transitions, "transitions")
    assert [(r.state, r.value) for r in got.orderBy("at").collect()] == [("firing", 5.0), ("resolved", 0.0)]


def test_liveness_and_failures(spark):
    now = datetime(2024, 6, 1, 12)
    beats = spark.createDataFrame([("a", now - timedelta(seconds=60)), ("a", now - timedelta(seconds=600)), ("b", now - timedelta(seconds=61))], "id string, ts timestamp")
    expected = spark.createDataFrame([(i, 60) for i in "abc"], "id string, timeout_secs long")
    got = {r.id: (r.down, r.silent_secs) for r in liveness.liveness(beats, expected, now).collect()}
    assert got == {"a": (False, 60.0), "b": (True, 61.0), "c": (True, None)}
    assert liveness.describe("c", None, 60) == "companion 'c' never seen" and liveness.describe("b", 61.0, 60) == "companion 'b' silent for 61s (timeout 60s)"
    probes = spark.range(8).select(F.lit("p").alias("name"), F.timestamp_seconds("id").alias("ts"), (~F.col("id").isin(1, 2, 3, 4, 6)).alias("ok")).withColumnRenamed("name", "id")
    assert [(r.failures, r.change) for r in liveness.failure_runs(probes).orderBy("ts").collect()] == [(0, None), (1, None), (2, None), (3, "firing"), (4, None), (0, "resolved"), (1, None), (0, None)]


def test_unknown_addresses_share_no_limit():
    assert [limits.known_address(a) for a in ("10.0.0.1", "::1", "0.0.0.0", "::", "", None)] == [True, True, False, False, False, False]
    session, everyone = limits.TokenBucket(1, 10), limits.TokenBucket(1, 100)
    assert limits.admit(session, None, everyone, "s", 0, 0.0) is None and session.tokens == 9
    one = limits.AddressSessions(cap=1)
    assert limits.admit(limits.TokenBucket(1, 10), one, everyone, "a", 1, 0.0) is None and limits.admit(limits.TokenBucket(1, 10), one, everyone, "b", 1, 0.0) == "address"


def test_bans_of_unknown_addresses_as_a_stream(spark, tmp_path):
    rows = [[{"ip": "0.0.0.0", "bad": True, "at": f"2024-06-01T00:00:0{i}Z"}] for i in range(3)]
    got = _stream(spark, tmp_path, rows, "ip string, bad boolean, at timestamp", lambda s: limits.ban_limit(s, 2, 60, 60), "unknown_bans")
    assert [r.allowed for r in got.orderBy("at").collect()] == [True] * 3


def test_liveness_changes_match_an_evaluation_at_every_tick(spark):
    import random

    rng, start = random.Random(7), datetime(2024, 6, 1)
    for period, timeout in ((60, 90), (60, 30), (60, 600), (7, 7)):
        ticks = 40
        beats = [(i, start + timedelta(seconds=rng.choice([rng.uniform(-300, ticks * period + 100), period * rng.randrange(ticks)]))) for i in "abcd" for _ in range(rng.randint(0, 12))] + [("other", start), ("a", None)]
        expected = [(i, timeout) for i in "abcde"]
        want = []
        for i, _ in expected:
            was = False
            for k in range(ticks):
                now = start + timedelta(seconds=k * period)
                last = max((t for j, t in beats if j == i and t and t <= now), default=None)
                silent = None if last is None else (now - last).total_seconds()
                down = last is None or silent > timeout
                if down != was:
                    want.append((i, now, "firing" if down else "resolved", float(int(silent or 0)), float(timeout), liveness.describe(i, silent, timeout)))
                was = down
        got = liveness.transitions(spark.createDataFrame(beats, "id string, ts timestamp"), spark.createDataFrame(expected, "id string, timeout_secs long"), start, ticks, period)
        assert sorted(map(tuple, got.collect())) == sorted(want)
