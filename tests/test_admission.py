"""Admission as a stream: order, no refund, unknown peers, bans by notes, eviction, caps; and ingest with it."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalfold.sources.daytable import DayTable
from signalfold.streaming import ingest, limits
from signalfold.streaming.admission import REQUEST, Limits, decided, refusals, write_refusals

START = datetime(2024, 6, 1)
ONE = {"buckets": 1, "sweep_secs": 5.0, "delay": "0 seconds"}


def batches_of(tmp_path, spark, batches, schema=REQUEST):
    """A stream that takes one list of rows after another."""
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    names = [c.split()[0] for c in schema.split(", ")]
    for i, rows in enumerate(batches):
        text = "\n".join(json.dumps({k: v.isoformat() + "Z" if isinstance(v, datetime) else v for k, v in zip(names, r, strict=True)}) for r in rows)
        (folder / f"{i:04}.json").write_text(text)
        os.utime(folder / f"{i:04}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(spark, tmp_path, stream, name, sink=None):
    out = []

    def keep(df, n):
        rows = df.persist()
        out.extend(map(tuple, rows.select("request", "refused").collect()))
        if sink:
            sink(rows, n)
        rows.unpersist()

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return dict(out), q


def at(s):
    return START + timedelta(seconds=s)


def row(name, ip, session, cost, second, bad=False):
    return (name, ip, session, float(cost), bad, at(second))


def test_limits_in_their_order(spark, tmp_path):
    settings = Limits(session={"rate": 0.0, "burst": 3.0}, address={"cap": 1, "window": 1000.0}, bans={"threshold": 2, "window": 60.0, "ban": 5.0}, **ONE)
    batches = [
        [row("a1", "1", "a", 2, 0), row("a2", "1", "a", 2, 1), row("a3", "1", "a", 1, 2), row("b1", "1", "b", 1, 3), row("b2", "9", "b", 3, 3), row("c1", None, "c", 1, 3), row("c2", "0.0.0.0", "d", 0, 3),
         row("x1", "2", "x", 1, 3, True), row("x2", "2", "x", 1, 4, True), row("x3", "2", "x", 1, 5), row("u", "", "u", 1, 5, True)],
        [row("x4", "2", "x", 1, 8), row("x5", "2", "x", 1, 10), row("c3", None, "e", 1, 10), row("c4", "::", "f", 1, 10), row("d", "0.0.0.0", "d", 3, 11)],
    ]
    got, _ = run(spark, tmp_path, decided(batches_of(tmp_path, spark, batches), settings), "c")
    # b1 is refused by its address and b's tokens are gone for b2; d's first request cost one token at least.
    want = {"a2": "session", "b1": "address", "b2": "session", "x1": "bad", "x2": "bad", "x3": "ban", "u": "bad", "x4": "ban", "d": "session"}
    assert got == {r[0]: want.get(r[0]) for b in batches for r in b}


def test_refusals_become_bans_in_later_batches(spark, tmp_path):
    settings, notes = Limits(session={"rate": 0.0, "burst": 1.0}, bans={"threshold": 2, "window": 60.0, "ban": 50.0}, buckets=4, delay="10 minutes"), f"file://{tmp_path}/notes"
    source = batches_of(tmp_path, spark, [[row("a", "1", "s", 1, 0), row("b", "1", "s", 1, 1), row("c", "1", "s", 1, 2), row("d", None, "t", 1, 2), row("e", None, "t", 1, 2)]])
    got, _ = run(spark, tmp_path, decided(source, settings, refusals(spark, notes)), "c", lambda df, n: write_refusals(df, notes, n))
    assert got == {"a": None, "b": "session", "c": "session", "d": None, "e": "session"}
    source = batches_of(tmp_path, spark, [[], [row("f", "1", "other", 1, 5), row("g", None, "new", 1, 5), row("h", "1", "other", 1, 53)]])
    got, _ = run(spark, tmp_path, decided(source, settings, refusals(spark, notes)), "c", lambda df, n: write_refusals(df, notes, n))
    assert got == {"f": "ban", "g": None, "h": None}


def test_keys_that_act_like_fresh_ones_are_swept_and_caps_refuse_new_ones(spark, tmp_path):
    settings = Limits(session={"rate": 1.0, "burst": 5.0}, address={"cap": 3, "window": 20.0}, bans={"threshold": 9}, tracked=3, **ONE)
    batches = [[row(f"a{i}", f"ip{i}", f"s{i}", 2, i) for i in range(3)], [row("full", None, "s9", 1, 4), row("known", "ip0", "s0", 1, 4), row("address", "ip9", "s1", 1, 4)],
               [row("later", None, "s1", 1, 40)], [row("w1", None, "s1", 1, 41)], [row("w2", None, "s1", 1, 42)], [row("after", None, "s9", 1, 43), row("moved", "ip9", "s9", 1, 43)]]
    got, q = run(spark, tmp_path, decided(batches_of(tmp_path, spark, batches), settings), "c")
    # Three sessions are tracked until a sweep, which follows the watermark, finds that they act like fresh ones; so it is with addresses.
    assert got == {"a0": None, "a1": None, "a2": None, "full": "session", "known": None, "address": "address", "later": None, "w1": None, "w2": None, "after": None, "moved": None}


def test_chain_matches_the_limits_one_after_another(spark, tmp_path):
    rng = random.Random(5)
    rows = [row(f"{i:04}", rng.choice(["1", "2", "3", None, "::"]), f"s{rng.randrange(8)}", rng.randint(0, 4), i // 3, rng.random() < 0.1) for i in range(300)]
    settings = Limits(session={"rate": 0.5, "burst": 6.0}, address={"cap": 4, "window": 30.0}, bans={"threshold": 3, "window": 20.0, "ban": 10.0}, buckets=3)
    got, _ = run(spark, tmp_path, decided(batches_of(tmp_path, spark, [rows[i:i + 75] for i in range(0, 300, 75)]), settings), "c")
    bans, sessions, addresses, want = {}, {}, {}, {}
    for name, ip, s, cost, bad, when in rows:
        now, known = when.replace().timestamp() - START.timestamp(), limits.known_address(ip)
        ban = bans.setdefault(ip, limits.BadRequests(**settings.bans))
        if known and ban.banned(now):
            want[name] = "ban"
        elif bad:
            want[name] = "bad"
            if known:
                ban.record(now)
        elif not sessions.setdefault(s, limits.TokenBucket(**settings.session)).take(max(1.0, cost), now):
            want[name] = "session"
        elif known and not addresses.setdefault(ip, limits.AddressSessions(**settings.address)).admit(s, now):
            want[name] = "address"
        else:
            want[name] = None
    assert got == want and set(want.values()) == {None, "ban", "bad", "session", "address"}


def log_request(*services, fine=True, at_ns=None):
    now = at_ns or int(datetime.now().timestamp()) * 10**9

    def resource(service, n):
        records = [{"timeUnixNano": str(now + i), "body": {"stringValue": f"{service}{i}"}} for i in range(n)]
        return {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]}, "scopeLogs": [{"logRecords": records if fine else 5}]}

    return json.dumps({"resourceLogs": [resource(*s) for s in services]})


def event_request(session, n, name="e", token=None):
    now = datetime.now().strftime("%Y-%m-%dT%H:%M:%SZ")
    found = [{"event_id": f"00000000-0000-0000-0000-{abs(hash((session, i, name))) % 10**12:012}", "event_name": name, "actor_id": "a", "session_id": session, "timestamp_client": now} for i in range(n)]
    return json.dumps({"events": found} | ({"token": token} if token else {}))


@pytest.mark.parametrize("table, asked, inserted", [
    ("logs", [(log_request(("empty", 0), ("a", 2)), "1"), (log_request(("a", 2)), "1"), (log_request(("b", 3)), "2"), (log_request(("c", 1), fine=False), "3"), (log_request(("c", 1)), "3"), (log_request(("d", 1)), None)], 6),
    ("events", [(event_request("a", 2), "1"), (event_request("a", 2, "f"), "1"), (event_request("b", 3), "2"), (event_request("c", 1, " "), "3"), (event_request("c", 1), "3"), (event_request("d", 1), None)], 6),
])
def test_ingest_with_limits(spark, tmp_path, table, asked, inserted):
    inbox = tmp_path / "requests"
    inbox.mkdir()
    (inbox / "a.json").write_text("\n".join(json.dumps({"value": v, "ip": ip}) for v, ip in asked))
    source = spark.readStream.schema("value string, ip string").json(str(inbox)).withColumn("received_at", F.current_timestamp())
    stats = ingest.Stats()
    settings = Limits(session={"rate": 0.0, "burst": 3.0}, bans={"threshold": 1}, buckets=2)
    ingest.start(source, str(tmp_path / "out"), table, str(tmp_path / "c"), stats, limits=settings).awaitTermination()
    # The second request of a is over its burst; one of address 3 is malformed and bans the address for the other, or follows it.
    assert (stats["received"], stats["inserted"]) in ((inserted, inserted), (inserted + 1, inserted + 1)) and stats["refused"] in (2, 3)
    assert DayTable(spark, str(tmp_path / "out"), table).read().count() == stats["inserted"]


def test_resent_requests_never_open_stored_files(spark, tmp_path, monkeypatch):
    inbox = tmp_path / "requests"
    inbox.mkdir()
    for k in range(3):
        (inbox / f"{k}.json").write_text(json.dumps({"value": event_request("s", 5) if k < 2 else event_request("s", 5).replace('"a"', '"b"'), "ip": None}))
        os.utime(inbox / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema("value string, ip string").option("maxFilesPerTrigger", 1).json(str(inbox)).withColumn("received_at", F.current_timestamp())
    opened = []
    read = DayTable.read
    monkeypatch.setattr(DayTable, "read", lambda self, *a, **k: opened.append(1) or read(self, *a, **k))
    stats = ingest.Stats()
    ingest.start(source, str(tmp_path / "out"), "events", str(tmp_path / "c"), stats, resent_within="10 minutes").awaitTermination()
    # The second file repeats the first one; the third has the same keys in another text, which the merge finds.
    assert (stats["inserted"], len(opened)) == (5, 1)
