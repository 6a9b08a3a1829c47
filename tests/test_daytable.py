"""Day tables: readers inside a merge, writers that meet, repeated batches, bounded files, row groups that a lookup opens."""

import random
from datetime import date, datetime, timedelta

import pytest

from signalfold.operators.merge import merge
from signalfold.session import scanned_rows
from signalfold.sources import daytable, schemas
from signalfold.sources.daytable import Conflict, DayTable, Segment

START = datetime(2024, 6, 1)


def events(spark, ids, day=0, name="x"):
    rows = [(f"{i:06}", name, None, "u", f"s{i % 50}", START + timedelta(days=day, seconds=i), START, "{}") for i in ids]
    return spark.createDataFrame(rows, schemas.EVENTS)


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_reader_sees_old_or_new_but_nothing_between(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path), []
    assert merge(events(spark, range(10)), root, "events") == 10
    table = DayTable(spark, root, "events", fan=2)
    before = table.read()
    stage = DayTable._stage

    def watched(self, rows):
        out = stage(self, rows)
        seen.append(ids(DayTable(spark, root, "events").read()))  # files are written, nothing is published
        return out

    monkeypatch.setattr(DayTable, "_stage", watched)
    assert merge(events(spark, range(5, 20)).unionByName(events(spark, range(30, 33), day=1)), root, "events") == 13
    monkeypatch.undo()
    assert seen == [[f"{i:06}" for i in range(10)]]
    opened = table.version()
    table.compact()
    table.settle(date(2024, 7, 1))
    table.vacuum(keep=5, older_secs=0)
    assert ids(before) == [f"{i:06}" for i in range(10)]
    assert ids(table.read(version=opened)) == ids(table.read()) == [f"{i:06}" for i in [*range(20), *range(30, 33)]]
    assert ids(table.read([date(2024, 6, 2)])) == [f"{i:06}" for i in range(30, 33)] and table.read([date(2024, 6, 2)]).first().date == date(2024, 6, 2)
    assert table.vacuum(keep=1, older_secs=0) > 0 and table.read().count() == 23 and table.vacuum(keep=1, older_secs=0) == 0


def test_a_lost_job_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    merge(events(spark, range(3)), root, "events")
    with monkeypatch.context() as m:
        m.setattr(DayTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            merge(events(spark, range(3, 6)), root, "events")
    table = DayTable(spark, root, "events")
    assert table.read().count() == 3 and table.vacuum(older_secs=3600) == 0 and table.vacuum(older_secs=0) == 1
    assert merge(events(spark, range(3, 6)), root, "events") == 3 and table.read().count() == 6


def test_of_two_writers_one_fails(spark, tmp_path):
    table = DayTable(spark, str(tmp_path), "events")
    base = table.version()
    table.append(events(spark, range(3)), base=base)
    with pytest.raises(Conflict):
        table.append(events(spark, range(3, 5)), base=base)
    assert ids(table.read()) == ["000000", "000001", "000002"]


def test_a_batch_of_a_stream_is_published_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert merge(events(spark, range(4)), root, "events", source=("q", 0)) == 4
    monkeypatch.setattr(DayTable, "read", lambda *a, **k: pytest.fail("a published batch is not looked at"))
    assert merge(events(spark, range(4)), root, "events", source=("q", 0)) == 0
    monkeypatch.undo()
    assert merge(events(spark, []), root, "events", source=("q", 1)) == 0 and DayTable(spark, root, "events").version().sources == {"q": 1}
    assert merge(events(spark, range(2, 6)), root, "events", source=("other", 0)) == 2


def test_files_of_a_day_stay_few(spark, tmp_path):
    table = DayTable(spark, str(tmp_path), "events", fan=3)
    for k in range(14):
        table.append(events(spark, range(40 * k, 40 * k + 40), day=k % 2).repartition(8))
    files = [f for f in tmp_path.rglob("*.parquet")]
    live = {s.name for s in table.version().segments}
    assert table.read().count() == 14 * 40 and len(live) <= 6 and sum(f.parent.name[4:] in live for f in files) <= 6
    table.settle(date(2024, 6, 2))
    assert sorted(s.day for s in table.version().segments)[:2] == ["2024-06-01", "2024-06-02"] and table.read().count() == 560
    assert table.purge(date(2024, 6, 2)) == 1 and ids(table.read()) == sorted(f"{i:06}" for k in range(1, 14, 2) for i in range(40 * k, 40 * k + 40))


def test_segments_are_bounded_after_a_thousand_batches():
    rng, live, written, moved = random.Random(1), [], 0, 0
    for k in range(1000):
        size = rng.randint(20_000, 400_000)
        live, written = [*live, Segment("2024-06-01", str(k), size)], written + size
        while groups := daytable.due(live, 128 << 20, 8):
            for n, g in enumerate(groups):
                live = [s for s in live if s not in g] + [Segment("2024-06-01", f"{k}-{n}", sum(s.bytes for s in g))]
                moved += sum(s.bytes for s in g)
    assert len(live) <= 7 * 5 and sum(s.bytes for s in live) == written and moved <= 5 * written


def test_a_lookup_opens_few_row_groups(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"t{rng.randrange(4000):05}", f"{i}", None, START + timedelta(seconds=i), None, 1.0, "op", None, f"svc-{i % 4}", None, None, None, None, None, None, START, None, None, None, None) for i in range(20_000)]
    table = DayTable(spark, str(tmp_path), "spans", row_group_rows=500)
    table.append(spark.createDataFrame(rows, schemas.SPANS))
    trace = table.read().where("trace_id = 't00042'")
    assert sorted(r.span_id for r in trace.collect()) == sorted(r[1] for r in rows if r[0] == "t00042")
    found = trace.count()
    scanned, files = scanned_rows(trace)
    assert files <= 2 and scanned <= 500 * (found + 4) < 20_000 / 3
    # Clustered by service and time: a minute of one service is a few row groups too.
    part = table.read().where("service_name = 'svc-2' and start_time >= timestamp '2024-06-01 01:00:00' and start_time < timestamp '2024-06-01 01:01:00'")
    assert part.count() == 15 and scanned_rows(part)[0] <= 1000
    none = table.read().where("trace_id = 'no such trace'")
    assert none.count() == 0 and scanned_rows(none)[0] <= 500 * 2


def logs_of(spark, rows):
    """rows: (seconds from START, service, severity, body)."""
    full = [(f"{i:05}", START + timedelta(seconds=s), None, START, sev, None, body, svc, None, None, None, "t", None, None, None, None) for i, (s, svc, sev, body) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.LOGS)


def test_kept_counts_equal_the_full_scan(spark, tmp_path):
    from signalfold.operators import baselines, evaluate
    from signalfold.operators.rules import Rule

    rng, root = random.Random(6), str(tmp_path)
    now = START + timedelta(hours=30)
    rows = [(rng.choice([rng.randrange(110_000), 108_000, rng.randrange(104_000, 108_000), 100_800, 3600 * rng.randrange(31)]), rng.choice("ab"), rng.choice([None, 9, 17]), rng.choice([None, "known", f"b{rng.randrange(90)}"])) for _ in range(900)]
    rng.shuffle(rows)
    all_rows = logs_of(spark, rows)
    keep = ("counts", "signatures")
    for k in range(5):  # late rows come in any batch, and each batch comes twice
        for _ in range(2):
            merge(all_rows.where(f"cast(log_id as int) % 5 = {k}"), root, "logs", rollups=keep)
    store = DayTable(spark, root, "logs", fan=2, rollups=keep)
    for rule in (Rule("anomaly", "x", window_secs=3600, baseline_secs=86_400, severity_min=17), Rule("anomaly", "y", window_secs=600, baseline_secs=7200, service="a", min_count=0), Rule("anomaly", "z", window_secs=3600, baseline_secs=7200),
                 Rule("anomaly", "w", window_secs=90, baseline_secs=3600)):
        for at in (now, now - timedelta(hours=2), now + timedelta(seconds=30)):
            want = evaluate.anomaly(all_rows, rule, at).first().value
            assert baselines.anomaly(store, rule, at).first().value == pytest.approx(want, abs=1e-12)
    for rule in (Rule("log_new_signature", "x", window_secs=7200, baseline_secs=86_400), Rule("log_new_signature", "y", window_secs=3600, baseline_secs=7200, service="b", severity_min=9), Rule("log_new_signature", "s", window_secs=3600, group_by="severity_text")):
        for at in (now, now - timedelta(minutes=7)):
            want = sorted(map(tuple, evaluate.new_groups(all_rows, rule, at).collect()))
            assert sorted(map(tuple, baselines.new_groups(store, rule, at).collect())) == want
    counted = store.read(rollup="counts").agg({"n": "sum"}).first()[0]
    store.compact()
    store.settle(date(2024, 7, 1))
    assert counted == 900 == store.read().count() == store.read(rollup="counts").agg({"n": "sum"}).first()[0]
    assert sorted({(s.rollup, s.day) for s in store.version().segments}) == sorted((s.rollup, s.day) for s in store.version().segments)
    assert store.purge(date(2024, 6, 2)) == 1 and {s.day for s in store.version().segments} == {"2024-06-02"}


def test_a_tick_reads_counts_and_not_the_rows(spark, tmp_path):
    from signalfold.operators import baselines
    from signalfold.operators.rules import Rule

    rows = [(3 * i, "a", 17, f"b{i % 7}") for i in range(20_000)]
    store = DayTable(spark, str(tmp_path), "logs", row_group_rows=500, rollups=("counts",))
    store.append(logs_of(spark, rows))
    tick = baselines.anomaly(store, Rule("anomaly", "x", window_secs=600, baseline_secs=36_000, severity_min=17), START + timedelta(hours=16))
    tick.collect()
    scanned, _ = scanned_rows(tick)
    assert scanned <= 2 * 17 * 60 + 1000 < 20_000 / 6
