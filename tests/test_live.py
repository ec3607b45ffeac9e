"""The outcome ledger, counts on the JVM, live records and the drift fed back, on hand-made streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_streaming import at, drain, write

from rivulet.plans.recommend import Plan
from rivulet.sources.tables import ACTIONS
from rivulet.streaming import follow, ledger, loop
from rivulet.streaming.versions import Versions, complete, pinned

SECOND = 1 / 3600


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", follow.STATE_STORE)


@pytest.fixture(scope="module")
def actions(spark):
    return spark.createDataFrame(ACTIONS, "action string, fixed_cost double, loss_if_flood double, loss_if_dry double")


def told(spark, folder, path, **how):
    """The ledger over observations of sensors f (forecasts) and o (outcomes)."""
    obs = follow.read_observations(spark, folder).withWatermark("ts", "1 hour")
    events = ledger.both_sides(*(obs.where(F.col("sensor").isin(s, "beat")) for s in "fo"))
    out, dropped = drain(ledger.stream_outcome_ledger(events, **how), path)
    return sorted((r.forecast_id, r.outcome_id, r.status) for _, rows in out for r in rows if r.zone_id >= 0), dropped


def test_each_forecast_ends_once(spark, tmp_path):
    """At 1 h exactly, after it, after the grace, at the forecast's own time, before it, in another zone, after the watermark."""
    f = [(i, at(0.5), i, "f", 150.0) for i in range(1, 8)]
    o = [(11, at(1.5), 1, "o", 1.0), (12, at(1.5 + SECOND), 2, "o", 1.0), (13, at(6.5), 3, "o", 1.0), (14, at(6.5 + SECOND), 4, "o", 1.0), (15, at(0.5), 5, "o", 1.0), (16, at(0.2), 6, "o", 1.0), (17, at(1), 99, "o", 1.0)]
    # The outcome of forecast 7 comes when the watermark has passed: it's dropped and the forecast is missing.
    batches = [f + o, [(50, at(40), -1, "beat", 0.0)], [(18, at(1), 7, "o", 1.0), (51, at(41), -1, "beat", 0.0)], [(52, at(90), -1, "beat", 0.0)]]
    write(spark, str(tmp_path / "in"), batches)
    rows, dropped = told(spark, str(tmp_path / "in"), str(tmp_path / "c"))
    # Its two copies, for two slots.
    assert dropped == 2
    assert rows == [(1, 11, "matched"), (2, 12, "late"), (3, 13, "late"), (4, None, "missing"), (5, None, "missing"), (6, None, "missing"), (7, None, "missing")]


@pytest.mark.parametrize("salts", [1, 3])
def test_ledger_like_a_plain_search(spark, tmp_path, salts):
    rng = random.Random(salts)
    rows = [(i, at(rng.randint(0, 200) / 4), rng.choice([1, 1, 1, 2]), rng.choice("ffo"), None if i % 17 == 0 else 1.0) for i in range(300)]
    rows.sort(key=lambda r: r[1])
    write(spark, str(tmp_path / "in"), [rows[:150], rows[150:], [(999, at(200), -1, "beat", 0.0)]])
    got, dropped = told(spark, str(tmp_path / "in"), str(tmp_path / "c"), within_us=ledger.HOUR, grace_us=ledger.HOUR // 2, salts=salts)
    want = []
    for i, ts, zone, kind, _ in rows:
        if kind == "f":
            after = sorted((t, j) for j, t, z, k, _ in rows if k == "o" and z == zone and ts < t <= ts + dt.timedelta(hours=1.5))
            want.append((i, after[0][1], "matched" if after[0][0] <= ts + dt.timedelta(hours=1) else "late") if after else (i, None, "missing"))
    assert dropped == 0 and got == sorted(want) and {s for *_, s in got} == {"matched", "late", "missing"}


def test_state_goes_with_the_timer(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [[(i, at(i), 1, "f", 1.0) for i in range(40)], [(99, at(300), -1, "beat", 0.0)], [(100, at(600), -1, "beat", 0.0)]])
    obs = follow.read_observations(spark, str(tmp_path / "in")).withWatermark("ts", "1 hour")
    stream = ledger.stream_outcome_ledger(ledger.both_sides(*(obs.where(F.col("sensor").isin(s, "beat")) for s in "fo")))
    q = stream.writeStream.outputMode("append").foreachBatch(lambda b, i: b.count()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators]
    assert max(sizes) > sizes[-1] and sizes[-1] <= 8


def test_counts_stay_on_the_jvm_and_split_a_hot_zone(spark, tmp_path):
    rows = [(i, at(i / 50), 1 if i % 9 else 2, "ab"[i % 2], float("nan") if i % 10 == 3 else None if i % 10 == 7 else float(100 + i % 40)) for i in range(400)]
    write(spark, str(tmp_path / "in"), [rows, rows[350:] + [(9999, at(100), -1, "beat", 0.0)]])
    stream = loop.stream_counts(follow.stream_dedup(follow.read_observations(spark, str(tmp_path / "in"))), salts=4)
    got = []
    q = stream.writeStream.outputMode("append").foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "salt" in plan and not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    want = {}
    for _, ts, zone, sensor, v in rows:
        n, wet = want.get((ts.replace(minute=0, second=0, microsecond=0), zone, sensor), (0, 0))
        known = v is not None and v == v
        want[ts.replace(minute=0, second=0, microsecond=0), zone, sensor] = (n + known, wet + (known and v >= 120))
    assert {(r.start, r.zone_id, r.sensor): (r.n, r.wet) for r in got if r.zone_id > 0} == want and len(got) == len(want)


def test_counts_take_each_observation_once_without_its_own_state(spark, tmp_path):
    """Replays in and across batches count once, also without an id; state has a row for what a window holds, none for an event."""
    rows = [(i if i % 50 else None, at(i / 200), 1, "a", float(100 + i % 40)) for i in range(400)]
    write(spark, str(tmp_path / "in"), [rows[:300] + rows[:300:7], rows[250:] + [(9999, at(100), -1, "beat", 0.0)]])
    stream = loop.stream_counts(follow.read_observations(spark, str(tmp_path / "in")).withWatermark("ts", "1 hour"), salts=2)
    got = []
    q = stream.writeStream.outputMode("append").foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {}
    for _, ts, _, _, v in rows:
        n, wet = want.get(ts.hour, (0, 0))
        want[ts.hour] = (n + 1, wet + (v >= 120))
    assert {r.start.hour: (r.n, r.wet) for r in got if r.zone_id > 0} == want
    assert sum(r.total for r in got if r.zone_id > 0) == pytest.approx(sum(r[4] for r in rows))
    assert max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) <= 8


def windows(spark, rows):
    return spark.createDataFrame([(s, z, k, n, w, t, s) for s, z, k, n, w, t in rows], "start timestamp, zone_id int, sensor string, n long, wet long, total double, last timestamp")


def test_daily_counts_keep_a_bounded_number_of_days(spark):
    daily = None
    for day in range(30):
        daily = loop.daily_counts(daily, windows(spark, [(at(24 * day), 1, "a", 2, 1, 200.0), (at(24 * day + 1), 1, "b", 1, 0, 10.0)]))
        daily = spark.createDataFrame(daily.collect(), loop.DAILY)
    rows = daily.collect()
    assert len(rows) == 2 * loop.DAYS + 1
    assert sum(r.n for r in rows) == 90 and [(r.n, r.wet) for r in rows if r.valid_date is None] == [(3 * (30 - loop.DAYS), 30 - loop.DAYS)]
    b = loop.beliefs_of(daily).first()
    assert (b.n, b.p, b.p_before) == (90, pytest.approx(31 / 92), pytest.approx(30 / 89))
    # A late row of a day long past counts in the belief all the same.
    more = loop.daily_counts(daily, windows(spark, [(at(5), 1, "a", 4, 4, 900.0)]))
    assert loop.beliefs_of(more).first().n == 94 and more.count() == len(rows)


@pytest.fixture(scope="module")
def static(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("static"))
    tables = {
        "context": spark.createDataFrame([(1, "one", "D", 1000.0, 5.0, 3), (2, "two", "D", 10.0, 0.0, 1)], "zone_id int, zone_name string, district_name string, population double, capacity double, assets long"),
        "segmentation": spark.createDataFrame([(1, 0.05, 0.01)], "zone_id int, fraction double, se double"),
        "reliability": spark.createDataFrame([(9, 0.95, 0.5)], "bin int, mean_p double, rate double"),
    }
    found = {name: Versions(spark, f"{path}/{name}") for name in tables}
    for name, rows in tables.items():
        found[name].write(rows, 0)
    return found


#: Zone 1: mostly wet today and dry before; zone 2: always dry; zone 3: unknown to the static tables, and hardly seen.
FIRST = [(at(h), z, s, n, w, t) for h, z, s, n, w, t in [(1, 1, "a", 40, 0, 400.0), (2, 1, "b", 40, 0, 4000.0), (1, 2, "a", 90, 0, 900.0)]]
SECOND_DAY = [(at(h), z, s, n, w, t) for h, z, s, n, w, t in [(25, 1, "a", 400, 400, 60_000.0), (26, 1, "b", 40, 40, 6000.0), (25, 2, "a", 10, 0, 100.0), (25, 3, "a", 4, 0, 10.0)]]


def test_record_by_hand(spark, actions, static, tmp_path):
    sink = loop.publish_records(spark, actions, static, str(tmp_path))
    sink(windows(spark, FIRST), 0)
    sink(windows(spark, SECOND_DAY), 1)
    r = {x.zone_id: x for x in loop.latest_records(spark, str(tmp_path)).collect()}
    assert set(r) == {1, 2, 3}
    one = r[1].record
    assert (r[1].action, r[1].n) == ("evacuate", 520)
    assert one.situation.p == pytest.approx(441 / 522) and one.situation.expected_affected == pytest.approx(1000 * 441 / 522) and one.situation.change == pytest.approx(441 / 522 - 1 / 82)
    assert [(x.rank, x.sensor, x.distance) for x in one.rationale] == [(1, "a", 140.0), (2, "b", 50.0)]
    assert [x.action for x in one.alternatives] == ["preposition", "monitor"] and one.alternatives[0].extra_loss == pytest.approx(20 + 45 * 441 / 522 - 40 - 5 * 441 / 522, abs=1e-6)
    assert list(one.limitations) == ["sources_disagree"] and one.confidence.lo < one.situation.p < one.confidence.hi and one.confidence.label == "high"
    assert (one.verify.needs_human, one.verify.reason) == (False, "none") and (one.context.zone_name, one.context.population) == ("one", 1000.0)
    assert (r[2].action, r[2].gate, list(r[2].record.limitations)) == ("none", "act", ["no_segmentation"]) and r[2].record.situation.change == pytest.approx(1 / 102 - 1 / 92)
    assert list(r[3].record.limitations) == ["few_observations", "no_segmentation"] and r[3].record.verify.needs_human and r[3].record.rationale is None
    assert r[3].record.situation.change is None and r[3].record.context.zone_name is None


def test_replay_and_pinned_versions(spark, actions, static, tmp_path):
    """A replayed batch gives equal rows, whatever versions have come since; the next batch reads the new ones."""
    sink, path = loop.publish_records(spark, actions, static, str(tmp_path)), str(tmp_path)
    rows = lambda: sorted(map(str, loop.latest_records(spark, path).collect()))
    sink(windows(spark, FIRST), 0)
    sink(windows(spark, SECOND_DAY), 1)
    before = rows()
    sink(windows(spark, SECOND_DAY), 1)
    assert rows() == before
    static["context"].write(spark.createDataFrame([(1, "new name", "D", 1.0, 5.0, 3)], static["context"].at(0).schema), 7)
    try:
        sink(windows(spark, SECOND_DAY), 1)
        assert rows() == before
        sink(windows(spark, []), 2)
        assert loop.latest_records(spark, path).where("zone_id = 1").first().record.context.zone_name == "new name"
        assert complete(spark, f"{path}/daily") == [1, 2]
    finally:
        static["context"].forget(8)
        static["context"].write(spark.createDataFrame([(1, "one", "D", 1000.0, 5.0, 3), (2, "two", "D", 10.0, 0.0, 1)], "zone_id int, zone_name string, district_name string, population double, capacity double, assets long"), 0)


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.newest() is None and pinned(spark, str(tmp_path / "p"), 0, {"v": v}) == {"v": None}
    v.write(spark.range(3), 4)
    v.write(spark.range(9), 4)  # a version doesn't change
    assert v.at(4).count() == 3 and pinned(spark, str(tmp_path / "p"), 0, {"v": v}) == {"v": None} and pinned(spark, str(tmp_path / "p"), 1, {"v": v}) == {"v": 4}
    v.write(spark.range(1), 5)
    v.forget(5)
    assert v.newest() == 5 and complete(spark, str(tmp_path / "v")) == [5]


def alarm_rows(spark, rows):
    return spark.createDataFrame(rows, loop.ALARMS)


def test_an_alarm_holds_from_the_next_batch_on(spark, actions, static, tmp_path):
    path, alarms = str(tmp_path), Versions(spark, str(tmp_path / "alarms"))
    drift, sink = loop.publish_alarms(alarms, kept=3), loop.publish_records(spark, actions, static, path, alarms)
    gate = lambda: loop.latest_records(spark, path).where("zone_id = 1").first()
    sink(windows(spark, FIRST + SECOND_DAY), 0)
    assert gate().gate == "act"
    drift(alarm_rows(spark, [(at(0), 5, 0.1, False)]), 0)
    drift(alarm_rows(spark, [(at(24), 5, 0.9, True)]), 1)
    drift(alarm_rows(spark, []), 2)
    sink(windows(spark, FIRST + SECOND_DAY), 0)  # a replay: the alarm came after it
    assert gate().gate == "act"
    sink(windows(spark, []), 1)
    r = gate()
    assert (r.gate, r.action, r.record.verify.reason) == ("verify", "evacuate", "gate is verify") and "forecast_drift" in r.record.limitations
    drift(alarm_rows(spark, [(at(48), 5, 0.1, False)]), 3)
    drift(alarm_rows(spark, [(at(48), 5, 0.1, False)]), 3)
    sink(windows(spark, []), 1)
    assert gate().gate == "verify"
    sink(windows(spark, []), 2)
    assert gate().gate == "act" and "forecast_drift" not in gate().record.limitations
    assert complete(spark, alarms.folder) == [0, 1, 3] and alarms.at(3).count() == 3
    assert loop.alarm_now(alarms.at(3), 2)._jc.toString() == "true"


def test_whole_loop_on_files(spark, sf_dir, actions, tmp_path):
    """Drift, alarms and records from one folder; every zone has a record, and the counts are those of the distinct events."""
    plan = Plan(spark, sf_dir)
    from rivulet.plans.queries import static_tables

    obs = [(r.event_id, r.ts, r.zone_id, r.sensor, r.value) for r in plan.tables.observation.orderBy("ts").collect()]
    half = len(obs) // 2
    write(spark, str(tmp_path / "in"), [obs[:half], obs[half:] + obs[half : half + 50], [(10**9, obs[-1][1] + dt.timedelta(days=2), -1, "beat", 0.0)]])
    loop.recommend_live(follow.read_observations(spark, str(tmp_path / "in")), actions, static_tables(plan, str(tmp_path)), str(tmp_path)).awaitTermination()
    got = {r.zone_id: r.n for r in loop.latest_records(spark, str(tmp_path)).collect()}
    want = {r.zone_id: r["count"] for r in plan.tables.observation.groupBy("zone_id").count().collect()}
    assert {z: n for z, n in got.items() if z >= 0} == want
