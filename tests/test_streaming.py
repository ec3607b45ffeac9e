"""Streams against batches; nothing may be dropped by the watermark unseen."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from rivulet.sources.tables import ACTIONS
from rivulet.streaming import follow

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def write(spark, folder, batches):
    """One file after another, each younger than the one before: a stream reads files by age."""
    for i, rows in enumerate(batches):
        known = set(glob.glob(f"{folder}/*.parquet"))
        spark.createDataFrame(rows, follow.OBSERVATION).coalesce(1).write.mode("append").parquet(folder)
        for f in set(glob.glob(f"{folder}/*.parquet")) - known:
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)


def drain(stream, path, mode="append"):
    out = []
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.append((i, b.collect()))).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(state["numRowsDroppedByWatermark"] for p in q.recentProgress for state in json.loads(p.json)["stateOperators"])
    return out, dropped


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", follow.STATE_STORE)


def test_dedup_and_windows(spark, tmp_path):
    batches = [[(1, at(0), 1, "a", 10.0), (1, at(0), 1, "a", 10.0), (2, at(1), 1, "a", 130.0)], [(2, at(1), 1, "a", 130.0), (3, at(20), 1, "a", 20.0), (4, at(30), 2, "a", 5.0)]]
    write(spark, str(tmp_path / "in"), batches)
    stream = follow.read_observations(spark, str(tmp_path / "in"))
    out, _ = drain(follow.stream_dedup(stream), str(tmp_path / "c1"))
    assert sorted(r.event_id for _, rows in out for r in rows) == [1, 2, 3, 4]
    batch = spark.read.schema(follow.OBSERVATION).parquet(str(tmp_path / "in"))
    for kind in ("tumbling", "sliding", "session"):
        out, dropped = drain(follow.stream_windows(stream, kind, "2 days"), str(tmp_path / kind), "complete")
        want = follow.stream_windows(batch, kind, None).collect()
        assert dropped == 0 and sorted(out[-1][1]) == sorted(want)


def test_late_rows_go(spark, tmp_path):
    """Rows count as late by the watermark of the batch before."""
    write(spark, str(tmp_path / "in"), [[(1, at(0), 1, "a", 1.0)], [(2, at(100), 1, "a", 1.0)], [(4, at(101), 1, "a", 1.0)], [(3, at(1), 1, "a", 1.0)]])
    out, dropped = drain(follow.stream_windows(follow.read_observations(spark, str(tmp_path / "in")), "tumbling", "1 hour"), str(tmp_path / "c"), "update")
    assert dropped == 1 and sum(r.n for _, rows in out for r in rows if r.start == T0) == 1


def test_belief_decision_and_publication(spark, tmp_path):
    batches = [[(1, at(0), 1, "a", 130.0), (2, at(1), 1, "a", 10.0), (3, at(1), 2, "a", 10.0)], [(4, at(2), 1, "a", 125.0)]]
    write(spark, str(tmp_path / "in"), batches)
    stream = follow.read_observations(spark, str(tmp_path / "in"))
    out, _ = drain(follow.stream_belief(stream), str(tmp_path / "c1"), "update")
    last = {r.zone_id: r for _, rows in out for r in rows if r.n == (3 if r.zone_id == 1 else 1)}
    assert last[1].p == pytest.approx(3 / 5) and last[1].variance == pytest.approx(3 * 2 / (25 * 6)) and last[2].p == pytest.approx(1 / 3)
    actions = spark.createDataFrame(ACTIONS, "action string, fixed_cost double, loss_if_flood double, loss_if_dry double")
    sink = follow.publish_latest(str(tmp_path / "latest"))
    seen = []

    def both(batch, i):
        batch = batch.persist()
        sink(batch, i)
        before = sorted(follow.latest(spark, str(tmp_path / "latest")).collect())
        sink(batch, i)  # a replay
        assert sorted(follow.latest(spark, str(tmp_path / "latest")).collect()) == before
        seen.append(i)

    follow.stream_decide(stream, actions, both, str(tmp_path / "c2")).awaitTermination()
    got = {r.zone_id: r for r in follow.latest(spark, str(tmp_path / "latest")).collect()}
    assert set(got) == {1, 2} and got[1].n == 3 and got[1].action == "evacuate" and got[1].gate == "verify" and len(seen) >= 1


def test_interval_join_and_drift(spark, tmp_path):
    write(spark, str(tmp_path / "f"), [[(1, at(0), 1, "f", 150.0), (2, at(0), 2, "f", 150.0)]])
    write(spark, str(tmp_path / "o"), [[(11, at(0.5), 1, "o", 130.0), (12, at(1.5), 1, "o", 130.0), (13, at(0.2), 3, "o", 1.0), (14, at(1), 2, "o", 10.0)]])
    streams = [follow.read_observations(spark, str(tmp_path / x)) for x in "fo"]
    out, dropped = drain(follow.stream_outcome_join(*streams), str(tmp_path / "c"))
    assert dropped == 0 and sorted((r.forecast_id, r.outcome_id) for _, rows in out for r in rows) == [(1, 11), (2, 14)]
    joined = follow.stream_outcome_join(*(spark.read.schema(follow.OBSERVATION).parquet(str(tmp_path / x)) for x in "fo"), delay=None)
    row = follow.stream_drift(joined, 0.1).first()
    assert row.n == 2 and row.brier == pytest.approx((0.25**2 + 0.75**2) / 2) and row.alarm
    assert follow.stream_drift(joined, 10.0).where(F.col("alarm")).count() == 0


def test_missing_outcomes_are_told(spark, tmp_path):
    """A forecast without an outcome comes as missing once the watermark has passed its hour."""
    write(spark, str(tmp_path / "f"), [[(1, at(0), 1, "f", 150.0), (2, at(0), 2, "f", 150.0)], [(3, at(50), 1, "f", 1.0)]])
    write(spark, str(tmp_path / "o"), [[(11, at(0.5), 1, "o", 130.0)], [(12, at(50), 3, "o", 1.0)]])
    streams = [follow.read_observations(spark, str(tmp_path / x)) for x in "fo"]
    out, dropped = drain(follow.stream_outcome_status(*streams), str(tmp_path / "c"))
    assert dropped == 0 and sorted((r.forecast_id, r.status) for _, rows in out for r in rows) == [(1, "matched"), (2, "missing")]


def test_following_counts_replays_once_and_abstains(spark, tmp_path):
    rows = [(i, at(i / 100), 1, "a", 130.0 if i % 2 else 10.0) for i in range(40)] + [(100, at(0.5), 2, "a", 130.0)]
    write(spark, str(tmp_path / "in"), [rows[:20] + rows[:20], rows[10:], rows[30:]])
    actions = spark.createDataFrame(ACTIONS, "action string, fixed_cost double, loss_if_flood double, loss_if_dry double")
    follow.follow(follow.read_observations(spark, str(tmp_path / "in")), actions, str(tmp_path / "out")).awaitTermination()
    got = {r.zone_id: r for r in follow.latest(spark, str(tmp_path / "out/latest")).collect()}
    assert (got[1].n, got[1].p) == (40, 0.5) and got[2].n == 1 and got[2].gate == "verify"
    assert len(follow.published(spark, str(tmp_path / "out/latest"))) <= 2
    unsure = spark.createDataFrame([(5, at(0), 0, 0.5, 1 / 12)], follow.BELIEF)
    assert follow.decide_on(unsure, actions).first().gate == "abstain"


@pytest.mark.parametrize("how", ["join", "status"])
def test_pairs_of_slots_like_a_plain_search(spark, tmp_path, how):
    """Every pair once, also over the edge of a slot; the join's key has the slot, so a row doesn't meet all of its zone's state."""
    f = [(i, at(i / 4), i % 2, "f", 1.0) for i in range(60)] + [(99, at(-1.25), 0, "f", 1.0)]
    o = [(1000 + i, at(i / 3), i % 2, "o", 1.0) for i in range(45)] + [(1099, at(-0.25), 0, "o", 1.0)]
    write(spark, str(tmp_path / "f"), [sorted(f, key=lambda r: r[1])[:30], sorted(f, key=lambda r: r[1])[30:], [(9998, at(90), 7, "f", 1.0)]])
    write(spark, str(tmp_path / "o"), [sorted(o, key=lambda r: r[1])[:23], sorted(o, key=lambda r: r[1])[23:], [(9999, at(90), 8, "o", 1.0)]])
    streams = [follow.read_observations(spark, str(tmp_path / x)) for x in "fo"]
    stream = {"join": follow.stream_outcome_join, "status": follow.stream_outcome_status}[how](*streams, delay="12 hours")
    rows = []
    q = stream.writeStream.outputMode("append").foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    assert "slot" in plan[plan.index("StreamingSymmetricHashJoin") :].splitlines()[0]
    near = {i: [j for j, u, y, *_ in o if y == z and t < u <= t + dt.timedelta(hours=1)] for i, t, z, *_ in f}
    want = [(i, j) for i, own in near.items() for j in own or ([None] if how == "status" else [])]
    got = [(r.forecast_id, r.outcome_id) for r in rows if r.forecast_id < 9998]
    assert sorted(got, key=str) == sorted(want, key=str) and (99, 1099) in got


def test_decisions_count_on_the_jvm_and_replay(spark, tmp_path):
    """No zone's rows go to one Python task; nulls and NaN count in nothing; a replayed batch adds nothing; an unseen zone isn't told again."""
    rows = [(1, at(0), 1, "a", 130.0), (2, at(0.1), 1, "a", float("nan")), (3, at(0.2), 1, "a", None), (4, at(0.3), 1, "a", 10.0), (5, at(0.4), 2, "a", None)]
    write(spark, str(tmp_path / "in"), [rows])
    actions = spark.createDataFrame(ACTIONS, "action string, fixed_cost double, loss_if_flood double, loss_if_dry double")
    q = follow.follow(follow.read_observations(spark, str(tmp_path / "in")), actions, str(tmp_path / "out"))
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    got = {r.zone_id: r for r in follow.latest(spark, str(tmp_path / "out/latest")).collect()}
    assert (got[1].n, got[1].p, got[1].ts) == (2, 0.5, at(0.3)) and (got[2].n, got[2].gate) == (0, "abstain")
    add = follow.add_beliefs(str(tmp_path / "counts"))
    batch = lambda own: spark.createDataFrame(own, follow.OBSERVATION)
    add(batch(rows), 0)
    for _ in range(2):
        assert [(r.zone_id, r.n, r.p) for r in add(batch([(9, at(5), 1, "a", 140.0)]), 1).collect()] == [(1, 3, pytest.approx(3 / 5))]
    assert add(batch([]), 2).count() == 0 and follow.published(spark, str(tmp_path / "counts")) == [1, 2]


def slot_events(spark, folder, batches):
    """Forecasts ("f") and outcomes ("o") of one stream with its watermark, as slots take them."""
    write(spark, folder, batches)
    return follow.read_observations(spark, folder).withWatermark("ts", "12 hours").withColumn("is_forecast", F.col("sensor") == "f")


def mixed_events():
    """Equal times, edges of slots, exactly an hour between, null and NaN values, no zone."""
    f = [(i, at(i / 4), i % 2, "f", [150.0, 20.0, None, 75.0][i % 4]) for i in range(60)] + [(99, at(-1.25), 0, "f", 1.0), (98, at(3), None, "f", 1.0), (97, at(30), 0, "f", float("nan"))]
    o = [(1000 + i, at(i / 3), i % 2, "o", [130.0, 10.0, 125.0, None][i % 4]) for i in range(45)] + [(1099, at(-0.25), 0, "o", 1.0), (1098, at(3.5), None, "o", 1.0), (1097, at(30.5), 0, "o", 10.0)]
    copies = [(i + 5000 * k, *rest) for k in range(3) for i, *rest in f + o]
    rows = sorted(copies, key=lambda r: r[1])
    return rows, [rows[: len(rows) // 2], rows[len(rows) // 2 :], [(99_999, at(99), 7, "o", 1.0)]]


def plain_pairs(rows):
    f, o = ([r for r in rows if r[3] == kind and r[2] is not None] for kind in "fo")
    return [(x, [y for y in o if y[2] == x[2] and x[1] < y[1] <= x[1] + dt.timedelta(hours=1)]) for x in f]


@pytest.mark.parametrize("missing", [False, True])
def test_pairs_from_rows_of_slots(spark, tmp_path, missing):
    """Every pair once, without a stream-stream join, whose state is looked up for each pair that could be."""
    from rivulet.streaming import slots

    rows, batches = mixed_events()
    events = slot_events(spark, str(tmp_path / "in"), batches)
    for salts in (1, 3):
        stream = slots.stream_status(events, salts=salts) if missing else slots.stream_pairs(events, salts=salts)
        out, dropped = drain(stream, str(tmp_path / f"c{salts}"))
        got = [(r.forecast_id, r.outcome_id) for _, own in out for r in own]
        want = [(x[0], y) for x, own in plain_pairs(rows) for y in [z[0] for z in own] or ([None] if missing else [])]
        assert dropped == 0 and sorted(got, key=str) == sorted(want, key=str)


def test_drift_from_running_sums(spark, tmp_path):
    """The drift over all pairs as a plain loop has it; its plan has no join, so no pair is made."""
    from rivulet.streaming import slots

    rows, batches = mixed_events()
    events = slot_events(spark, str(tmp_path / "in"), batches)
    want = {}
    for x, own in plain_pairs(rows):
        for y in own:
            n, errors = want.setdefault(y[1].date(), [0, []])
            want[y[1].date()][0] = n + 1
            if x[4] is not None and y[4] is not None:
                errors.append((x[4] / (x[4] + 50) - (y[4] >= 120)) ** 2)
    for salts in (1, 3):
        stream = slots.stream_drift(events, 0.1, salts=salts)
        out, dropped = drain(stream, str(tmp_path / f"c{salts}"))
        got = {r.start.date(): r for _, own in out for r in own}
        assert dropped == 0 and set(got) == set(want)
        for day, (n, errors) in want.items():
            assert got[day].n == n and got[day].brier == pytest.approx(sum(errors) / len(errors), nan_ok=True)
    assert "Join" not in stream._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        slots.stream_drift(events, 0.1, window="90 minutes")


def test_drift_takes_replays_once(spark, tmp_path):
    """Events that come again, in a batch or a later one, change nothing."""
    from rivulet.streaming import slots

    _, batches = mixed_events()
    told = []
    for name, own in (("once", batches), ("again", [batches[0] + batches[0][::3], batches[0][-20:] + batches[1] + batches[1][::5], batches[2]])):
        out, dropped = drain(slots.stream_drift(slot_events(spark, str(tmp_path / name), own), 0.1), str(tmp_path / f"c-{name}"))
        assert dropped == 0
        told.append({r.start: (r.n, r.brier) for _, rows in out for r in rows})
    assert set(told[0]) == set(told[1]) and all(told[1][day] == pytest.approx(own, nan_ok=True) for day, own in told[0].items())


def test_state_stores_are_no_more_than_cores(spark):
    """A stream's partitions are bounded while it starts; the session's own number holds again after."""
    from rivulet.plans.queries import state_store

    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "500")
    with state_store(spark):
        assert int(spark.conf.get(name)) <= max(8, spark.sparkContext.defaultParallelism)
    assert spark.conf.get(name) == "500"
    spark.conf.set(name, before)
