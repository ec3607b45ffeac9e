"""One-pass bagging, bounded isotonic fits, quantile sketches and tables kept up by day, each against a plain version."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.functions.numbers import poisson_one, uniform
from rivulet.operators import quantiles, reliability, uncertainty
from rivulet.plans.recommend import Plan
from rivulet.sources import daily
from rivulet.sources.tables import CUT

OBS = "event_id long, ts timestamp, zone_id int, sensor string, value double"
T0 = dt.datetime(2024, 1, 1)


def test_newton_fits_all_members_like_one(spark, sf_dir):
    """Each member against Newton's method in numpy on its own bootstrap; predictions of all later cells."""
    plan = Plan(spark, sf_dir)
    cells = uncertainty.predictors(plan.features).toPandas()
    y = plan.tables.outcome.select("zone_id", "valid_date", "flooded").toPandas()
    early = cells[cells.valid_date < dt.date(2024, 1, 16)].merge(y)
    weights = plan.tables.outcome.select("zone_id", "valid_date", *(poisson_one(uniform(F.lit(m), "zone_id", "valid_date")).alias(f"w{m}") for m in range(3))).toPandas()
    early, late = early.merge(weights), cells[cells.valid_date >= dt.date(2024, 1, 16)]
    mean, sd = early[uncertainty.PREDICTORS].mean().to_numpy(), early[uncertainty.PREDICTORS].std(ddof=0).to_numpy()
    x = lambda df: np.c_[np.ones(len(df)), (df[uncertainty.PREDICTORS].to_numpy() - mean) / sd]
    want = {}
    for m in range(3):
        w, b = early[f"w{m}"].to_numpy(float), np.zeros(4)
        penalty = np.array([0, 1, 1, 1]) * 0.01 * w.sum()
        for _ in range(5):
            p = 1 / (1 + np.exp(-x(early) @ b))
            h = (x(early) * (w * p * (1 - p))[:, None]).T @ x(early) + np.diag(penalty)
            b = b + np.linalg.solve(h, x(early).T @ (w * (early.flooded.to_numpy() - p)) - penalty * b)
        for z, d, q in zip(late.zone_id, late.valid_date, 1 / (1 + np.exp(-x(late) @ b)), strict=True):
            want[z, d, f"bag{m}"] = q
    got = {(r.zone_id, r.valid_date, r.member): r.prob for r in uncertainty.bagged_newton(plan.features, plan.tables.outcome, 3, CUT).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_newton_without_early_cells(spark, sf_dir):
    plan = Plan(spark, sf_dir)
    rows = uncertainty.bagged_newton(plan.features, plan.tables.outcome.limit(0), 2, CUT).collect()
    assert rows and {r.prob for r in rows} == {0.5}


def plain_isotonic(points):
    """Largest over i <= s of the least mean of i..j, j >= s."""
    s = sorted(points)
    mean = lambda i, j: sum(points[k][0] for k in s[i : j + 1]) / sum(points[k][1] for k in s[i : j + 1])
    return {s[k]: max(min(mean(i, j) for j in range(k, len(s))) for i in range(k + 1)) for k in range(len(s))}


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_blocks(spark, seed):
    rng = random.Random(seed)
    points = {s: (sum(rng.random() < s / 300 for _ in range(w)), w) for s in rng.sample(range(300), 60) for w in [rng.randint(1, 6)]}
    frame = spark.createDataFrame([(s, float(t), float(w)) for s, (t, w) in points.items()], "s int, total double, weight double")
    blocks = [(r.s, r.total / r.weight) for r in reliability.isotonic_blocks(frame.repartition(4)).orderBy("s").collect()]
    assert [v for _, v in blocks] == sorted({v for _, v in blocks})
    want = plain_isotonic(points)
    assert all(abs(max(b for b in blocks if b[0] <= s)[1] - v) < 1e-9 for s, v in want.items())
    # In parts or at once, the same.
    rows = sorted((s, float(t), float(w)) for s, (t, w) in points.items())
    once = reliability.merged_blocks(rows)
    assert once == reliability.merged_blocks(b for k in range(0, 60, 7) for b in reliability.merged_blocks(rows[k : k + 7])) and [b[0] for b in once] == [s for s, _ in blocks]


def test_isotonic_edges(spark):
    cells = lambda rows: spark.createDataFrame([(z, dt.date.fromisoformat(d), p) for z, d, p in rows], "zone_id int, valid_date date, p double")
    seen = spark.createDataFrame([(z, dt.date(2024, 1, 2), y) for z, y in ((1, 0), (2, 1), (3, 0), (4, 1))], "zone_id int, valid_date date, flooded int")
    early = [(1, "2024-01-02", 0.2), (2, "2024-01-02", 0.4), (3, "2024-01-02", 0.6), (4, "2024-01-02", 0.9)]
    late = [(1, "2024-02-01", 0.0), (2, "2024-02-01", 0.39994), (3, "2024-02-01", 0.39996), (4, "2024-02-01", 0.7), (5, "2024-02-01", 1.0), (6, "2024-02-01", None)]
    got = {r.zone_id: r.recalibrated for r in reliability.recalibrate_isotonic(cells(early + late), seen, CUT).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.5, 4: 0.5, 5: 1.0, 6: None}
    none = {r.zone_id: r.recalibrated for r in reliability.recalibrate_isotonic(cells(late[:2]), seen, CUT).collect()}
    assert none == {1: 0.0, 2: 0.39994}


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(0)
    n = 60_000
    rows = zip(range(n), (T0 + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 20 * 1440, n)), rng.choice([1, 1, 1, 1, 2, 3, 4], n).tolist(), ["a"] * n, rng.gamma(2, 30, n).tolist(), strict=True)
    return spark.createDataFrame([*rows, (n, T0, 1, "a", None), (n + 1, T0, 1, "a", math.nan), (n + 2, None, 1, "a", 1.0)], OBS).repartition(6).persist()


def test_sketches_stay_within_their_rank_error(spark, raw):
    zone = spark.createDataFrame([(1, "one", 0, "X"), (2, "two", 0, "X"), (3, "three", 1, "Y"), (4, "four", 1, "Y")], "zone_id int, zone_name string, district_id int, district_name string")
    sketches = quantiles.quantile_sketches(raw)
    values = raw.where("ts is not null and value is not null and not isnan(value)").toPandas()
    rows = {(r.level, r.district, r.zone_id): r for r in quantiles.sketch_intervals(quantiles.merged_sketches(sketches, zone)).collect()}
    of = {("city", "ALL", -1): [1, 2, 3, 4], ("district", "X", -1): [1, 2], ("district", "Y", -1): [3, 4]} | {("zone", "XXYY"[z - 1], z): [z] for z in range(1, 5)}
    assert rows.keys() == of.keys()
    # Twice the error that one quantile in a hundred may pass: no luck is needed.
    bound = 2 * quantiles.rank_error()
    for key, zones in of.items():
        own, r = np.sort(values[values.zone_id.isin(zones)].value.to_numpy()), rows[key]
        assert r.n == len(own)
        for q, x in ((0.05, r.lo), (0.5, r.mid), (0.95, r.hi)):
            assert abs(np.searchsorted(own, x) / len(own) - q) <= bound
    covered = {(r.level, r.district, r.zone_id): r for r in quantiles.sketch_coverage(sketches, zone, "2024-01-11").collect()}
    for key, zones in of.items():
        own = values[values.zone_id.isin(zones)]
        early, late = (own[m].value.to_numpy() for m in (own.ts < dt.datetime(2024, 1, 11), own.ts >= dt.datetime(2024, 1, 11)))
        lo, hi = np.quantile(early, [0.05, 0.95])
        assert covered[key].n == len(late) and abs(covered[key].coverage - np.mean((late >= lo) & (late <= hi))) <= 4 * bound
    assert quantiles.merged_sketches(quantiles.quantile_sketches(raw.limit(0)), zone).count() == 0


def test_sketches_read_raw_rows_once(raw, spark):
    zone = spark.createDataFrame([(1, "one", 0, "X")], "zone_id int, zone_name string, district_id int, district_name string")
    plan = quantiles.quantile_sketches(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_kll") == 1 or plan.lower().count("kll_sketch_agg") >= 1
    assert not any(x in plan for x in ("Python", "Arrow"))
    assert quantiles.merged_sketches(quantiles.quantile_sketches(raw), zone).where("level = 'city'").first().n > 0


def observations(days=25, seed=0):
    rng = random.Random(seed)
    rows = []
    for d in range(days):
        for z in (1, 2):
            for s in "ab":
                if rng.random() < 0.9:
                    rows += [(len(rows) + k, T0 + dt.timedelta(days=d, minutes=rng.randint(0, 1439)), z, s, round(rng.uniform(0, 200), 3)) for k in range(rng.randint(1, 4))]
    return rows


def test_late_days_alone_are_rewritten(spark, tmp_path):
    """Late events of two days: equal to a full run, and only their days' and the seven days' files after them are new."""
    rows = observations()
    late = [(9000 + k, T0 + dt.timedelta(days=d, hours=5), 1, "a", 777.0) for k, d in enumerate((4, 4, 20))] + [(9100, T0 + dt.timedelta(days=20, hours=7), 3, "c", 5.0)]
    obs, everything = (spark.createDataFrame(r, OBS) for r in (rows, rows + late))
    path = str(tmp_path)
    daily.build(obs, path)
    files = lambda kind: {str(f): f.stat().st_mtime_ns for f in (tmp_path / kind).rglob("*.parquet")}
    before = {kind: files(kind) for kind in ("daily", "features")}
    days = [(T0 + dt.timedelta(days=d)).date() for d in (4, 20)]
    for _ in range(2):  # a repeated refresh changes nothing
        daily.refresh(everything, path, days)
        got = sorted(map(str, daily.features(spark, path).collect()))
        assert got == sorted(map(str, uncertainty.zone_features(everything).collect()))
    day_of = lambda f: dt.date.fromisoformat(f.split("valid_date=")[1][:10])
    changed = {kind: {day_of(f) for f in files(kind).keys() ^ before[kind].keys()} for kind in before}
    assert changed["daily"] == set(days)
    assert changed["features"] == {d for d in daily.touched(days) if d < (T0 + dt.timedelta(days=25)).date()} and len(changed["features"]) < 15


def test_refresh_prunes_partitions(spark, tmp_path):
    daily.build(spark.createDataFrame(observations(), OBS), str(tmp_path))
    plan = daily.refreshed(spark, str(tmp_path), [dt.date(2024, 1, 9)])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "valid_date" in filters and "2024-01-02" in filters and "2024-01-16" in filters
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts"), F.lit(1).alias("zone_id"), F.lit("a").alias("sensor"), "value")
    scan = daily.daily_means(daily.observed_on(events, [dt.date(2024, 1, 9)]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan


def test_refresh_of_nothing_and_of_a_new_day(spark, tmp_path):
    rows = observations(5)
    daily.build(spark.createDataFrame(rows, OBS), str(tmp_path))
    daily.refresh(spark.createDataFrame(rows, OBS), str(tmp_path), [])
    more = rows + [(5000, T0 + dt.timedelta(days=9), 1, "a", 3.0)]
    daily.refresh(spark.createDataFrame(more, OBS), str(tmp_path), [(T0 + dt.timedelta(days=9)).date()])
    assert sorted(map(str, daily.features(spark, str(tmp_path)).collect())) == sorted(map(str, uncertainty.zone_features(spark.createDataFrame(more, OBS)).collect()))
