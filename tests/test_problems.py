"""The general problem operators against brute force and planted cases."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tideline.operators import grid, keyagg, readings, rolling, spikes

DAY = readings.DAY_MS
SAMPLES = "series_id bigint, t bigint, v double, seq bigint, chunk string, n string"


def _samples(spark, data):
    """Samples with two extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y") for r in data], SAMPLES)


def _messy(seed, n=400):
    rnd, out = random.Random(seed), []
    for i in range(n):
        v = rnd.choice([1.0, 2.5, -3.0, 0.0, None, float("nan"), float("inf")])
        out.append((rnd.choice([1, 2, 3, None]), rnd.choice([rnd.randrange(-5 * DAY, 60 * DAY), 7, None]), v, rnd.choice([i, i, 5, None])))
    return out + out[:40]


def _latest(data):
    best = {}
    for s, t, v, q in data:
        if s is None or t is None:
            continue
        rank = (-(2**63) if q is None else q, v is not None, math.isnan(v) if v is not None else False, 0 if v is None or math.isnan(v) else v)
        if (s, t) not in best or rank > best[s, t][0]:
            best[s, t] = (rank, v)
    return {k: v for k, (_, v) in best.items() if v is not None and not math.isnan(v)}


def test_readings(spark):
    data = _messy(1)
    assert rows(readings.readings(_samples(spark, data)), "series_id", "t", "v") == sorted((*k, v) for k, v in _latest(data).items())
    days = spark.createDataFrame([(-1,), (0,), (DAY,), (-DAY,), (2**62,)], "t bigint").select(readings.day().alias("d"))
    assert [r.d for r in days.collect()] == [-1, 0, 1, -1, 2**62 // DAY]


def test_rolling(spark):
    data = _messy(2)
    days = {}
    for (s, t), v in _latest(data).items():
        days.setdefault((s, t // DAY), []).append(v)
    got = {(r.series_id, r.day_no): r for r in rolling.trailing(rolling.daily_totals(_samples(spark, data))).collect()}
    for s in {k[0] for k in days}:
        own = sorted(d for x, d in days if x == s)
        for d in range(own[0], own[-1] + 1):
            r = got.pop((s, d))
            for p in (7, 30):
                values = [v for e in range(d - p + 1, d + 1) for v in days.get((s, e), [])]
                assert r[f"n_{p}"] == len(values) and r[f"sum_{p}"] == pytest.approx(sum(values))
                assert r[f"avg_{p}"] is None if not values else r[f"avg_{p}"] == pytest.approx(sum(values) / len(values))
    assert not got


def test_rolling_empty(spark):
    assert rolling.trailing(rolling.daily_totals(_samples(spark, []))).count() == 0


def test_grid(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 4)  # pairs cross blocks
    rnd = random.Random(3)
    asked = [(1, 100, 100 + 40 * 10 - 1, 10), (2, 0, 99, 10), (3, 5, 4, 10), (4, 0, 9, 0), (None, 0, 9, 5), (5, 0, 49, 10)]
    data = [(1, rnd.randrange(50, 600), rnd.choice([1.0, 2.0, None, float("nan")])) for _ in range(25)] + [(2, None, 1.0), (2, 500, 1.0), (None, 5, 1.0)]
    data += [(5, 12, 4.0), (5, 12, 2.0), (5, 41, float("inf"))] + data[:5]
    grids = spark.createDataFrame([(*r, "x") for r in asked], "id bigint, mint bigint, maxt bigint, step_ms bigint, slot string")
    points = spark.createDataFrame([(*r, "x") for r in data], "id bigint, t bigint, v double, mint string")
    got = {}
    for r in grid.regular(grids, points).collect():
        assert (r.id, r.slot_t) not in got
        got[r.id, r.slot_t] = r
    want = {(i, a + k * s) for i, a, b, s in asked if i and s > 0 and b >= a for k in range((b - a) // s + 1)}
    assert set(got) == want
    for i, a, b, s in asked:
        own = {}
        for j, t, v in data:
            if j == i and i and t is not None and v is not None and not math.isnan(v) and a <= t <= b:
                own[t] = max(v, own.get(t, v))
        for (j, slot), r in got.items():
            if j != i:
                continue
            here = [t for t in own if slot <= t < slot + s]
            before, after = max((t for t in own if t < slot), default=None), min((t for t in own if t >= slot + s), default=None)
            if here:
                assert r.state == "read" and r.v == own[max(here)]
            elif before is None and after is None:
                assert r.state == "none" and r.v is None
            elif before is None:
                assert r.state == "before" and r.v == (own[after] if after - slot <= 5 * s else None)
            elif after is None:
                assert r.state == "after" and r.v == (own[before] if slot - before <= 5 * s else None)
            elif after - before > 5 * s:
                assert r.state == "gap" and r.v is None
            elif math.isinf(own[before]) or math.isinf(own[after]):
                assert r.state == "filled" and r.v is None
            else:
                assert r.state == "filled" and r.v == pytest.approx(own[before] + (own[after] - own[before]) * (slot - before) / (after - before))


def test_grid_empty(spark):
    grids = spark.createDataFrame([(1, 0, 29, 10)], "id bigint, mint bigint, maxt bigint, step_ms bigint")
    points = spark.createDataFrame([], "id bigint, t bigint, v double")
    assert rows(grid.regular(grids, points), "slot_t", "state") == [(0, "none"), (10, "none"), (20, "none")]
    assert grid.regular(grids.where("false"), points).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_eager_totals(spark, how):
    rnd = random.Random(4)
    tags = [(rnd.choice(["a", "b", None]), rnd.choice(["hot", "hot", "hot", "x", None]), rnd.choice([1, 1, 1, 2, 3, None])) for _ in range(200)]
    data = [(rnd.choice([1, 1, 2, 9, None]), rnd.choice([1.0, 4.0, None, float("nan")])) for _ in range(150)]
    left = spark.createDataFrame([(*r, 0) for r in tags], "name string, value string, series_id bigint, m int")
    right = spark.createDataFrame([(*r, 0) for r in data], "series_id bigint, v double, r_n int")
    want = {}
    for n, v, s in tags:
        mates = [x for k, x in data if k is not None and k == s]
        if how == "inner" and not mates:
            continue
        w = want.setdefault((n, v), [0, 0, []])
        w[0] += 1
        w[1] += len(mates)
        w[2] += [x for x in mates if x is not None and not math.isnan(x)]
    got = keyagg.eager_totals(left, right, "series_id", ["name", "value"], "v", how).collect()
    assert len(got) == len(want)
    for r in got:
        n, pairs, values = want[r.name, r.value]
        assert (r.left_rows, r.pair_rows, r.pair_values) == (n, pairs, len(values))
        assert (r.pair_sum, r.pair_min, r.pair_max) == ((sum(values), min(values), max(values)) if values else (None, None, None))


def test_frequent(spark):
    left = spark.createDataFrame([("a", "x", 1)] * 98 + [("a", "y", 1)] * 2 + [("b", None, 2)] * 1, "name string, value string, series_id bigint")
    right = spark.createDataFrame([(1, 1.0)], "series_id bigint, v double")
    totals = keyagg.eager_totals(left, right, "series_id", ["name", "value"], "v")
    assert rows(keyagg.frequent(totals, 2 / 101), "name", "value") == [("a", "x"), ("a", "y")]
    assert keyagg.frequent(keyagg.eager_totals(left.where("false"), right, "series_id", ["name", "value"], "v"), 0.1).count() == 0


def _planted(seed, n=300, level=50.0):
    rng = np.random.default_rng(seed)
    v = level + rng.normal(0, 0.5, n)
    v[60], v[61], v[100], v[150], v[151], v[152] = level + 30, level + 28, level - 20, level + 15, level + 16, level + 14
    v[200:212] = v[200]
    v[250:] += 25  # a level that stays
    v[270] = 1e9
    faults = {60: "spike", 61: "spike", 100: "spike", 150: "spike", 151: "spike", 152: "spike", 270: "out_of_bounds"}
    return v, faults | dict.fromkeys(range(200, 212), "stuck")


@pytest.mark.parametrize("block", [10_000, 100, 32])
def test_faults_are_found_whatever_the_blocks(spark, block):
    hour, data, want = 3_600_000, [], set()
    for sid in (1, 2):
        v, faults = _planted(sid)
        data += [(sid, i * hour, float(x), i) for i, x in enumerate(v)]
        want |= {(sid, i * hour, kind) for i, kind in faults.items()}
    rng = np.random.default_rng(9)
    bursts = np.where(rng.random(300) < 0.25, rng.exponential(200, 300), 0) + rng.normal(8, 2, 300)
    counter = np.cumsum(rng.integers(5, 15, 300)).astype(float)
    counter[150:] -= counter[150]
    data += [(3, i * hour, float(x), i) for i, x in enumerate(np.maximum(bursts, 0))]
    data += [(4, i * hour, float(x), i) for i, x in enumerate(counter)]
    data += [(5, i * hour, 7.0, i) for i in range(300)]  # constant
    data += [(6, i * hour, float(i // 12), i) for i in range(300)]  # holds as usual
    data += [(7, 5, 1.0, 0), (8, 5, None, 0), (9, 5, -1e9, 0)]  # one reading, none, one out of bounds
    want |= {(9, 5, "out_of_bounds")}
    series = spark.createDataFrame([(s, {"__name__": "m"}) for s in range(1, 10)] + [(1, {"__name__": "m"}), (77, {})], "series_id bigint, labels map<string,string>")
    ref = spark.createDataFrame([("m", -1000.0, 1e6, 0.001)], "metric_name string, min_value double, max_value double, same_tol double")
    got = spikes.implausible(_samples(spark, data + data[:50]), series, ref, rows=block)
    flags = {(r.series_id, r.t, k) for r in got.collect() for k in ("spike", "stuck", "out_of_bounds") if r[k]}
    assert flags == want


def test_faults_without_limits_or_rows(spark):
    v, _ = _planted(1)
    data = _samples(spark, [(1, i, float(x), i) for i, x in enumerate(v)] + [(1, 1000, float("inf"), 5000), (1, 1001, 75.0, 5001)])
    none = spark.createDataFrame([], "series_id bigint, labels map<string,string>")
    ref = spark.createDataFrame([], "metric_name string, min_value double, max_value double, same_tol double")
    got = spikes.implausible(data, none, ref)
    assert {r.t for r in got.collect()} == {60, 61, 100, 150, 151, 152, 270, 1000}
    assert spikes.implausible(data.where("false"), none, ref).count() == 0
    assert got.where(F.col("out_of_bounds") | F.col("stuck")).count() == 0


def test_frozen_runs_count_whole_over_blocks(spark):
    v = [float(i * 37 % 101) for i in range(100)]
    frozen = [i for a in (13, 43, 77) for i in range(a, a + 12)]
    for i in frozen:
        v[i] = v[max(a for a in (13, 43, 77) if a <= i)]
    short = [(2, d, float("inf") if d == 4 else float(d % 3), d) for d in range(9)]
    data = [(1, d, x, d) for d, x in enumerate(v)] + short
    frame = spark.createDataFrame([(s, d * readings.DAY_MS, x, q) for s, d, x, q in data], "series_id bigint, t bigint, v double, seq bigint")
    series = spark.createDataFrame([(s, {"__name__": "m"}) for s in (1, 2)], "series_id bigint, labels map<string,string>")
    ref = spark.createDataFrame([("m", None, None, 0.01)], "metric_name string, min_value double, max_value double, same_tol double")
    for block in (16, 20, 1000):
        got = spikes.implausible(frame, series, ref, rows=block).collect()
        assert sorted(r.t // readings.DAY_MS for r in got if r.series_id == 1 and r.stuck) == frozen
        assert [r.t // readings.DAY_MS for r in got if r.series_id == 2 and r.spike] == [4]


def test_spikes_of_short_series_are_judged_by_their_metric(spark):
    rng = np.random.default_rng(4)
    data = [(s, i * 1000, 50 + float(rng.normal(0, 0.5)), i) for s in range(5) for i in range(60)]
    short = [50.1, 50.2, 50.1, 50.3, 50.2, 50.1, 80.0, 50.3, 50.1, 50.2, 50.0, 50.1]
    mild = [50.1, 50.2, 50.1, 50.2, 50.1, 50.2, 51.2, 50.1, 50.2, 50.1, 50.2, 50.1]  # much for itself, usual for its metric
    data += [(s, i * 1000, x, i) for s, own in ((10, short), (11, mild), (12, short)) for i, x in enumerate(own)]
    series = spark.createDataFrame([(s, {"__name__": "m"}) for s in (*range(5), 10, 11)] + [(12, {"__name__": "lonely"})], "series_id bigint, labels map<string,string>")
    ref = spark.createDataFrame([("m", None, None, 0.001)], "metric_name string, min_value double, max_value double, same_tol double")
    got = spikes.implausible(_samples(spark, data), series, ref).where("spike AND series_id >= 10")
    assert rows(got, "series_id", "t") == [(10, 6000)]


def test_a_wild_time_costs_days_not_an_error(spark):
    far = 3 * 10**14  # some 9,500 years on
    got = rolling.trailing(rolling.daily_totals(_samples(spark, [(1, -400 * DAY, 1.0, 1), (1, far, 2.0, 2)])))
    assert got.count() == far // DAY + 401 == got.select("day_no").distinct().count()
    assert got.agg(F.min("day_no"), F.max("day_no")).first()[:] == (-400, far // DAY)
