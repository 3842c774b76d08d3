"""Series operators against plain loops, over hot, short and tied series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import series

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(600):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        out.append((i, key, T0 + timedelta(hours=rng.randrange(0, 200)), rng.choice([None, *range(0, 100, 5)])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v long").withColumn("day", F.date_trunc("day", "ts"))


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


ARGS = (["k"], ["ts", "id"], "day")
WHOLE = (["k"], ["ts", "id"], None)


def test_forward_fill(df, rows):
    got = {r.id: r.filled for r in series.forward_fill(df, ["k"], "ts", ["ts", "id"], "day", "v", max_age=3 * 3600.0).collect()}
    for own in by_key(rows).values():
        last = None
        for i, _, t, v in own:
            last = (t, v) if v is not None else last
            assert got[i] == (last[1] if last and t - last[0] <= timedelta(hours=3) else None)


@pytest.mark.parametrize("args", [ARGS, WHOLE])
def test_hysteresis_runs_and_debounce(df, rows, args):
    on = series.hysteresis(df, *args, "v", 20, 70)
    got = {r.id: r for r in series.debounce(series.runs(on, *args, "on"), *args, "on", 3).collect()}
    for own in by_key(rows).values():
        state, run, nth, before, stable = False, 0, 0, None, None
        for i, _, _, v in own:
            state = True if v is not None and v >= 70 else False if v is not None and v <= 20 else state
            run, nth = (run, nth + 1) if state == before else (run + 1, 1)
            before = state
            stable = state if nth >= 3 else stable
            assert (got[i].on, got[i].run, got[i].stable) == (state, run, stable)


def test_accumulators(df, rows):
    v = F.coalesce("v", F.lit(0))
    level = {r.id: r.level for r in series.clipped_decay(df, *ARGS, v, F.lit(40)).collect()}
    total = {r.id: r.total for r in series.resettable_sum(df, *ARGS, v, F.col("v") >= 90).collect()}
    for own in by_key(rows).values():
        s = acc = 0
        for i, _, _, x in own:
            s = max(0, s + (x or 0) - 40)
            acc = (0 if x is not None and x >= 90 else acc) + (x or 0)
            assert (level[i], total[i]) == (s, acc)


def test_episodes(df, rows):
    got = {(r.k, r.episode): (r.started, r.ended, r.n) for r in series.episodes(df, ["k"], "ts", ["ts", "id"], "day", 7200.0).collect()}
    want = {}
    for k, own in by_key(rows).items():
        e, last = 0, None
        for _, _, t, _ in own:
            e += last is None or t - last > timedelta(hours=2)
            s = want.get((k, e), (t, t, 0))
            want[k, e] = (s[0], t, s[2] + 1)
            last = t
    assert got == want


def test_asof_join_and_sequence(df, rows):
    left, right = df.where("v >= 50").select("id", "k", "ts"), df.where("v < 50").select("id", "k", "ts", "v")
    got = {r.id: r.v for r in series.asof_join(left, right, ["k"], "ts", "id", F.date_trunc("day", "ts"), ["v"], max_age=36000.0).collect()}
    follow = {r.id for r in series.followed_by(df, ["k"], "ts", ["ts", "id"], "day", F.col("v") == 0, F.col("v") == 95, 86400.0).collect()}
    n = 0
    for own in by_key(rows).values():
        zero = None
        for i, _, t, v in own:
            zero = t if v == 0 else zero
            assert (i in follow) == (v == 95 and zero is not None and t - zero <= timedelta(days=1))
            if v is not None and v >= 50:
                found = [(u, j, w) for j, _, u, w in own if w is not None and w < 50 and u <= t]
                best = max(found, default=None)
                assert got[i] == (best[2] if best and t - best[0] <= timedelta(hours=10) else None)
                n += 1
    assert n == len(got)


def test_robust_summary(df, rows):
    import numpy as np

    got = {r.k: r for r in series.robust_summary(df, ["k"], "ts", "id", "v").collect()}
    slope = {r.k: r.slope_per_hour for r in series.slopes(df, ["k"], "ts", "v").collect()}
    for k, own in by_key(rows).items():
        own = [r for r in own if r[3] is not None]
        v = np.array([r[3] for r in own], float)
        t = np.array([(r[2] - T0).total_seconds() / 3600 for r in own])
        r = got[k]
        assert (r.n, r.least, r.greatest, r.first_value, r.last_value) == (len(v), v.min(), v.max(), v[0], v[-1])
        assert r.median == np.median(v) and r.mad == np.median(np.abs(v - np.median(v)))
        assert slope[k] == pytest.approx(np.polyfit(t, v, 1)[0])


def test_empty_series(df):
    none = df.limit(0)
    assert series.hysteresis(none, *ARGS, "v", 1, 2).count() == 0
    assert series.episodes(none, ["k"], "ts", ["ts", "id"], "day", 1.0).count() == 0


def test_phasors(spark):
    from millrace.functions.phasors import symmetrical_components, unbalance_percent

    df = spark.createDataFrame([(100.0, 100.0, 100.0), (115.0, 100.0, 100.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    got = [r.u for r in df.select(unbalance_percent(F.col("a"), F.col("b"), F.col("c")).alias("u")).collect()]
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(100 * 5 / 105) and got[2] is None
    same = (F.col("a"), F.lit(0.0))
    zero, positive, _ = symmetrical_components(same, same, same)
    assert df.limit(1).select(zero.alias("z"), positive.alias("p")).first() == pytest.approx((100, 0), abs=1e-9)
