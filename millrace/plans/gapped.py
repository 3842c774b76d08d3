"""Queries on series with gaps: views are the readings, an error opens a gap of twelve hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import phasors, power
from millrace.functions.intervals import micros, seconds_between
from millrace.operators import gaps, intervals, running, series, summaries
from millrace.plans.catalogue import _E, _MERGED, KEYS, ORDER, _drain, _sessions, _shared, bucket, query, readings
from millrace.streaming import flows

UNTIL = "2024-02-01"
PAUSE = 172800.0

_G = _E + ", " + _MERGED.format(name="g", hours=12, kind="error")
_V = _G + """, v AS (SELECT *, lag(ts) OVER w AS before, lag(value) OVER w AS value_before FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, date_diff('microsecond', before, ts) / 1e6 AS s, date_diff('microsecond', before, ts) > 172800000000 OR EXISTS (SELECT 1 FROM g WHERE g.user_id = v.user_id AND g.start < v.ts AND g.stop > v.before) AS broken FROM v WHERE before IS NOT NULL)"""


def _views(spark, sf_dir):
    return readings(spark, sf_dir).where("event_type = 'view'")


def _pairs(spark, sf_dir):
    v, g = _views(spark, sf_dir), _sessions(spark, sf_dir, "error", 12)
    return gaps.pairs(v, g, KEYS, "ts", ORDER, "value", PAUSE, bucket(v.select("user_id", "day").union(g.select("user_id", "start"))))


@query(_G + """ SELECT event_id, user_id, ts FROM e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = e.user_id AND g.start <= e.ts AND e.ts < g.stop)""")
def readings_outside_gaps(spark, sf_dir):
    v = _views(spark, sf_dir)
    return gaps.outside_gaps(v, _sessions(spark, sf_dir, "error", 12), KEYS, "ts", "event_id", bucket(v)).select("event_id", "user_id", "ts")


@query(_V + """ SELECT event_id, user_id, broken FROM p""")
def broken_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("event_id", "user_id", "broken")


@query(_V + """ SELECT user_id, round(coalesce(sum(s) FILTER (NOT broken AND value_before < 30), 0), 4) AS seconds FROM p GROUP BY user_id""")
def seconds_below_level(spark, sf_dir):
    out = gaps.seconds_where(_pairs(spark, sf_dir), KEYS, "ts", F.col("before.v") < 30)
    return out.select("user_id", F.round("seconds", 4).alias("seconds"))


@query(_V + """, r AS (SELECT user_id, CASE WHEN NOT broken AND s >= 1e-6 THEN (value - value_before) / s END AS r FROM p)
SELECT user_id, round(max(abs(r)) * 3600, 5) AS greatest_rate, round(max(r) FILTER (r > 0) * 3600, 5) AS fastest_rise, round(min(r) FILTER (r < 0) * 3600, 5) AS fastest_fall FROM r GROUP BY user_id""")
def fastest_changes(spark, sf_dir):
    """By device, in units an hour."""
    out = gaps.rates(_pairs(spark, sf_dir), KEYS, "ts", "value")
    return out.select("user_id", *[F.round(F.col(c) * 3600, 5).alias(c) for c in ("greatest_rate", "fastest_rise", "fastest_fall")])


@query(_V + """ SELECT user_id, count(*) FILTER (value_before >= 40 AND value < 40) AS fronts FROM v GROUP BY user_id""")
def falling_fronts(spark, sf_dir):
    v = _views(spark, sf_dir)
    return gaps.falling_fronts(v, KEYS, ORDER, "value", 40.0, bucket(v))


@query(f"""{_E}, h AS (SELECT user_id, ts AS start, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '{UNTIL}') AS stop, value FROM e),
k AS (SELECT * FROM h WHERE value >= 70 AND start < stop),
n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM k),
j AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS i FROM n)
SELECT user_id, min(start) AS start, max(stop) AS stop FROM j GROUP BY user_id, i""")
def high_intervals(spark, sf_dir):
    """A step function as intervals: the times at which a device's last reading was 70 or more."""
    e = readings(spark, sf_dir)
    return gaps.state_intervals(e, KEYS, "ts", ORDER, F.col("value") >= 70, F.lit(UNTIL).cast("timestamp_ntz"), bucket(e))


@query(f"""SELECT user_id, max(ts) AS start, NULL::TIMESTAMP AS stop FROM events WHERE event_type = 'view' GROUP BY user_id HAVING date_diff('microsecond', max(ts), TIMESTAMP '{UNTIL}') > 259200000000""")
def tail_gaps(spark, sf_dir):
    return gaps.tail_gaps(_views(spark, sf_dir), KEYS, "ts", F.lit(UNTIL).cast("timestamp_ntz"), 259200.0)


@query(f"""SELECT user_id, max(ts) AS seen, max(ts) < TIMESTAMP '{UNTIL}' - INTERVAL 36 HOUR AS stale FROM events GROUP BY user_id""")
def freshness(spark, sf_dir):
    """When each device was last heard of, and whether that is too long ago."""
    seen = readings(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("seen"))
    return seen.withColumn("stale", seconds_between(F.col("seen"), F.lit(UNTIL).cast("timestamp_ntz")) > 36 * 3600)


@query("WITH " + _MERGED.format(name="a", hours=24, kind="view") + """, d AS (SELECT user_id, start, stop, unnest(generate_series(date_trunc('day', start)::TIMESTAMP, date_trunc('day', stop - INTERVAL 1 MICROSECOND)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM a),
c AS (SELECT user_id, date_diff('microsecond', greatest(start, day), least(stop, day + INTERVAL 1 DAY)) / 1e6 AS s FROM d)
SELECT user_id, round(sum(s), 4) AS seconds, round(sum(s * s / 86400) / sum(s), 6) AS quality FROM c GROUP BY user_id""")
def weighted_quality(spark, sf_dir):
    """Pieces of busy time by day, their quality being the share of the day that they fill."""
    views = _sessions(spark, sf_dir, "view", 24)
    pieces = intervals.cut_at_days(intervals.merge(views, KEYS, cell=bucket(views)))
    out = gaps.weighted_quality(pieces.withColumn("q", seconds_between(F.col("start"), F.col("stop")) / 86400), KEYS, "q")
    return out.select("user_id", F.round("seconds", 4).alias("seconds"), F.round("quality", 6).alias("quality"))


_LEVEL = f"""{_E}, t AS (
  SELECT *, coalesce(last_value(CASE WHEN value >= 30 THEN 1 WHEN value < 20 THEN 0 END IGNORE NULLS) OVER w, (first_value(value) OVER w >= 25)::INT) AS a,
            coalesce(last_value(CASE WHEN value >= 80 THEN 1 WHEN value < 70 THEN 0 END IGNORE NULLS) OVER w, (first_value(value) OVER w >= 75)::INT) AS b FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT event_id, user_id, ts, (a + b)::INT AS level FROM t)"""


def _levels(spark, sf_dir):
    e = readings(spark, sf_dir)
    day = bucket(e)
    return gaps.deadband_level(e, KEYS, ORDER, "value", [25.0, 75.0], 5.0, day), day


@query(_LEVEL + """ SELECT event_id, user_id, level FROM l""")
def deadband_levels(spark, sf_dir):
    return _levels(spark, sf_dir)[0].select("event_id", "user_id", "level")


@query(_LEVEL + """, m AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
c AS (SELECT user_id, run, any_value(level) AS state, min(ts) AS start FROM r GROUP BY user_id, run HAVING count(*) >= 2),
f AS (SELECT * FROM c QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY user_id ORDER BY run))
SELECT user_id, state, start, lead(start) OVER (PARTITION BY user_id ORDER BY run) AS stop FROM f""")
def confirmed_levels(spark, sf_dir):
    """Two equal levels in a row confirm one; the boundary lies at the first."""
    levels, day = _levels(spark, sf_dir)
    return gaps.confirmed_segments(series.runs(levels, KEYS, ORDER, day, "level"), KEYS, "ts", "level", "run", 2)


@query("WITH " + _MERGED.format(name="a", hours=24, kind="view") + """, q AS (
  SELECT a.user_id, a.start AS s, a.stop AS e, a.start AS t, false AS is_cut FROM a
  UNION ALL SELECT DISTINCT a.user_id, a.start, a.stop, x.ts, true FROM a JOIN events x ON x.user_id = a.user_id AND x.event_type = 'error' AND x.ts > a.start AND x.ts < a.stop)
SELECT user_id, t AS start, coalesce(lead(t) OVER w, e) AS stop, row_number() OVER w AS piece, is_cut FROM q WINDOW w AS (PARTITION BY user_id, s ORDER BY t)""")
def cut_at_errors(spark, sf_dir):
    """Busy times cut where an error occurs in them."""
    views, errors = _sessions(spark, sf_dir, "view", 24), readings(spark, sf_dir).where("event_type = 'error'")
    day = bucket(views)
    return gaps.cut_at(intervals.merge(views, KEYS, cell=day), errors, KEYS, "ts", day)


@query(f"""{_E}, f AS (SELECT user_id, min(ts) AS first FROM e WHERE event_type = 'error' GROUP BY user_id)
SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS rank FROM e JOIN f USING (user_id) WHERE e.ts < f.first QUALIFY rank <= 3""")
def last_before_first_error(spark, sf_dir):
    """A top-k report: the three readings before a device's first error, the last one first."""
    e = readings(spark, sf_dir)
    first = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("first"))
    before = e.join(first, "user_id").where(F.col("ts") < F.col("first"))
    return summaries.top_rows(before, KEYS, [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "rank")


@query(f"""{_E}, p AS (SELECT *, sum((event_type = 'signup')::INT) OVER w AS era, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS zone, date_diff('microsecond', ts, lead(ts) OVER w2) AS us FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, era::BIGINT AS era, zone, coalesce(sum(us), 0)::BIGINT AS micros FROM p GROUP BY user_id, era, zone""")
def zone_time_by_era(spark, sf_dir):
    """Time in each zone since each reset (a signup), a reading holding until the next."""
    e = readings(spark, sf_dir)
    day = bucket(e)
    out = running.running_sum(e, KEYS, day, ORDER, F.when(F.col("event_type") == "signup", 1).otherwise(0), "era")
    out = running.following(out, KEYS, day, ORDER, F.col("ts"), "next").withColumn("zone", F.when(F.col("value") < 50, "low").otherwise("high"))
    return out.groupBy("user_id", "era", "zone").agg(F.coalesce(F.sum(micros(F.col("next")) - micros(F.col("ts"))), F.lit(0)).alias("micros"))


_ALARMS = f"""{_E}, i AS (SELECT *, row_number() OVER w AS i, lead(ts) OVER w AS miss, count(*) OVER (PARTITION BY user_id) AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT *, (coalesce(lead(i) OVER w, c + 1) - i - 1 >= 3)::INT AS ends FROM i WHERE value >= 80 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(ends) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - ends AS ep FROM a),
r AS (SELECT user_id, min(ts) AS opened, max(CASE WHEN ends = 1 THEN miss END) AS closed, max(value) AS worst, count(*) AS n FROM g GROUP BY user_id, ep)"""


@query(_ALARMS + """ SELECT user_id, opened, closed, worst, n FROM r""")
def alarm_lifecycles(spark, sf_dir):
    """Alarms from a reading of 80 or more until three in a row are below."""
    e = readings(spark, sf_dir)
    return summaries.alarm_lifecycles(e, KEYS, "ts", ORDER, F.col("value") >= 80, F.col("value"), 3, bucket(e))


@query(_ALARMS + """ SELECT user_id, opened, closed, worst, n FROM r WHERE opened < TIMESTAMP '2024-01-20' AND (opened >= TIMESTAMP '2024-01-10' OR closed IS NULL OR closed > TIMESTAMP '2024-01-10 06:00:00')""")
def alarms_of_window(spark, sf_dir):
    """Alarms that opened in ten days, or were open when these ended, or closed later than six hours after they began."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    alive = F.col("closed").isNull() | (F.col("closed") > at("2024-01-10 06:00:00"))
    return alarm_lifecycles(spark, sf_dir).where((F.col("opened") < at("2024-01-20")) & ((F.col("opened") >= at("2024-01-10")) | alive))


@query(f"""{_E}, h AS (SELECT user_id, value, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS us FROM e),
t AS (SELECT user_id, coalesce(sum(us) FILTER (value < 25), 0)::BIGINT AS low_micros, coalesce(sum(us) FILTER (value >= 75), 0)::BIGINT AS high_micros FROM h GROUP BY user_id)
SELECT *, CASE WHEN low_micros >= 864000000000 OR high_micros >= 691200000000 THEN 'red' WHEN low_micros >= 432000000000 OR high_micros >= 345600000000 THEN 'yellow' ELSE 'green' END AS level FROM t""")
def wear_levels(spark, sf_dir):
    """How long each device lay low and high, and the level of wear that this makes: half of ten low or eight high days is yellow, all of it red."""
    e = readings(spark, sf_dir)
    held = running.following(e, KEYS, bucket(e), ORDER, F.col("ts"), "next").withColumn("us", micros(F.col("next")) - micros(F.col("ts")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("us"))), F.lit(0))
    out = held.groupBy("user_id").agg(total(F.col("value") < 25).alias("low_micros"), total(F.col("value") >= 75).alias("high_micros"))
    day = 86_400_000_000
    beyond = lambda share: (F.col("low_micros") >= int(10 * day * share)) | (F.col("high_micros") >= int(8 * day * share))
    return out.withColumn("level", F.when(beyond(1), "red").when(beyond(0.5), "yellow").otherwise("green"))


@query(_ALARMS + """ SELECT user_id, opened, closed, worst, n FROM r WHERE closed IS NOT NULL""")
def streamed_alarms(spark, sf_dir):
    """The same from the stream, as they close; its files are one batch, so that a device's readings are in order of time."""
    home = _shared(spark, "alarms")
    out = flows.closed_alarms(flows.read_readings(spark, f"{sf_dir}/events.parquet*", None), 80.0, 3)
    _drain(out.writeStream.outputMode("append").format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/log"))
    rows = spark.read.schema(flows.ALARMS).parquet(f"{home}/rows")
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("opened", "closed")], "worst", "n")


_HOURS = """WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, date_trunc('day', ts)::TIMESTAMP AS day, sum(CASE event_type WHEN 'view' THEN round(value * 100) END) / 100 AS a, sum(CASE event_type WHEN 'click' THEN round(value * 100) END) / 100 AS b, sum(CASE event_type WHEN 'error' THEN round(value * 100) END) / 100 AS c FROM events GROUP BY 1, 2),
q AS (SELECT *, (a + b + c) / 3 AS mean FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)"""


def _hours(spark, sf_dir):
    """Three signals by hour, where all have one."""
    total = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("cents"))).cast("double") / 100
    e = readings(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "day")
    return e.agg(total("view").alias("a"), total("click").alias("b"), total("error").alias("c")).dropna(subset=["a", "b", "c"])


@query(_HOURS + """ SELECT hour, round(100 * greatest(abs(a - mean), abs(b - mean), abs(c - mean)) / mean, 4) AS imbalance FROM q WHERE mean > 1e-6""")
def phase_imbalance(spark, sf_dir):
    """The greatest deviation of a phase from the mean of three, in percent of it."""
    out = _hours(spark, sf_dir).select("hour", F.round(phasors.imbalance_percent(F.col("a"), F.col("b"), F.col("c")), 4).alias("imbalance"))
    return out.where("imbalance is not null")


@query(_HOURS + """, u AS (SELECT day, hour, 100 * greatest(abs(a - mean), abs(b - mean), abs(c - mean)) / nullif(mean, 0) AS i, sqrt(greatest(0, a*a + b*b + c*c - a*b - b*c - a*c)) / 3 AS neg, lead(hour) OVER (PARTITION BY day ORDER BY hour) AS next FROM q),
s AS (SELECT *, date_diff('second', hour, next) AS s FROM u)
SELECT day, coalesce(sum(s) FILTER (i > 40), 0)::BIGINT AS imbalance_seconds, coalesce(sum(s) FILTER (neg > 20), 0)::BIGINT AS negative_seconds FROM s GROUP BY day""")
def imbalance_time_by_day(spark, sf_dir):
    """How long imbalance and negative sequence lay above a level, each hour holding until the day's next."""
    h = running.following(_hours(spark, sf_dir), ["day"], None, ["hour"], F.col("hour"), "next")
    zero = F.lit(0.0)
    _, _, negative = phasors.symmetrical_components((F.col("a"), zero), (F.col("b"), zero - phasors._TURN), (F.col("c"), zero + phasors._TURN))
    seconds = seconds_between(F.col("hour"), F.col("next")).cast("long")
    above = lambda c: F.coalesce(F.sum(F.when(c, seconds)), F.lit(0))
    return h.groupBy("day").agg(above(phasors.imbalance_percent(F.col("a"), F.col("b"), F.col("c")) > 40).alias("imbalance_seconds"), above(negative > 20).alias("negative_seconds"))


@query(_HOURS + """ SELECT day, round(max(abs(sqrt(a*a + b*b) - c)), 4) AS power_gap, round(max(CASE WHEN c > 1e-6 THEN abs(a / c - a / sqrt(a*a + b*b)) END), 6) AS factor_gap, round(median(b - a), 4) AS delta_median, round(max(b - a), 4) AS delta_greatest FROM q GROUP BY day""")
def power_consistency(spark, sf_dir):
    """Active, reactive and apparent power against each other, and the difference of two signals at common times."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    factor = F.when(c > 1e-6, F.abs(a / c - power.power_factor(a, b)))
    return _hours(spark, sf_dir).groupBy("day").agg(F.round(F.max(F.abs(power.apparent_power(a, b) - c)), 4).alias("power_gap"), F.round(F.max(factor), 6).alias("factor_gap"), F.round(F.median(b - a), 4).alias("delta_median"), F.round(F.max(b - a), 4).alias("delta_greatest"))
