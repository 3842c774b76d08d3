"""All queries over the driver's tables, with DuckDB SQL for the same rows.

events stands in for telemetry: user_id is the device, event_type the signal,
value the reading in hundredths (kept whole, so that sums are exact).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import power, thermal
from millrace.functions.intervals import micros
from millrace.functions.phasors import unbalance_percent
from millrace.operators import intervals, running, series, summaries, transients
from millrace.plans import config
from millrace.sources import tables
from millrace.streaming import flows

FLAGSHIP = "zone_segments"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Shared head of the SQL: events with the day and the reading in hundredths.
_E = "WITH e AS (SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP AS day, user_id, event_type, value, round(value * 100)::BIGINT AS cents FROM events)"
KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def bucket(df: DataFrame) -> str | None:
    """The day, if a device has more rows than a task should sort, else none."""
    return running.bucket_for(df, KEYS, "day")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "user_id", "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query(f"""{_E} SELECT day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(cents)::BIGINT AS cents FROM e GROUP BY ALL""")
def daily_event_rollup(spark, sf_dir):
    e = readings(spark, sf_dir)
    return e.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum("cents").alias("cents"))


@query(f"""{_E}, f AS (
  SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER w AS t,
            last_value(CASE WHEN event_type = 'purchase' THEN cents END IGNORE NULLS) OVER w AS v FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, CASE WHEN date_diff('microsecond', t, ts) <= 86400000000 THEN v END AS filled FROM f""")
def forward_fill(spark, sf_dir):
    e = readings(spark, sf_dir).withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("cents")))
    out = series.forward_fill(e, KEYS, "ts", ORDER, bucket(e), "paid", max_age=86400.0)
    return out.select("event_id", "user_id", "filled")


@query(f"""{_E}, l AS (SELECT * FROM e WHERE event_type = 'error'), r AS (SELECT * FROM e WHERE event_type = 'view')
SELECT l.event_id, l.user_id, l.ts, r.cents AS seen_cents FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_join(spark, sf_dir):
    e = readings(spark, sf_dir)
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts", F.col("cents").alias("seen_cents"))
    day = F.date_trunc("day", "ts") if bucket(e) else None
    return series.asof_join(errors, views, KEYS, "ts", "event_id", day, ["seen_cents"])


_STATE = f"""{_E}, d AS (
  SELECT *, coalesce(last_value(CASE WHEN value >= 80 THEN true WHEN value <= 20 THEN false END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS "on" FROM e)"""


@query(f"""{_STATE} SELECT event_id, user_id, "on" FROM d""")
def hysteresis_state(spark, sf_dir):
    e = readings(spark, sf_dir)
    return series.hysteresis(e, KEYS, ORDER, bucket(e), "value", low=20.0, high=80.0).select("event_id", "user_id", "on")


@query(f"""{_STATE}, b AS (SELECT *, CASE WHEN "on" IS DISTINCT FROM lag("on") OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS nth FROM r)
SELECT event_id, user_id, last_value(CASE WHEN nth >= 3 THEN CASE WHEN "on" THEN 'on' ELSE 'off' END END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stable FROM n""")
def debounced_state(spark, sf_dir):
    e = readings(spark, sf_dir)
    day = bucket(e)
    on = series.hysteresis(e, KEYS, ORDER, day, "value", low=20.0, high=80.0)
    on = on.withColumn("state", F.when(F.col("on"), "on").otherwise("off"))
    return series.debounce(on, KEYS, ORDER, day, "state", 3).select("event_id", "user_id", "stable")


@query(f"""{_STATE}, b AS (SELECT *, CASE WHEN "on" IS DISTINCT FROM lag("on") OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b)
SELECT user_id, run, any_value("on") AS "on", min(ts) AS start, max(ts) AS last_seen, count(*) AS n, median(cents)::DOUBLE AS median, min(cents) AS least, max(cents) AS greatest FROM r GROUP BY user_id, run""")
def zone_segments(spark, sf_dir):
    e = readings(spark, sf_dir)
    day = bucket(e)
    on = series.hysteresis(e, KEYS, ORDER, day, "value", low=20.0, high=80.0)
    out = series.runs(on, KEYS, ORDER, day, "on")
    return out.groupBy("user_id", "run").agg(F.first("on").alias("on"), F.min("ts").alias("start"), F.max("ts").alias("last_seen"), F.count("*").alias("n"), F.median("cents").alias("median"), F.min("cents").alias("least"), F.max("cents").alias("greatest"))


@query(f"""{_E}, x AS (SELECT * FROM e WHERE event_type = 'error'),
b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) > 43200000000 THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM b)
SELECT user_id, episode, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM g GROUP BY user_id, episode""")
def error_episodes(spark, sf_dir):
    errors = readings(spark, sf_dir).where("event_type = 'error'")
    return series.episodes(errors, KEYS, "ts", ORDER, bucket(errors), max_gap=43200.0)


@query(f"""{_E}, r AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM e)
SELECT event_id, user_id, sum(cents) OVER (PARTITION BY user_id, era ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM r""")
def resettable_total(spark, sf_dir):
    e = readings(spark, sf_dir)
    out = series.resettable_sum(e, KEYS, ORDER, bucket(e), F.col("cents"), F.col("event_type") == "signup")
    return out.select("event_id", "user_id", "total")


@query(f"""{_E}, s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN cents ELSE -2000 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM e)
SELECT event_id, user_id, (c - least(0, min(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS level FROM s""")
def clipped_decay_level(spark, sf_dir):
    error = F.col("event_type") == "error"
    gain, loss = F.when(error, F.col("cents")).otherwise(F.lit(0)), F.when(error, F.lit(0)).otherwise(F.lit(2000))
    e = readings(spark, sf_dir)
    out = series.clipped_decay(e, KEYS, ORDER, bucket(e), gain, loss)
    return out.select("event_id", "user_id", "level")


@query(f"""{_E}, m AS (SELECT user_id, event_type, median(cents)::DOUBLE AS median FROM e GROUP BY ALL)
SELECT user_id, event_type, count(*) AS n, min(cents) AS least, max(cents) AS greatest, arg_min(cents, (ts, event_id)) AS first_value, arg_max(cents, (ts, event_id)) AS last_value,
       any_value(m.median) AS median, median(abs(cents - m.median))::DOUBLE AS mad FROM e JOIN m USING (user_id, event_type) GROUP BY ALL""")
def robust_summary(spark, sf_dir):
    return series.robust_summary(readings(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", "cents")


@query(f"""{_E} SELECT event_type, round(regr_slope(cents, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9), 4) AS slope FROM e GROUP BY event_type""")
def signal_slope(spark, sf_dir):
    out = series.slopes(readings(spark, sf_dir), ["event_type"], "ts", "cents")
    return out.select("event_type", F.round("slope_per_hour", 4).alias("slope"))


@query(f"""{_E}, s AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM e)
SELECT event_id, user_id, ts, since FROM s WHERE event_type = 'purchase' AND date_diff('microsecond', since, ts) <= 21600000000""")
def view_then_purchase(spark, sf_dir):
    e = readings(spark, sf_dir)
    out = series.followed_by(e, KEYS, "ts", ORDER, bucket(e), F.col("event_type") == "view", F.col("event_type") == "purchase", 21600.0)
    return out.select("event_id", "user_id", "ts", "since")


def _sessions(spark, sf_dir, kind: str, hours: int) -> DataFrame:
    e = readings(spark, sf_dir).where(F.col("event_type") == kind)
    return e.select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr(f"interval {hours} hours")).alias("stop"))


_MERGED = """{name} AS (
  SELECT user_id, min(start) AS start, max(stop) AS stop FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
      FROM (SELECT user_id, ts AS start, ts + INTERVAL {hours} HOUR AS stop FROM events WHERE event_type = '{kind}'))) GROUP BY user_id, g)"""


@query("WITH " + _MERGED.format(name="a", hours=24, kind="view") + " SELECT * FROM a")
def merged_intervals(spark, sf_dir):
    views = _sessions(spark, sf_dir, "view", 24)
    return intervals.merge(views, KEYS, cell=bucket(views))


@query("WITH " + _MERGED.format(name="a", hours=24, kind="view") + ", " + _MERGED.format(name="h", hours=6, kind="error") + """,
c AS (SELECT user_id, start AS s, stop AS e FROM a),
p AS (SELECT user_id, s AS t FROM c UNION SELECT h.user_id, h.stop FROM h JOIN c ON h.user_id = c.user_id AND h.stop > c.s AND h.stop < c.e),
q AS (SELECT p.user_id, p.t AS start, (SELECT min(x) FROM (SELECT c.e AS x FROM c WHERE c.user_id = p.user_id AND c.s <= p.t AND p.t < c.e UNION ALL SELECT h.start FROM h WHERE h.user_id = p.user_id AND h.start >= p.t)) AS stop,
      EXISTS (SELECT 1 FROM h WHERE h.user_id = p.user_id AND h.start <= p.t AND p.t < h.stop) AS covered FROM p)
SELECT user_id, start, stop FROM q WHERE NOT covered""")
def uncovered_intervals(spark, sf_dir):
    views, errors = _sessions(spark, sf_dir, "view", 24), _sessions(spark, sf_dir, "error", 6)
    return intervals.subtract(views, errors, KEYS, cell=bucket(views.union(errors)))


@query("""WITH a AS (SELECT user_id, ts AS s, ts + INTERVAL 24 HOUR AS e FROM events WHERE event_type = 'view'), b AS (SELECT user_id, ts AS s, ts + INTERVAL 6 HOUR AS e FROM events WHERE event_type = 'error')
SELECT a.user_id, greatest(a.s, b.s) AS start, least(a.e, b.e) AS stop FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""")
def interval_overlaps(spark, sf_dir):
    return intervals.intersect(_sessions(spark, sf_dir, "view", 24), _sessions(spark, sf_dir, "error", 6), KEYS)


@query("WITH " + _MERGED.format(name="a", hours=24, kind="view") + """, d AS (SELECT user_id, start, stop, unnest(generate_series(date_trunc('day', start)::TIMESTAMP, date_trunc('day', stop - INTERVAL 1 MICROSECOND)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM a)
SELECT day, count(DISTINCT user_id) AS users, sum(date_diff('microsecond', greatest(start, day), least(stop, day + INTERVAL 1 DAY)))::BIGINT AS micros FROM d GROUP BY day""")
def busy_time_by_day(spark, sf_dir):
    views = _sessions(spark, sf_dir, "view", 24)
    days = intervals.cut_at_days(intervals.merge(views, KEYS, cell=bucket(views)))
    length = micros(F.col("stop")) - micros(F.col("start"))
    return days.groupBy("day").agg(F.countDistinct("user_id").alias("users"), F.sum(length).alias("micros"))


@query("""WITH p AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, sum(CASE event_type WHEN 'view' THEN round(value * 100) END) AS a, sum(CASE event_type WHEN 'click' THEN round(value * 100) END) AS b, sum(CASE event_type WHEN 'error' THEN round(value * 100) END) AS c FROM events GROUP BY 1),
q AS (SELECT hour, a, b, c, sqrt(greatest(0, a*a + b*b + c*c - a*b - b*c - a*c)) / 3 AS neg, (a + b + c) / 3 AS pos FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
SELECT hour, round(100 * neg / pos, 4) AS unbalance FROM q WHERE pos > 0""")
def phase_unbalance(spark, sf_dir):
    """Three signals of an hour as the magnitudes of three phases a third of a turn apart."""
    e = readings(spark, sf_dir)
    total = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("cents"))).cast("double")
    hours = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(total("view").alias("a"), total("click").alias("b"), total("error").alias("c")).dropna(subset=["a", "b", "c"])
    out = hours.select("hour", F.round(unbalance_percent(F.col("a"), F.col("b"), F.col("c")), 4).alias("unbalance"))
    return out.where("unbalance is not null")


@query(f"""{_E} SELECT user_id, day, count(*) AS n, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) WHEN 3 THEN 'error' WHEN 2 THEN 'purchase' WHEN 1 THEN 'signup' ELSE 'info' END AS worst FROM e GROUP BY user_id, day""")
def worst_by_day(spark, sf_dir):
    """Severity roll-up: the worst level of a device's day."""
    order = ["info", "signup", "purchase", "error"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("event_type"))
    out = readings(spark, sf_dir).groupBy("user_id", "day").agg(F.count("*").alias("n"), F.max(rank).alias("r"))
    return out.select("user_id", "day", "n", F.element_at(F.array(*map(F.lit, order)), F.greatest(F.lit(1), F.col("r")).cast("int")).alias("worst"))


@query(f"""{_E}, d AS (SELECT user_id, day, count(*) FILTER (event_type = 'error') AS n FROM e GROUP BY ALL)
SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)::BIGINT AS errors_7d FROM d""")
def trailing_errors(spark, sf_dir):
    """Errors of the seven days up to each day on which a device reported."""
    from pyspark.sql import Window

    days = readings(spark, sf_dir).groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    number = F.datediff("day", F.lit("2024-01-01"))
    w = Window.partitionBy("user_id").orderBy(number).rangeBetween(-6, 0)
    return days.select("user_id", "day", F.sum("n").over(w).alias("errors_7d"))


@query("""SELECT user_id, sum(1) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10""")
def busiest_devices(spark, sf_dir):
    """A top-k report: the ten devices with the most readings."""
    e = table(spark, sf_dir, "events")
    top = e.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
    theirs = running.beside(e.select("user_id", "value"), F.broadcast(top), KEYS, "inner")  # ten rows
    return theirs.groupBy("user_id").agg(F.first("n").alias("n"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("""SELECT n_name, o_orderpriority, count(*) AS orders, sum(round(l_extendedprice * 100) * (100 - round(l_discount * 100)))::BIGINT AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY ALL""")
def returned_revenue(spark, sf_dir):
    """A star join: the dimension tables are joined by size, filters reach the scan."""
    t = lambda name: table(spark, sf_dir, name)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    out = t("lineitem").where("l_returnflag = 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.sum(cents).alias("revenue"))


def _shared(spark: SparkSession, tag: str) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{tables.shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _drain(stream_writer) -> None:
    running = stream_writer.trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception():
        raise running.exception()


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def streamed_last_reading(spark, sf_dir):
    """events as a stream, merged batch by batch into a snapshot of each device's last reading."""
    home = _shared(spark, "snapshot")
    stream = flows.read_readings(spark, f"{sf_dir}/events.parquet*").withColumn("at", F.struct("ts", "event_id"))
    latest = lambda batch, n: flows.snapshot_writer(f"{home}/rows", ["user_id"], "at")(batch.groupBy("user_id").agg(F.max_by(F.struct("event_type"), "at").alias("r"), F.max("at").alias("at")), n)
    _drain(stream.writeStream.foreachBatch(latest).option("checkpointLocation", f"{home}/log"))
    last = flows.last_snapshot(spark, f"{home}/rows")
    rows = spark.read.parquet(last) if last else spark.createDataFrame([], "user_id long, r struct<event_type: string>, at struct<ts: timestamp, event_id: long>")
    return rows.select("user_id", F.col("at.event_id").alias("event_id"), F.col("at.ts").cast("timestamp_ntz").alias("ts"), F.col("r.event_type").alias("event_type"))


@query("""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, max(value) AS greatest FROM events GROUP BY ALL)
SELECT start, event_type, n, cents, greatest FROM h WHERE start + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM events)""")
def streamed_hourly_windows(spark, sf_dir):
    """Hourly windows of the stream that the watermark (10 minutes behind the last reading) has closed.

    The replay is bounded and its files need not be in order of time: they are one batch, so that nothing is late.
    """
    home = _shared(spark, "windows")
    out = flows.windowed_counts(flows.read_readings(spark, f"{sf_dir}/events.parquet*", None))
    _drain(out.writeStream.outputMode("append").format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/log"))
    rows = spark.read.parquet(f"{home}/rows")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents", "greatest")


@query("""WITH s AS (SELECT event_id AS step_id, user_id, ts FROM events WHERE event_type = 'purchase' AND value >= 80),
r AS (SELECT user_id, ts, 100.0::DOUBLE * (value - 50) / 50 AS d FROM events WHERE event_type = 'view'),
m AS (SELECT step_id, d, date_diff('microsecond', s.ts, r.ts) / 1e6 AS age FROM s JOIN r ON s.user_id = r.user_id AND r.ts > s.ts AND r.ts <= s.ts + INTERVAL 172800 SECOND),
o AS (SELECT *, coalesce(max(CASE WHEN abs(d) > 60 THEN age END) OVER (PARTITION BY step_id), 0) AS last_out FROM m),
f AS (SELECT step_id, count(*) AS n, round(greatest(0, -min(d)), 6) AS dip_percent, round(greatest(0, max(d)), 6) AS rise_percent, min(CASE WHEN age > last_out THEN age END) AS recovery_seconds FROM o GROUP BY step_id)
SELECT s.step_id, s.user_id, coalesce(n, 0)::BIGINT AS n, dip_percent, rise_percent, round(recovery_seconds, 6) AS recovery_seconds FROM s LEFT JOIN f USING (step_id)""")
def step_responses(spark, sf_dir):
    """How the viewing values of a device deviate from 50 in the two days after a large purchase."""
    e = table(spark, sf_dir, "events")
    steps = e.where("event_type = 'purchase' and value >= 80").select(F.col("event_id").alias("step_id"), "user_id", "ts")
    out = transients.step_response(steps, e.where("event_type = 'view'"), KEYS, "ts", "value", nominal=50.0, horizon=172800.0, band=60.0)
    return out.select("step_id", "user_id", "n", *[F.round(c, 6).alias(c) for c in ("dip_percent", "rise_percent", "recovery_seconds")])


BANDS = [{"name": "low", "low": 0.0, "high": 25.0}, {"name": "normal", "low": 25.0, "high": 75.0}, {"name": "elevated", "low": 75.0, "high": 150.0}]


@query(f"""{_E}, z AS (SELECT user_id, CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'normal' WHEN value < 150 THEN 'elevated' ELSE 'beyond' END AS zone, ts,
  date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS micros FROM e)
SELECT user_id, zone, count(*) AS n, sum(micros)::BIGINT AS micros FROM z GROUP BY user_id, zone""")
def time_in_zone(spark, sf_dir):
    """How long each device's last reading lay in each band; a reading holds until the next."""
    config.check_bands(BANDS)
    e = readings(spark, sf_dir)
    zone = F.coalesce(power.band_of(F.col("value"), BANDS), F.lit("beyond"))
    here = F.struct(zone.alias("zone"), F.col("ts").alias("t"))
    out = series.previous(e, KEYS, bucket(e), ORDER, here, "before")
    held = out.where("before is not null").select("user_id", F.col("before.zone").alias("zone"), (micros(F.col("ts")) - micros(F.col("before.t"))).alias("micros"))
    times = held.groupBy("user_id", "zone").agg(F.sum("micros").alias("micros"))
    counts = e.groupBy("user_id", zone.alias("zone")).agg(F.count("*").alias("n"))
    return counts.join(times, ["user_id", "zone"], "left")


@query(f"""{_E}, h AS (SELECT user_id, day, avg(cents) AS y FROM e GROUP BY ALL),
w AS (SELECT user_id, day, y AS c, lag(y) OVER k AS b, lag(y, 2) OVER k AS a, lag(day, 2) OVER k AS d2 FROM h WINDOW k AS (PARTITION BY user_id ORDER BY day)),
r AS (SELECT *, CASE WHEN b <> a THEN (c - b) / (b - a) END AS r FROM w WHERE d2 = day - INTERVAL 2 DAY)
SELECT user_id, day, round(CASE WHEN r > 0 AND r < 0.95 THEN c + (c - b) * r / (1 - r) END, 2) AS asymptote FROM r WHERE r > 0 AND r < 0.95""")
def daily_asymptotes(spark, sf_dir):
    """Where a device's daily mean heads, if its steps over three days in a row shrink by at least a twentieth."""
    from pyspark.sql import Window

    days = readings(spark, sf_dir).groupBy("user_id", "day").agg(F.avg("cents").alias("c"))
    k = Window.partitionBy("user_id").orderBy("day")
    three = days.select("user_id", "day", "c", F.lag("c").over(k).alias("b"), F.lag("c", 2).over(k).alias("a"), F.lag("day", 2).over(k).alias("first"))
    three = three.where(F.col("first") == F.col("day") - F.expr("interval 2 days"))
    steady = (F.col("c") - F.col("b")) / (F.col("b") - F.col("a"))
    out = three.where(F.col("b") != F.col("a")).where((steady > 0) & (steady < 0.95))
    return out.select("user_id", "day", F.round(thermal.asymptote(F.col("a"), F.col("b"), F.col("c")), 2).alias("asymptote"))


@query(f"""{_E}, s AS (SELECT user_id, min(ts) AS a, unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, max(ts), INTERVAL 6 HOUR))::TIMESTAMP AS ts FROM e GROUP BY user_id),
g AS (SELECT user_id, ts FROM s WHERE ts >= a)
SELECT g.user_id, g.ts, e.cents FROM g ASOF JOIN e ON g.user_id = e.user_id AND g.ts >= e.ts""")
def six_hour_grid(spark, sf_dir):
    e = readings(spark, sf_dir)
    return summaries.resample(e, KEYS, "ts", "event_id", "6 hours", "cents", bucket(e))


@query(f"""{_E}, p AS (SELECT user_id, cents, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS s FROM e)
SELECT user_id, round(sum(s), 4) AS seconds, round(sum(cents * s) / sum(s), 4) AS mean FROM p WHERE s IS NOT NULL GROUP BY user_id""")
def time_weighted_mean(spark, sf_dir):
    e = readings(spark, sf_dir)
    out = summaries.time_weighted_mean(e, KEYS, "ts", ORDER, bucket(e), "cents")
    return out.select("user_id", F.round("seconds", 4).alias("seconds"), F.round("mean", 4).alias("mean"))


_COVER = "WITH " + _MERGED.format(name="a", hours=24, kind="view") + ", " + _MERGED.format(name="h", hours=6, kind="error")


@query(_COVER + """, t AS (SELECT user_id, sum(date_diff('microsecond', start, stop)) AS all_us FROM a GROUP BY user_id),
c AS (SELECT a.user_id, sum(date_diff('microsecond', greatest(a.start, h.start), least(a.stop, h.stop))) AS lost_us FROM a JOIN h ON a.user_id = h.user_id AND a.start < h.stop AND h.start < a.stop GROUP BY a.user_id)
SELECT user_id, round(all_us / 1e6, 4) AS seconds, round(1 - coalesce(lost_us, 0) / all_us, 6) AS share FROM t LEFT JOIN c USING (user_id)""")
def coverage_share(spark, sf_dir):
    views, errors = _sessions(spark, sf_dir, "view", 24), _sessions(spark, sf_dir, "error", 6)
    out = summaries.coverage(views, errors, KEYS, cell=bucket(views.union(errors)))
    return out.select("user_id", F.round("seconds", 4).alias("seconds"), F.round("share", 6).alias("share"))


@query("""WITH d AS (SELECT user_id, event_type, count(*) AS n, max(date_trunc('day', ts)) FILTER (ts < TIMESTAMP '2024-01-15') AS o, count(*) FILTER (ts < TIMESTAMP '2024-01-08') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') AS b FROM events GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN a = 0 THEN 'opened' WHEN b = 0 THEN 'closed' ELSE 'updated' END AS change, CASE WHEN b > 0 THEN b END AS n, CASE WHEN a > 0 THEN a END AS old_n FROM d WHERE a <> b""")
def weekly_changes(spark, sf_dir):
    """How the counts by device and signal differ between the first two weeks."""
    e = table(spark, sf_dir, "events")
    week = lambda a, b: e.where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return summaries.snapshot_diff(week("2000-01-01", "2024-01-08"), week("2024-01-08", "2024-01-15"), ["user_id", "event_type"], ["n"])


@query("""WITH p AS (SELECT user_id, ts AS start, ts + INTERVAL 2 HOUR AS stop FROM events WHERE event_type = 'error'),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM p))
SELECT user_id, min(start) AS start, max(stop) AS stop FROM g GROUP BY user_id, g HAVING max(stop) - min(start) >= INTERVAL 6 HOUR""")
def alarm_episodes(spark, sf_dir):
    """An error raises an alarm for two hours; pauses of up to 12 hours join; 6 hours at least."""
    return summaries.alarm_episodes(_sessions(spark, sf_dir, "error", 2), KEYS, "start", "stop", off_delay=43200.0, on_delay=21600.0)


@query(f"""{_E} SELECT event_type, user_id, event_id, cents, row_number() OVER (PARTITION BY event_type ORDER BY cents DESC, event_id) AS rank FROM e QUALIFY rank <= 5""")
def top_readings(spark, sf_dir):
    """A top-k report: the five greatest readings of each signal."""
    out = summaries.top_rows(readings(spark, sf_dir), ["event_type"], [F.desc("cents"), F.asc("event_id")], 5)
    return out.select("event_type", "user_id", "event_id", "cents", "rank")
