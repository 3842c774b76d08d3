"""Queries on bands, lifecycles and tapes: state along a series, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.intervals import micros
from millrace.operators import anchored, bands, dyadic, episodes, intervals, ranks, status
from millrace.plans.catalogue import _E, _MERGED, KEYS, ORDER, _drain, _sessions, _shared, bucket, query, readings, table
from millrace.sources import arrivals, tape
from millrace.streaming import corrections, flows, lifecycles, replay
from millrace.streaming import status as watch

#: Quarters of the scale; five below a band's lower edge still belong to it; two readings in a row confirm.
TRACKER = bands.BandTracker((25.0, 50.0, 75.0), margin=5.0, n=2)

_FOLD = """WITH RECURSIVE r AS (SELECT user_id, event_id, ts, value, floor(least(greatest(value, 0), 99) / 25)::INT AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
s AS (
  SELECT user_id, event_id, i, ts, z AS band, -1 AS candidate, 0 AS named, NULL::TIMESTAMP AS first, true AS confirmed, ts AS start FROM r WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, ts, CASE WHEN k >= 2 THEN z ELSE band END, CASE WHEN k IN (0, 2) THEN -1 ELSE z END, CASE WHEN k >= 2 THEN 0 ELSE k END, CASE WHEN k = 1 THEN ts END, k >= 2, CASE WHEN k >= 2 THEN first END
  FROM (SELECT r.*, s.band, s.first, CASE WHEN z = s.band OR z < s.band AND value >= s.band * 25 - 5 THEN 0 WHEN z = s.candidate THEN s.named + 1 ELSE 1 END AS k FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1))"""


@query(_FOLD + """ SELECT user_id, event_id, band, named FROM s""")
def tracked_bands(spark, sf_dir):
    """The confirmed band of a device after each reading, and how often in a row another was named."""
    e = readings(spark, sf_dir).where("value is not null")
    return bands.track_bands(e, KEYS, ORDER, "day", "value", TRACKER).select("user_id", "event_id", "band", "named")


@query(_FOLD + """ SELECT user_id, band, start, lead(start) OVER (PARTITION BY user_id ORDER BY i) AS stop FROM s WHERE confirmed""")
def band_segments(spark, sf_dir):
    e = readings(spark, sf_dir).where("value is not null")
    return bands.band_segments(e, KEYS, "ts", ORDER, "day", "value", TRACKER)


#: 60 or more raises an alarm, two readings below it end it, as do five days of silence; two days apart still cover.
RULES = lifecycles.EpisodeRules(level=60.0, clear_after=2, silent=5 * 86400.0, pause=2 * 86400.0)

_PIECES = """WITH w AS (SELECT date_trunc('millisecond', max(ts))::TIMESTAMP - INTERVAL 2 DAY AS w FROM events),
r AS (SELECT user_id, event_type, event_id, ts, value, value >= 60 AS hit, lag(ts) OVER o AS p, row_number() OVER o AS i FROM events, w WHERE value IS NOT NULL AND ts < w WINDOW o AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
e AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 5 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY i) AS era FROM r),
m AS (SELECT *, i - last_value(CASE WHEN hit THEN i END IGNORE NULLS) OVER (PARTITION BY user_id, event_type, era ORDER BY i ROWS UNBOUNDED PRECEDING) AS m, max(ts) OVER (PARTITION BY user_id, event_type, era) AS heard FROM e),
g AS (SELECT *, sum((m IS NOT DISTINCT FROM 2)::INT) OVER (PARTITION BY user_id, event_type, era ORDER BY i ROWS UNBOUNDED PRECEDING) - (m IS NOT DISTINCT FROM 2)::INT AS ep FROM m),
x AS (SELECT user_id, event_type, era, ep, min(ts) FILTER (hit) AS opened, max(ts) FILTER (hit) AS last, max(i) FILTER (hit) AS last_i, max(ts) FILTER (m = 1) AS miss, max(i) FILTER (m = 1) AS miss_i, bool_or(m IS NOT DISTINCT FROM 2) AS cleared, any_value(heard) AS heard FROM g GROUP BY ALL HAVING bool_or(hit)),
y AS (SELECT *, CASE WHEN cleared THEN 'cleared' WHEN heard + INTERVAL 5 DAY < w THEN 'silent' END AS reason, CASE WHEN miss_i > last_i THEN miss ELSE last END AS stop FROM x, w),
z AS (SELECT *, CASE WHEN reason IS NULL THEN last - INTERVAL 1 DAY WHEN stop = date_trunc('day', stop) AND last < stop THEN stop - INTERVAL 1 DAY ELSE stop END AS final FROM y),
d AS (SELECT *, unnest(generate_series(date_trunc('day', opened)::TIMESTAMP, date_trunc('day', final)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM z),
h AS (SELECT user_id, event_type, era, ep, date_trunc('day', ts)::TIMESTAMP AS day, max(value) AS worst, count(*) AS n FROM g WHERE hit GROUP BY ALL),
n AS (SELECT g.user_id, g.event_type, g.era, g.ep, p, ts, unnest(generate_series(date_trunc('day', p)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP, INTERVAL 1 DAY)) AS day
      FROM g JOIN y USING (user_id, event_type, era, ep) WHERE ts - p <= INTERVAL 2 DAY AND ts > opened AND ts <= CASE WHEN reason IS NULL THEN last ELSE stop END),
c AS (SELECT user_id, event_type, era, ep, day, sum(date_diff('microsecond', greatest(p, day), least(ts, day + INTERVAL 1 DAY)))::BIGINT AS us FROM n GROUP BY ALL)
SELECT user_id, event_type, opened, row_number() OVER k::INT AS part, greatest(opened, day) AS start,
       CASE WHEN reason IS NOT NULL AND row_number() OVER b = 1 THEN stop ELSE day + INTERVAL 1 DAY END AS stop, CASE WHEN reason IS NOT NULL AND row_number() OVER b = 1 THEN reason ELSE 'day' END AS reason,
       worst, coalesce(n, 0)::BIGINT AS n, coalesce(us, 0) / 1e6::DOUBLE AS covered
FROM d LEFT JOIN h USING (user_id, event_type, era, ep, day) LEFT JOIN c USING (user_id, event_type, era, ep, day)
WINDOW k AS (PARTITION BY user_id, event_type, era, ep ORDER BY day), b AS (PARTITION BY user_id, event_type, era, ep ORDER BY day DESC)"""


@query(_PIECES)
def episode_pieces(spark, sf_dir):
    """Alarm episodes of each signal of a device, cut at midnights, as of two days before the last reading."""
    e = readings(spark, sf_dir)
    until = e.agg((F.date_trunc("millisecond", F.max("ts")).cast("timestamp_ntz") - F.expr("interval 2 days")).alias("until"))
    rows = e.join(F.broadcast(until))  # one row
    rules = (RULES.level, RULES.clear_after, RULES.silent, RULES.pause)
    return episodes.episode_pieces(rows, ["user_id", "event_type"], "ts", ORDER, "value", *rules, F.col("until"))


@query(_PIECES)
def streamed_episode_pieces(spark, sf_dir):
    """The same from the stream, whatever the order of its files within two days."""
    home = _shared(spark, "episodes")
    pieces = lifecycles.episode_pieces(flows.read_readings(spark, f"{sf_dir}/events.parquet*", None), RULES, "2 days")
    with lifecycles.rocksdb_state(spark):
        _drain(pieces.writeStream.outputMode("append").format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/log"))
    rows = spark.read.schema(lifecycles.PIECES).parquet(f"{home}/rows")
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("opened", "start", "stop") else F.col(c) for c in rows.columns])


@query("""WITH a AS (SELECT event_id, user_id, date_trunc('hour', ts)::TIMESTAMP + to_hours((user_id % 3)::INT) AS received_at FROM events)
SELECT event_id, user_id, received_at FROM a WHERE received_at <= TIMESTAMP '2024-01-25 06:00:00'""")
def replicated_readings(spark, sf_dir):
    """events arrive in three deliveries, the hour of their time plus up to two; each is replicated as far as it has settled.

    Many rows share an arrival time, also the one at which a run stops. The
    second and third run go on from the log of the one before.
    """
    home = _shared(spark, "replica")
    at = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("user_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("received_at"))
    ends = ["2024-01-10 00:00:00", "2024-01-20 12:00:00", "2024-02-10 00:00:00"]
    low = F.lit("1970-01-01").cast("timestamp_ntz")
    for end, clock in zip(ends, ["2024-01-09T00:10:00", "2024-01-20T12:10:00", "2024-01-25T06:10:00"]):
        high = F.lit(end).cast("timestamp_ntz")
        rows.where((F.col("received_at") >= low) & (F.col("received_at") < high)).write.mode("append").parquet(f"{home}/in")
        low = high
        stream = arrivals.read_arrivals(spark, f"{home}/in", "event_id long, user_id long, received_at timestamp_ntz", "received_at", "event_id", clock=clock, settle=600)
        arrivals.replicate(stream, f"{home}/rows", f"{home}/log")
    return spark.read.parquet(f"{home}/rows")


@query("""WITH e AS (SELECT user_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1),
s AS (SELECT user_id, ts, coalesce(last_value(CASE WHEN value >= 80 THEN true WHEN value <= 20 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), false) AS "on" FROM e),
b AS (SELECT *, ("on" IS DISTINCT FROM lag("on") OVER (PARTITION BY user_id ORDER BY ts))::INT AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM b),
g AS (SELECT user_id, min(ts) AS start, max(ts) AS last_seen, any_value("on") AS "on", count(*) AS n FROM r GROUP BY user_id, run)
SELECT *, lag(start) OVER w AS prev_start, lead(start) OVER w AS next_start FROM g WINDOW w AS (PARTITION BY user_id ORDER BY start)""")
def corrected_tape(spark, sf_dir):
    """events arrive up to 36 hours late, in two deliveries; each corrects the segments that it touches, and a tape takes the corrections."""
    home = _shared(spark, "tape")
    book = tape.SegmentTape(spark, f"{home}/rows", "user_id long", "last_seen timestamp_ntz, on boolean, n long", cell="month", buckets=8)
    at = F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 37).cast("int"))
    table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", at.alias("received_at")).write.parquet(f"{home}/in")

    def take(batch, number):
        batch.persist()
        book.apply(batch)
        batch.unpersist()

    for clock in ("2024-01-16T00:00:00", "2030-01-01T00:00:00"):
        stream = arrivals.read_arrivals(spark, f"{home}/in", "event_id long, ts timestamp_ntz, user_id long, value double, received_at timestamp_ntz", "received_at", "event_id", clock=clock)
        changes = corrections.corrected_segments(stream.withColumn("ts", F.col("ts").cast("timestamp")), 20.0, 80.0, "2 days")
        with lifecycles.rocksdb_state(spark, idle_batches=False):
            _drain(changes.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{home}/log"))
    return book.read()


@query("""WITH a AS (SELECT user_id, event_id, ts AS start, CASE event_id % 5 WHEN 0 THEN TIMESTAMP '9999-01-01' WHEN 1 THEN ts + INTERVAL 3653 DAY ELSE ts + INTERVAL 2 HOUR END AS stop FROM events WHERE event_type = 'error'),
b AS (SELECT user_id, event_id, ts AS start, ts + INTERVAL 1 DAY AS stop FROM events WHERE event_type = 'view')
SELECT a.user_id, a.event_id AS error_id, b.event_id AS view_id, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM a JOIN b ON a.user_id = b.user_id AND a.start < b.stop AND b.start < a.stop""")
def open_ended_overlaps(spark, sf_dir):
    """Errors that last two hours, ten years or for good, with the views of a day that they overlap."""
    e = readings(spark, sf_dir)
    day = F.expr("interval 1 day")
    stop = F.when(F.col("event_id") % 5 == 0, F.lit("9999-01-01").cast("timestamp_ntz")).when(F.col("event_id") % 5 == 1, F.col("ts") + day * 3653).otherwise(F.col("ts") + F.expr("interval 2 hours"))
    errors = e.where("event_type = 'error'").select("user_id", "event_id", F.col("ts").alias("start"), stop.alias("stop"))
    views = e.where("event_type = 'view'").select("user_id", "event_id", F.col("ts").alias("start"), (F.col("ts") + day).alias("stop"))
    out = dyadic.overlap_join(errors, views, KEYS)
    return out.select("user_id", F.col("a.event_id").alias("error_id"), F.col("b.event_id").alias("view_id"), "start", "stop")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS part, p_partkey - 1 - p_partkey % 7 AS before, round(p_retailprice * 100)::BIGINT AS cents FROM part),
c AS (SELECT part, part AS origin, 0::BIGINT AS hops, cents AS total FROM p WHERE before NOT IN (SELECT part FROM p)
  UNION ALL SELECT p.part, c.origin, c.hops + 1, c.total + p.cents FROM c JOIN p ON p.before = c.part)
SELECT part, origin, hops, total FROM c""")
def chain_totals(spark, sf_dir):
    """Parts that each follow one up to seven numbers below: their chains' origins, lengths and sums."""
    p = table(spark, sf_dir, "part")
    links = p.select(F.col("p_partkey").alias("part"), (F.col("p_partkey") - 1 - F.col("p_partkey") % 7).alias("before"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    return dyadic.chain_sums(spark, links, "part", "before", "cents").withColumnRenamed("node", "part")


@query(_E + ", " + _MERGED.format(name="g", hours=12, kind="error") + """, p AS (SELECT * FROM e WHERE event_type = 'view'), s AS (SELECT user_id, ts, ts - INTERVAL 30 MINUTE AS early, event_id, cents FROM e WHERE event_type = 'purchase'),
m AS (SELECT p.event_id, p.user_id, p.ts, s.ts AS t, s.cents FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.early <= p.ts QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY s.early DESC NULLS LAST, s.event_id DESC) = 1),
f AS (SELECT m.*, g.stop FROM m LEFT JOIN g ON g.user_id = m.user_id AND g.start <= m.ts QUALIFY row_number() OVER (PARTITION BY m.event_id ORDER BY g.start DESC NULLS LAST) = 1),
u AS (SELECT *, coalesce(stop > ts, false) AS in_gap, coalesce(date_diff('microsecond', t, ts) <= 259200000000 AND NOT coalesce(stop > t, false) AND NOT coalesce(stop > ts, false), false) AS ok FROM f)
SELECT event_id, user_id, CASE WHEN ok THEN cents END AS filled, ok AND abs(date_diff('microsecond', t, ts)) > 1800000000 AS carried, in_gap FROM u""")
def anchored_fill(spark, sf_dir):
    """Views are packets, purchases samples of a value, and an error opens a gap of twelve hours."""
    e = readings(spark, sf_dir)
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    out = anchored.anchored_fill(views, e.where("event_type = 'purchase'"), _sessions(spark, sf_dir, "error", 12), KEYS, "ts", "event_id", "cents", 1800.0, 3 * 86400.0)
    return out.select("event_id", "user_id", "filled", "carried", "in_gap")


@query("""WITH l AS (SELECT l_returnflag, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem),
m AS (SELECT l_returnflag, count(cents) AS n, median(cents)::DOUBLE AS median FROM l GROUP BY l_returnflag)
SELECT l_returnflag, any_value(n) AS n, any_value(m.median) AS median, median(abs(cents - m.median))::DOUBLE AS mad FROM l JOIN m USING (l_returnflag) GROUP BY l_returnflag""")
def price_spread(spark, sf_dir):
    """Median and median absolute deviation where three groups have all rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return ranks.exact_spread(spark, rows, ["l_returnflag"], "cents")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate AS start, o_orderdate + to_hours((o_orderkey % 90 + 1)::INT) AS stop, zone FROM orders, (VALUES ('Europe/Berlin'), ('America/New_York')) z(zone)),
d AS (SELECT *, unnest(generate_series(date_trunc('day', start AT TIME ZONE 'UTC' AT TIME ZONE zone - INTERVAL 6 HOUR)::TIMESTAMP, date_trunc('day', (stop - INTERVAL 1 MICROSECOND) AT TIME ZONE 'UTC' AT TIME ZONE zone - INTERVAL 6 HOUR)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM o),
b AS (SELECT *, (day + INTERVAL 6 HOUR) AT TIME ZONE zone AT TIME ZONE 'UTC' AS low, (day + INTERVAL 30 HOUR) AT TIME ZONE zone AT TIME ZONE 'UTC' AS high FROM d)
SELECT zone, day, (date_diff('second', low, high) // 3600)::INT AS hours, count(*) AS pieces, sum(date_diff('second', greatest(start, low), least(stop, high)))::BIGINT AS seconds FROM b GROUP BY ALL""")
def operating_days(spark, sf_dir):
    """Open orders by operating day, from six o'clock in two zones; days of 23 and 25 hours are among them."""
    o = table(spark, sf_dir, "orders")
    stop = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 90 + 1).cast("int"))
    both = o.select(F.col("o_orderdate").alias("start"), stop.alias("stop"), F.explode(F.array(F.lit("Europe/Berlin"), F.lit("America/New_York"))).alias("zone"))
    cut = intervals.cut_at_operating_days(both, F.col("zone"), 6)
    seconds = ((micros(F.col("stop")) - micros(F.col("start"))) / 10**6).cast("long")
    return cut.groupBy("zone", F.col("day").cast("timestamp_ntz").alias("day"), "hours").agg(F.count("*").alias("pieces"), F.sum(seconds).alias("seconds"))


@query("""WITH a AS (SELECT user_id, ts AS start, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 5 DAY END AS stop FROM events WHERE event_type = 'error')
SELECT user_id, greatest(start, TIMESTAMP '2024-01-10') AS start, least(coalesce(stop, TIMESTAMP '2024-01-20'), TIMESTAMP '2024-01-20') AS stop FROM a
WHERE greatest(start, TIMESTAMP '2024-01-10') < least(coalesce(stop, TIMESTAMP '2024-01-20'), TIMESTAMP '2024-01-20')""")
def clipped_intervals(spark, sf_dir):
    """Errors of five days, or without an end, clipped to ten days of January."""
    e = readings(spark, sf_dir).where("event_type = 'error'")
    spans = e.select("user_id", F.col("ts").alias("start"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("interval 5 days")).alias("stop"))
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    return intervals.clip(spans, at("2024-01-10"), at("2024-01-20"))


#: 60 or more is high; a status stands for twelve hours before it is told; three days of silence are stale.
STATUS = watch.StatusRules(level=60.0, hold=12 * 3600.0, stale_after=3 * 86400.0)

_TOLD = """WITH u AS (SELECT date_trunc('millisecond', max(ts))::TIMESTAMP - INTERVAL 2 DAY AS u FROM events),
r AS (SELECT user_id, event_id, ts, CASE WHEN value >= 60 AND NOT isnan(value) THEN 'high' WHEN value < 60 THEN 'normal' END AS named, lag(ts) OVER o AS p, lead(ts) OVER o AS n FROM events, u WHERE ts < u WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 3 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM r),
s AS (SELECT *, lag(named) OVER (PARTITION BY user_id, era ORDER BY ts, event_id) AS before FROM e WHERE named IS NOT NULL),
v AS (SELECT user_id, event_id, ts AS t, 1 AS kind, named AS status FROM s WHERE before IS DISTINCT FROM named UNION ALL SELECT user_id, event_id, ts + INTERVAL 3 DAY, 0, 'stale' FROM e WHERE n IS NULL OR n - ts >= INTERVAL 3 DAY),
w AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, kind, event_id) AS next, CASE kind WHEN 0 THEN t ELSE t + INTERVAL 12 HOUR END AS due FROM v),
k AS (SELECT w.*, lag(status) OVER (PARTITION BY user_id ORDER BY t, kind, event_id) AS told FROM w, u WHERE due < u AND (kind = 0 OR next >= due)),
c AS (SELECT user_id, due, status FROM k WHERE told IS DISTINCT FROM status)"""
_CHANGES = _TOLD + """ SELECT user_id, due AS "at", status FROM c"""


@query(_CHANGES)
def status_changes(spark, sf_dir):
    """What is told of each device: high or normal once it has stood, stale after silence."""
    e = readings(spark, sf_dir)
    until = e.agg(F.date_trunc("millisecond", F.max("ts")).cast("timestamp_ntz") - F.expr("interval 2 days")).scalar()  # where the stream's clock stands still
    return status.status_changes(e, KEYS, "ts", ORDER, "value", STATUS.level, STATUS.hold, STATUS.stale_after, until, bucket(e))


@query(_CHANGES)
def streamed_status(spark, sf_dir):
    """The same from the stream, with the watermark as clock."""
    home = _shared(spark, "status")
    changes = watch.device_status(flows.read_readings(spark, f"{sf_dir}/events.parquet*", None), STATUS, "2 days")
    with lifecycles.rocksdb_state(spark):
        _drain(changes.writeStream.outputMode("append").format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/log"))
    rows = spark.read.schema("user_id long, at timestamp, status string").parquet(f"{home}/rows")
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(_TOLD + """ SELECT field, (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS n, 0::BIGINT AS off, 0::DOUBLE AS worst FROM (VALUES ('rows'), ('at_us')) f(field)""")
def replayed_status(spark, sf_dir):
    """The stream over late deliveries with a restart, field by field against the whole table: nothing is off."""
    home = _shared(spark, "replay")
    readings(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value", F.lit(None).cast("string").alias("props")).write.parquet(f"{home}/all")

    def run(folder):
        # all files of a run are one batch: those of a delivery are in no order, so with more batches the watermark would pass rows before they are read
        changes = watch.device_status(flows.read_readings(spark, folder, None), STATUS, "2 days")
        with lifecycles.rocksdb_state(spark, idle_batches=True):
            _drain(changes.writeStream.outputMode("append").format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/log"))

    replay.replay(spark.read.schema(flows.READINGS).parquet(f"{home}/all"), "ts", "event_id", 36 * 3600, 4, f"{home}/in", run)
    got = spark.read.schema("user_id long, at timestamp, status string").parquet(f"{home}/rows").withColumn("at", F.col("at").cast("timestamp_ntz"))
    tell = lambda df: df.select("user_id", "at", "status", micros(F.col("at")).alias("at_us"))
    return replay.parity(tell(status_changes(spark, sf_dir)), tell(got), ["user_id", "at", "status"], 1e-9)
