"""Queries of a general kind: joins, sets, chains, built-in functions, upserts, a stream held against its batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.intervals import micros
from millrace.functions.mapping import mapped
from millrace.operators import running
from millrace.plans import catalogue
from millrace.plans.catalogue import query, readings, table
from millrace.sources import documents, tables


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def customers_without_large_orders(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


@query("""SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON s_nationkey = n_nationkey""")
def suppliers_with_nation(spark, sf_dir):
    """A left join to a dimension that lacks some keys."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    out = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0) AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def urgent_orders_of_segment(spark, sf_dir):
    """Membership in a set of keys and in a list, and filters put together from options."""
    options = {"o_orderdate >= timestamp_ntz '1995-01-01'": True, "o_orderdate < timestamp_ntz '1997-01-01'": True, "o_totalprice > 1e9": False}
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    for condition, wanted in options.items():
        orders = orders.where(condition) if wanted else orders
    members = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return orders.join(members, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderdate) OVER w AS before_date, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
l AS (SELECT o_orderkey, CASE WHEN o_orderdate <= before_date + INTERVAL 90 DAY THEN before END AS continued_from FROM o),
r AS (SELECT o_orderkey, o_orderkey AS root, 0 AS depth FROM l WHERE continued_from IS NULL
      UNION ALL SELECT l.o_orderkey, r.root, r.depth + 1 FROM l JOIN r ON l.continued_from = r.o_orderkey)
SELECT o_orderkey, root, depth::BIGINT AS depth FROM r""")
def order_chains(spark, sf_dir):
    """Orders that follow a customer's last within 90 days continue it; each with its chain's root, as islands instead of a recursion."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    keys, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    bucket = "year" if running.bucket_for(o, keys, "year") else None
    o = running.previous(o.withColumn("year", F.year("o_orderdate")), keys, bucket, order, F.col("o_orderdate"), "before")
    new = F.col("before").isNull() | (F.col("o_orderdate") > F.col("before") + F.expr("interval 90 days"))
    o = running.last_known(o, keys, bucket, order, F.when(new, F.col("o_orderkey")), "root")
    o = running.running_sum(o, [*keys, "root"], bucket, order, F.lit(1), "nth")
    return o.select("o_orderkey", "root", (F.col("nth") - 1).cast("long").alias("depth"))


@query("""WITH RECURSIVE r AS (SELECT p_partkey, 0 AS depth, p_partkey AS root FROM part WHERE p_partkey <= 3
  UNION ALL SELECT p.p_partkey, r.depth + 1, r.root FROM part p JOIN r ON p.p_partkey // 4 = r.p_partkey AND p.p_partkey > 3)
SELECT root, depth, count(*) AS parts FROM r GROUP BY ALL""")
def parts_tree(spark, sf_dir):
    """A recursive query: each part's parent is the part of a fourth of its key; how many are how deep below which root."""
    own = spark.newSession()  # so that the caller's settings stay as they are
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the limit is on rows of all levels; the tree has a row a part
    return own.sql("""WITH RECURSIVE r AS (SELECT p_partkey, 0 AS depth, p_partkey AS root FROM {parts} WHERE p_partkey <= 3
      UNION ALL SELECT p.p_partkey, r.depth + 1, r.root FROM {parts} p JOIN r ON p.p_partkey DIV 4 = r.p_partkey AND p.p_partkey > 3)
    SELECT root, depth, count(*) AS parts FROM r GROUP BY root, depth""", parts=table(own, sf_dir, "part").select("p_partkey"))


@query("""(SELECT user_id FROM events WHERE event_type = 'view' AND value > 90 INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80)
EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 99""")
def users_by_sets(spark, sf_dir):
    """Intersection and difference of sets of devices."""
    e = readings(spark, sf_dir)
    of = lambda kind, least: e.where((F.col("event_type") == kind) & (F.col("value") > least)).select("user_id")
    return of("view", 90).intersect(of("purchase", 80)).subtract(of("error", 99))


@query("""SELECT * FROM (SELECT event_id, user_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 20) ORDER BY ts, event_id""")
def latest_readings(spark, sf_dir):
    """A top-k report: the last twenty readings of all, in order of time."""
    from pyspark.sql import Window

    last = readings(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "ts")
    ranked = last.withColumn("back", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))))  # twenty rows
    return ranked.orderBy("ts", "event_id")


@query(r"""SELECT event_id, json_extract_string(props, '$.k') AS k, sha256(event_type || ':' || user_id) AS digest, (ts - INTERVAL 6 HOUR)::DATE::VARCHAR AS operating_day,
  strftime(ts, '%H:%M:%S') AS clock,
  least(11, greatest(0, floor(value / 10) + 1))::BIGINT AS bucket, (value > 10)::BIGINT + (value > 50)::BIGINT + (value > 90)::BIGINT AS levels, upper(left(event_type, 3)) AS short FROM events""")
def reading_digests(spark, sf_dir):
    """Built-ins on every reading: JSON, hashing, operating days that begin at six, clock text, buckets, arrays, strings."""
    e = table(spark, sf_dir, "events")
    part = lambda f: F.lpad(f("ts").cast("string"), 2, "0")
    bucket = F.least(F.lit(11), F.greatest(F.lit(0), F.floor(F.col("value") / 10) + 1)).cast("long")
    levels = F.size(F.filter(F.array(*[F.col("value") > x for x in (10, 50, 90)]), lambda x: x)).cast("long")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.sha2(F.concat_ws(":", "event_type", F.col("user_id").cast("string")), 256).alias("digest"), F.to_date(F.col("ts") - F.expr("interval 6 hours")).cast("string").alias("operating_day"),
                    F.concat_ws(":", part(F.hour), part(F.minute), part(F.second)).alias("clock"), bucket.alias("bucket"), levels.alias("levels"), F.upper(F.substring("event_type", 1, 3)).alias("short"))


_SIDES = """WITH old AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 4 <> 0),
new AS (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)"""


def _sides(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 4 <> 0").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return old, c.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))


@query(_SIDES + """ SELECT coalesce(old.c_custkey, new.c_custkey) AS c_custkey, coalesce(old.c_name, new.c_name) AS c_name, round(coalesce(old.c_acctbal, new.c_acctbal), 2) AS c_acctbal FROM old FULL JOIN new USING (c_custkey)""")
def upsert_filling_nulls(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return tables.fill_missing(old, new, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("""WITH old AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0), new AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE upper(c_name) END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(old.c_custkey, new.c_custkey) AS c_custkey, coalesce(new.c_name, old.c_name) AS c_name, round(coalesce(new.c_acctbal, old.c_acctbal), 2) AS c_acctbal, c_mktsegment FROM old FULL JOIN new USING (c_custkey)""")
def upsert_open_rows(spark, sf_dir):
    """New values replace old ones where there are any; the old row's other columns stay."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 4 <> 0").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.upper("c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return tables.merge_open(old, new, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("""WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS lines, sum(round(l_extendedprice * 100))::BIGINT AS cents, count(DISTINCT l_partkey) AS parts, min(l_linenumber)::BIGINT AS first_line FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderdate, CASE WHEN o_orderpriority LIKE '1-%' THEN 'alert' WHEN o_orderpriority LIKE '2-%' THEN 'warning' ELSE 'info' END AS severity, coalesce(lines, 0) AS lines, coalesce(cents, 0) AS cents, coalesce(parts, 0) AS parts, first_line FROM orders LEFT JOIN l USING (o_orderkey)""")
def order_documents(spark, sf_dir):
    """Orders as nested JSON with their lines, read back from the text; the priority is mapped, with a default."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    made = documents.documents(o, lines, ["o_orderkey"], "lines", ["l_linenumber"])
    shape = "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, lines array<struct<l_linenumber long, l_partkey long, cents long>>"
    read, _ = documents.read_documents(made, "document", shape)
    line = F.col("fields.lines")
    severity = mapped(F.split("fields.o_orderpriority", "-")[0], {"1": "alert", "2": "warning"}, "info", "info")
    total = F.aggregate(line, F.lit(0).cast("long"), lambda s, x: s + x["cents"])
    return read.select("fields.o_orderkey", "fields.o_orderdate", severity.alias("severity"), F.size(line).cast("long").alias("lines"), total.alias("cents"), F.size(F.array_distinct(line["l_partkey"])).cast("long").alias("parts"), F.try_element_at(line, F.lit(1))["l_linenumber"].alias("first_line"))


@query(_SIDES + """ SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM old UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2) FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.c_custkey = new.c_custkey)""")
def upsert_setting_once(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return tables.insert_missing(old, new, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(_SIDES + """ SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)""")
def delete_by_keys(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return tables.delete_keys(old, new, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("""SELECT event_type, count(*) AS windows, 0::BIGINT AS different FROM (
  SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS start, event_type FROM events WHERE date_trunc('hour', ts)::TIMESTAMP + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM events)) GROUP BY event_type""")
def stream_against_batch(spark, sf_dir):
    """The closed hourly windows of the stream beside those of the batch: by signal how many there are and how many differ."""
    streamed = catalogue.streamed_hourly_windows(spark, sf_dir)
    e = readings(spark, sf_dir)
    end = e.agg(F.max("ts").alias("end"))  # one row
    hours = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    hours = hours.join(F.broadcast(end), micros(F.col("start")) + 70 * 60 * 10**6 <= micros(F.col("end"))).drop("end")
    both = hours.join(streamed.select("start", "event_type", F.col("n").alias("n2"), F.col("cents").alias("cents2")), ["start", "event_type"], "full_outer")
    return both.groupBy("event_type").agg(F.count("*").alias("windows"), F.count_if(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("cents").eqNullSafe(F.col("cents2")))).alias("different"))
