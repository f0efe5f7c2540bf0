"""Event, ingestion and star-schema queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators import events as O
from textmill.plans.registry import query, table
from textmill.streaming import events as ST

ROUND = 4


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_slow, round(max(value) FILTER (WHERE i = round_even((n - 1) * 0.5::DOUBLE, 0)), 6) AS p50, round(max(value) FILTER (WHERE i = round_even((n - 1) * 0.95::DOUBLE, 0)), 6) AS p95 FROM r GROUP BY event_type"""
)
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts and nearest-rank percentiles by event type."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_slow"))
    p50 = O.exact_rank(events, "value", 0.5, "event_type").withColumnRenamed("p", "p50")
    p95 = O.exact_rank(events, "value", 0.95, "event_type").withColumnRenamed("p", "p95")
    return counts.join(p50, "event_type").join(p95, "event_type").select("event_type", "n", "n_slow", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS copies FROM events GROUP BY ALL")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, with the number of events it stands for."""
    events = table(spark, sf_dir, "events").select("event_id", F.struct("user_id", "event_type").alias("k"))
    first = O.deduplicated(events.withColumn("id", F.col("event_id")), "k", "event_id")
    copies = events.groupBy("k").agg(F.count("*").alias("copies"))
    return first.join(copies, "k").select("k.user_id", "k.event_type", F.col("id").alias("event_id"), "copies")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f(user_id, r, kept, event_id, admitted) AS (
      SELECT DISTINCT user_id, 0::BIGINT, []::TIMESTAMP[], NULL::BIGINT, NULL::BOOLEAN FROM e
      UNION ALL SELECT user_id, r, CASE WHEN len(live) < 3 THEN list_append(live, ts) ELSE live END, event_id, len(live) < 3 FROM (
        SELECT e.user_id, e.r, e.ts, e.event_id, list_filter(f.kept, lambda t: t > e.ts - INTERVAL 12 HOUR) AS live FROM f JOIN e ON e.user_id IS NOT DISTINCT FROM f.user_id AND e.r = f.r + 1))
    SELECT event_id, user_id, admitted FROM f WHERE r > 0"""
)
def event_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of at most 3 events of a user in 12 hours; rejected events do not count."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return O.admitted(events, "user_id", "ts", 3, 12 * 3600).select("event_id", "user_id", "admitted")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f(user_id, r, kept, event_id, admitted) AS (
      SELECT DISTINCT user_id, 0::BIGINT, []::TIMESTAMP[], NULL::BIGINT, NULL::BOOLEAN FROM e
      UNION ALL SELECT user_id, r, CASE WHEN len(live) < 3 THEN list_append(live, ts) ELSE live END, event_id, len(live) < 3 FROM (
        SELECT e.user_id, e.r, e.ts, e.event_id, list_filter(f.kept, lambda t: t > e.ts - INTERVAL 12 HOUR) AS live FROM f JOIN e ON e.user_id IS NOT DISTINCT FROM f.user_id AND e.r = f.r + 1))
    SELECT event_id, user_id, admitted, false AS late FROM f WHERE r > 0"""
)
def event_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same admission with keyed state, from a stream over the events file, drained once."""
    like = table(spark, sf_dir, "events")
    stream = ST.read_events(spark, f"{sf_dir}/events.parquet*", like).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    rows = ST.admitted_stream(stream, "user_id", "ts", ["event_id"], 3, 12 * 3600)
    return ST.run_once(rows, f"admission_{uuid.uuid4().hex}", mode="append").select("event_id", "user_id", "admitted", "late")


_SESSIONS = f"""SELECT user_id, floor(epoch(min(ts)))::BIGINT AS session_start, count(*) AS n, round(sum(value), {ROUND}) AS total FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s"""


@query(_SESSIONS)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events that lie less than six hours apart, in batch."""
    rows = ST.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "6 hours")
    return rows.select("user_id", F.unix_timestamp("session_start").alias("session_start"), "n", F.round("total", ROUND).alias("total"))


@query(_SESSIONS)
def event_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from a stream over the events file, drained once."""
    like = table(spark, sf_dir, "events")
    stream = ST.read_events(spark, f"{sf_dir}/events.parquet*", like).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ST.run_once(ST.sessions(stream, "user_id", "6 hours", "1 hour"), f"sessions_{uuid.uuid4().hex}")
    return rows.select("user_id", F.unix_timestamp("session_start").alias("session_start"), "n", F.round("total", ROUND).alias("total"))


@query(
    """SELECT event_type, b + 1 AS first_missing, event_id - 1 AS last_missing FROM (SELECT event_type, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) WHERE b + 1 < event_id"""
)
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of event numbers that a type does not have between its first and last."""
    return O.gaps(table(spark, sf_dir, "events"), "event_type", "event_id")


_WINDOWS = "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(_WINDOWS)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling one-hour windows in batch; a window is named by the second it begins at."""
    events = table(spark, sf_dir, "events")
    rows = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), ROUND).alias("total"))
    return rows.select(F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("window_start"), "event_type", "n", "total")


@query(_WINDOWS)
def event_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from a stream over the events file, drained once."""
    like = table(spark, sf_dir, "events")
    stream = ST.read_events(spark, f"{sf_dir}/events.parquet*", like).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ST.run_once(ST.windowed(stream), f"windows_{uuid.uuid4().hex}")
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", ROUND).alias("total"))


@query(
    """SELECT event_id, 'span' AS kind, 1::BIGINT AS index, 'event_type' AS name, event_type AS value FROM events
    UNION ALL SELECT event_id, 'document_level', 1 + row_number() OVER (PARTITION BY event_id ORDER BY k), k, json_extract_string(props, '$.' || k) FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"""
)
def canonical_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's entities (its type), then all keys of its properties in order; places count on from the one to the other."""
    from textmill.operators.ingest import exploded

    events = table(spark, sf_dir, "events").withColumns({"entities": F.array(F.struct(F.lit("event_type").alias("name"), F.col("event_type").alias("value"))), "level": F.from_json("props", "map<string,string>")})
    return exploded(events, "event_id", "entities", "level").select("event_id", "kind", "index", "name", "value")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 5 = 0 THEN 'changed' END AS change FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0
    UNION ALL SELECT p_partkey + 1000000, 'added' FROM part WHERE p_partkey % 11 = 0"""
)
def contract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the parts and a changed version of them.

    Added parts are told from those that had their number before, as there are with more than a million parts.
    """
    part = table(spark, sf_dir, "part").withColumn("is_new", F.lit(False))
    kept = part.where("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    added = part.where("p_partkey % 11 = 0").withColumns({"p_partkey": F.col("p_partkey") + 1000000, "is_new": F.lit(True)})
    return O.table_diff(part, kept.unionByName(added), ["p_partkey", "is_new"]).drop("is_new")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def star_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query(
    """SELECT r_name, n_name, grouping(r_name, n_name)::BIGINT AS level, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""
)
def star_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.grouping_id().alias("level"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem QUALIFY place <= 3")
def star_top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) UNION SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def star_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    none = customers.join(orders, "c_custkey", "left_anti")
    large = customers.join(orders.where("o_totalprice > 400000"), "c_custkey", "left_semi")
    return none.select("c_custkey", "c_mktsegment").union(large.select("c_custkey", "c_mktsegment")).distinct()


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def star_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    few = t("nation").select("n_nationkey").subtract(t("supplier").where("s_acctbal > 5000").select("s_nationkey"))
    return few.unionAll(t("customer").select("c_nationkey").intersect(t("supplier").select("s_nationkey")))
