"""Queries over control documents, feature levels, members and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import accounting as C
from ..operators import levels as N
from ..operators import liveness as V
from ..operators import ownership as O
from ..sources import documents as J
from . import adapters as A
from .adapters import HISTORY, LEASES, REQUESTS

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LEVELS = [(1, "A", True), (2, None, False), (4, "B", True), (5, None, False), (6, None, False)]
LEVELS_SQL = "levels(level, magic, persistent) AS (VALUES (1, 'A', true), (2, NULL, false), (4, 'B', true), (5, NULL, false), (6, NULL, false))"


def _levels(spark):
    return spark.createDataFrame(LEVELS, "level int, magic string, persistent boolean")


@query(f"WITH {LEVELS_SQL} SELECT p_partkey, p_size % 8 AS level, (SELECT arg_max(magic, level) FROM levels WHERE magic IS NOT NULL AND level <= p_size % 8) AS magic FROM part")
def level_magic(spark: SparkSession, d: str) -> DataFrame:
    asked = A.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 8).alias("level"))
    found = N.magic_of(_levels(spark), asked.select("level").distinct())
    return asked.join(found, "level").select("p_partkey", "level", "magic")


@query("SELECT p_partkey, CASE WHEN p_size % 8 NOT BETWEEN 1 AND 4 THEN 'outside' WHEN p_partkey % 7 > 4 THEN 'rising' END AS fault FROM part")
def level_window(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 8).alias("active"), (F.col("p_partkey") % 7).alias("target"))
    return N.in_window(c, 1, 4).select("p_partkey", "fault")


@query(
    f"""WITH {LEVELS_SQL}, s AS (SELECT p_partkey AS id, p_size % 8 AS active, (p_partkey % 7)::INT AS t FROM part)
    SELECT id, 'not_below' AS fault FROM s WHERE t <= 0 OR t >= active
    UNION SELECT id, CASE WHEN persistent IS NULL THEN 'unknown' ELSE 'persistent' END FROM (SELECT id, unnest(range(t + 1, active + 1)) AS level FROM s WHERE t > 0 AND t < active) x LEFT JOIN levels USING (level) WHERE persistent IS NULL OR persistent"""
)
def level_lowering(spark: SparkSession, d: str) -> DataFrame:
    steps = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 8).alias("active"), (F.col("p_partkey") % 7).cast("int").alias("to"))
    return N.lowering_faults(steps, _levels(spark))


@query(f"WITH {REQUESTS} SELECT i, CASE WHEN component LIKE 'ctl_%' THEN 'lease' WHEN component = 'log_segment' THEN 'segment' ELSE 'other' END AS kind FROM requests")
def request_kind(spark: SparkSession, d: str) -> DataFrame:
    """By the request's address: of a key, or of a listing, percent-encoded in its query."""
    t = A.requests(spark, d)
    key = F.concat(F.lit("/bk/p/"), "path")
    listed = F.concat(F.lit("/bk?list-type=2&prefix=p%2F"), F.url_encode("path"))
    return t.select("i", S.request_kind(F.when(F.col("op") == "list", listed).otherwise(key), "bk", "p").alias("kind"))


@query(f"WITH {REQUESTS} SELECT i, CASE WHEN op = 'put' AND kind = 'create' THEN 'put_create' WHEN op = 'put' AND kind = 'replace' THEN 'put_cas' ELSE op END AS label, component LIKE 'ctl_%' OR (op = 'put' AND component = 'log_segment') AS reserved FROM requests")
def op_labels(spark: SparkSession, d: str) -> DataFrame:
    t = A.requests(spark, d)
    mode = F.when(F.col("kind") == "replace", "update").otherwise(F.col("kind"))
    return t.select("i", S.op_label(F.col("op"), mode).alias("label"), S.reserved_lane(F.col("op") == "put", F.col("component")).alias("reserved"))


@query("SELECT o_orderkey AS key, o_orderkey % 5 AS etag FROM orders WHERE o_orderkey % 5 <> o_custkey % 5")
def write_conflicts(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    stored = o.select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 5).alias("etag"))
    return J.conditional_write(stored, o.select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 5).alias("etag")))


@query("SELECT event_id FROM events WHERE event_type >= 'click' AND event_type < 'purchase'")
def key_range_scan(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select("event_id", F.col("event_type").cast("binary").alias("key"))
    return J.scan_keys(e, b"click", b"purchase").select("event_id")


@query("SELECT p_name AS path FROM (SELECT DISTINCT p_name FROM part) WHERE p_name > (SELECT min(p_name) FROM part) ORDER BY p_name LIMIT 30")
def next_listing_pages(spark: SparkSession, d: str) -> DataFrame:
    names = A.table(spark, d, "part").select(F.col("p_name").alias("path")).distinct()
    return J.next_pages(names, names.agg(F.min("path")).first()[0], 3, 10)


def _members(spark, d):
    obs = A.observations(spark, d)
    now = obs.agg(F.max("observed_us")).first()[0]
    m = V.classify_leases(V.last_change(obs), now, 900_000, 100_000)
    return m.withColumn("draining", F.col("node_id") == "n1")


MEMBERS = LEASES + ", now AS (SELECT max(observed_us) AS t FROM obs), members AS (SELECT node_id, incarnation, node_id = 'n1' AS draining, CASE WHEN ended OR t - changed_at > 1000000 THEN 'dead' WHEN (t - changed_at) * 2 > 900000 THEN 'suspect' ELSE 'live' END AS liveness FROM leases, now)"


@query(f"WITH {MEMBERS} SELECT node_id FROM members WHERE liveness <> 'dead'")
def members_up(spark: SparkSession, d: str) -> DataFrame:
    return V.up(_members(spark, d)).select("node_id")


@query(f"WITH {MEMBERS} SELECT node_id FROM members WHERE liveness = 'live' AND NOT draining")
def members_settled(spark: SparkSession, d: str) -> DataFrame:
    return V.settled(_members(spark, d)).select("node_id")


@query(f"WITH {MEMBERS} SELECT node_id FROM members WHERE liveness = 'dead'")
def members_dead(spark: SparkSession, d: str) -> DataFrame:
    return V.by_liveness(_members(spark, d), "dead").select("node_id")


@query(f"WITH {MEMBERS} SELECT node_id, CASE WHEN m.node_id IS NULL THEN NULL WHEN m.incarnation = q.incarnation THEN liveness ELSE 'dead' END AS liveness FROM (SELECT 'n' || i AS node_id, 'i' || (i * 5) AS incarnation FROM range(8) r(i)) q LEFT JOIN members m USING (node_id)")
def incarnation_liveness(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(8).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.concat(F.lit("i"), (F.col("id") * 5).cast("string")).alias("incarnation"))
    return V.incarnation_liveness(asked, _members(spark, d)).select("node_id", "liveness")


@query(f"WITH {LEASES}, {HISTORY}, now AS (SELECT max(heard_us) AS t FROM beats) SELECT peer AS node_id, incarnation FROM latest, now WHERE viewer = 'n2' AND (t - heard_us < 200 OR peer = 'n2')")
def heard_members(spark: SparkSession, d: str) -> DataFrame:
    b = A.beats(spark, d)
    now = b.agg(F.max("heard_us")).first()[0]
    members = spark.range(5).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"))
    return V.heard_members(members, V.latest_beats(b), "n2", now, 200)


@query(f"WITH {MEMBERS}, {HISTORY} SELECT node_id FROM members m WHERE liveness = 'dead' AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.node_id = m.node_id AND h.incarnation = m.incarnation)")
def dead_owners(spark: SparkSession, d: str) -> DataFrame:
    return V.dead_without_ranges(_members(spark, d), A.heads(spark, d)).select("node_id")


@query("SELECT o_orderkey, 500000 < o_custkey * 100 + 900000 - 100000 AS valid, 5000000 > o_custkey * 100 + 900000 - 100000 + 200000 AS lapsed FROM orders")
def lease_valid(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 100).alias("sent_us"))
    now = V.lease_valid(o, 500_000, 900_000, 100_000).select("o_orderkey", "valid")
    return now.join(V.lease_valid(o, 5_000_000, 900_000, 100_000).select("o_orderkey", "lapsed"), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderstatus <> 'F' THEN 'crash' ELSE o_orderpriority || ':' || o_custkey % 9 END AS exit FROM orders")
def exit_kinds(spark: SparkSession, d: str) -> DataFrame:
    clean = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus") == "F")
    return A.table(spark, d, "orders").select("o_orderkey", C.exit_kind(clean, F.col("o_orderpriority"), F.col("o_custkey") % 9).alias("exit"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND greatest(0, 1000000 - o_custkey * 700) < 120000")
def running_backfills(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "running").otherwise("done").alias("phase"), (F.col("o_custkey") * 700).alias("heartbeat_at"))
    return C.running(o, 1_000_000).select("o_orderkey")


@query("SELECT coalesce(bool_or(o_orderstatus = 'O'), false) AS inexact FROM orders")
def crash_flag(spark: SparkSession, d: str) -> DataFrame:
    return C.crash_flag(A.table(spark, d, "orders").select((F.col("o_orderstatus") == "O").alias("open")))


@query("SELECT listing, page, gap FROM (SELECT o_custkey % 20 AS listing, o_orderkey AS page, lead(o_orderkey * 3) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - o_orderkey * 3 AS gap FROM orders) WHERE gap IS NOT NULL")
def listing_gaps(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    return C.page_gaps(o.select((F.col("o_custkey") % 20).alias("listing"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") * 3).alias("s")))


@query("SELECT o_orderkey, o_custkey % 3 = 0 AS split FROM orders")
def reshard_kind(spark: SparkSession, d: str) -> DataFrame:
    parents = F.when(F.col("o_custkey") % 3 == 0, F.array("o_custkey")).otherwise(F.array("o_custkey", "o_orderkey"))
    return A.table(spark, d, "orders").select("o_orderkey", O.is_split(parents).alias("split"))


@query("SELECT event_id, 'log/' || (user_id % 4) || '/' || lpad((event_id)::VARCHAR, 12, '0') || '.seg' AS segment, 'retain/l' || (user_id % 4) AS report, 'nodes/l' || (user_id % 4) AS lease, 'assign/' || lpad(user_id::VARCHAR, 10, '0') AS assignment, left(coalesce(props, ''), 120) AS agent FROM events")
def object_paths(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    log, name = F.col("user_id") % 4, F.concat(F.lit("l"), (F.col("user_id") % 4).cast("string"))
    path = F.regexp_replace(S.segment_path("x", log, F.col("event_id")), "^x/", "")
    return e.select("event_id", path.alias("segment"), S.report_path(name).alias("report"), S.lease_path(name).alias("lease"), S.assignment_path(F.col("user_id")).alias("assignment"), S.user_agent(F.col("props")).alias("agent"))
