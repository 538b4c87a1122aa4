"""Queries over ownership, liveness, storage accounting, metric series and heap profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import accounting as C
from ..operators import heap as H
from ..operators import liveness as V
from ..operators import ownership as O
from . import adapters as A
from .adapters import HISTORY, LEASES, LOG, REQUESTS

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- ownership ---

AUTHORITY = """FROM writes w LEFT JOIN history h ON h.shard = w.shard AND w.pos >= h."from" AND (h.until IS NULL OR w.pos <= h.until)"""


@query(f"WITH {HISTORY} SELECT l_orderkey, l_linenumber, coalesce(h.epoch = w.epoch AND h.incarnation = w.incarnation, false) AS accepted {AUTHORITY}")
def accepts(spark: SparkSession, d: str) -> DataFrame:
    return O.accepts(A.writes(spark, d), A.history(spark, d)).select("l_orderkey", "l_linenumber", "accepted")


@query(f"WITH {HISTORY} SELECT l_orderkey, l_linenumber, h.epoch AS span_epoch, h.incarnation AS span_incarnation {AUTHORITY}")
def authority_at(spark: SparkSession, d: str) -> DataFrame:
    return O.authority_at(A.writes(spark, d), A.history(spark, d)).select("l_orderkey", "l_linenumber", "span_epoch", "span_incarnation")


@query(
    f"""WITH {HISTORY}, bad AS (SELECT shard, i, epoch, incarnation, "from" + CASE WHEN i % 50 = 7 THEN 1 ELSE 0 END AS f, until FROM history),
    n AS (SELECT b.*, lead(f) OVER (PARTITION BY b.shard ORDER BY i) AS nf, hd.floor, hd.epoch AS head FROM bad b JOIN heads hd USING (shard))
    SELECT shard, i, 'contiguous' AS rule FROM n WHERE until + 1 <> nf UNION ALL SELECT shard, i, 'open_start' FROM n WHERE until IS NULL AND f <> floor + 1"""
)
def history_check(spark: SparkSession, d: str) -> DataFrame:
    h = A.history(spark, d).withColumn("from", F.col("from") + F.when(F.col("i") % 50 == 7, 1).otherwise(0))
    return O.history_faults(h, A.heads(spark, d).withColumnRenamed("incarnation", "owner"))


@query(f"WITH {HISTORY} SELECT shard, node_id, incarnation FROM heads JOIN (SELECT 'n' || (s_suppkey % 5) AS node_id, 'i' || (s_suppkey % 3) AS incarnation FROM supplier WHERE s_suppkey < 8) m USING (node_id, incarnation)")
def owned_by(spark: SparkSession, d: str) -> DataFrame:
    m = A.table(spark, d, "supplier").filter("s_suppkey < 8").select(F.concat(F.lit("n"), (F.col("s_suppkey") % 5).cast("string")).alias("node_id"), F.concat(F.lit("i"), (F.col("s_suppkey") % 3).cast("string")).alias("incarnation"))
    return O.owned_by(A.heads(spark, d).select("shard", "node_id", "incarnation"), m).select("shard", "node_id", "incarnation")


@query(f'WITH {HISTORY} SELECT shard, i, "from", until FROM history WHERE until IS NULL OR until >= 5000')
def trim(spark: SparkSession, d: str) -> DataFrame:
    return O.trim(A.history(spark, d), 5000).select("shard", "i", "from", "until")


@query(f'WITH {HISTORY} SELECT shard, epoch, node_id, "from" FROM history WHERE until IS NULL')
def open_span(spark: SparkSession, d: str) -> DataFrame:
    h = A.history(spark, d).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("i", "epoch", "node_id", "from", "until"))).alias("history"))
    s = O.open_span(F.col("history"))
    return h.select("shard", s["epoch"].alias("epoch"), s["node_id"].alias("node_id"), s["from"].alias("from"))


@query(
    f"""WITH {HISTORY}, o AS (SELECT range, max(version) AS version, arg_max(node_id, version) AS node_id FROM (SELECT o_custkey % 80 AS range, o_orderkey % 2000 AS version, 'm' || min(o_orderkey) AS node_id FROM orders GROUP BY 1, 2) GROUP BY range),
    m AS (SELECT shard AS range, version, node_id FROM heads)
    SELECT coalesce(m.range, o.range) AS range, CASE WHEN m.range IS NULL OR o.version > m.version THEN o.version ELSE m.version END AS version, CASE WHEN m.range IS NULL OR o.version > m.version THEN o.node_id ELSE m.node_id END AS node_id FROM m FULL JOIN o ON m.range = o.range"""
)
def topology_merge(spark: SparkSession, d: str) -> DataFrame:
    mine = O.to_topology(A.heads(spark, d)).select("range", "version", "node_id")
    o = A.table(spark, d, "orders").groupBy((F.col("o_custkey") % 80).alias("range"), (F.col("o_orderkey") % 2000).alias("version")).agg(F.concat(F.lit("m"), F.min("o_orderkey").cast("string")).alias("node_id"))
    other = o.groupBy("range").agg(F.max("version").alias("version"), F.max_by("node_id", "version").alias("node_id"))
    return O.merge_topologies(mine, other)


@query(
    f"""WITH {HISTORY}, r AS (SELECT shard AS range, node_id, 'owner' AS role, 0 AS ord FROM heads UNION ALL SELECT shard, 'n' || ((substr(node_id, 2)::INT + k) % 5), 'replica', k FROM heads, (VALUES (1), (2)) t(k)),
    ok AS (SELECT *, (range * 37 + substr(node_id, 2)::INT * 11) % 100 AS position FROM r WHERE node_id <> 'n3')
    SELECT range, node_id, role, row_number() OVER (PARTITION BY range ORDER BY CASE role WHEN 'owner' THEN 0 ELSE 1 END, ord, node_id) AS rank FROM ok WHERE position >= 40"""
)
def readable(spark: SparkSession, d: str) -> DataFrame:
    h = A.heads(spark, d).select(F.col("shard").alias("range"), "node_id")
    number = F.substring("node_id", 2, 9).cast("int")
    reps = h.select("range", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), number.alias("k")).select("range", F.concat(F.lit("n"), ((F.col("k") + F.col("ord")) % 5).cast("string")).alias("node_id"), F.lit("replica").alias("role"), "ord")
    ranges = h.select("range", "node_id", F.lit("owner").alias("role"), F.lit(0).alias("ord")).unionByName(reps).withColumn("incarnation", F.lit("i0"))
    alive = spark.range(5).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.lit("i0").alias("incarnation"), F.when(F.col("id") == 3, "dead").otherwise("live").alias("liveness"))
    at = ranges.select("range", "node_id", "incarnation").distinct().withColumn("position", (F.col("range") * 37 + number * 11) % 100)
    return O.readable(ranges, alive, at, 40).select("range", "node_id", "role", "rank")


@query(
    """WITH r AS (SELECT o_orderkey, 'n' || (o_custkey % 4) AS owner, list_distinct(list_sort(['n' || (o_orderkey % 4), 'n' || (o_custkey % 3), 'n' || (o_orderkey % 5)])) AS l FROM orders)
    SELECT o_orderkey, array_to_string(list_sort(list_filter(l, lambda x: x <> owner)), ',') AS replicas FROM r"""
)
def replica_list(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c, k: F.struct(F.concat(F.lit("n"), (F.col(c) % k).cast("string")).alias("node_id"))
    o = A.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("n"), (F.col("o_custkey") % 4).cast("string")).alias("owner"), F.array(n("o_orderkey", 4), n("o_custkey", 3), n("o_orderkey", 5)).alias("l"))
    return o.select("o_orderkey", F.array_join(F.transform(O.normal_replicas(F.col("l"), F.col("owner")), lambda r: r["node_id"]), ",").alias("replicas"))


@query(
    """WITH ops AS (SELECT o_custkey % 64 AS shard, 'n' || (o_orderkey % 5) AS node_id, row_number() OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    t AS (SELECT *, lag(node_id) OVER (PARTITION BY shard ORDER BY i) IS DISTINCT FROM node_id AS moved FROM ops)
    SELECT shard, count(*) FILTER (WHERE moved) AS epoch, arg_max(node_id, i) AS node_id, coalesce(max(CASE WHEN moved AND i > 1 THEN i * 10 END), 0) AS floor, count(*) FILTER (WHERE moved) AS spans FROM t GROUP BY shard"""
)
def assign_fold(spark: SparkSession, d: str) -> DataFrame:
    h = A.history(spark, d)
    ops = h.select("shard", (F.col("i") + 1).alias("i"), F.lit("acquire").alias("op"), "node_id", F.lit("x").alias("incarnation"), F.when(F.col("i") > 0, (F.col("i") + 1) * 10).alias("end"), *[F.lit(None).cast("string").alias(c) for c in ("to_node", "to_incarnation")], F.lit(None).cast("long").alias("arg"))
    return O.fold_assignments(ops).select("shard", "epoch", "node_id", "floor", F.size("history").cast("long").alias("spans"))


# --- liveness ---


@query(f"WITH {LEASES} SELECT node_id, incarnation, renewals, ended, changed_at FROM leases")
def last_change(spark: SparkSession, d: str) -> DataFrame:
    return V.last_change(A.observations(spark, d))


@query(f"WITH {LEASES}, now AS (SELECT max(observed_us) AS t FROM obs) SELECT node_id, CASE WHEN ended OR t - changed_at > 900000 + 100000 THEN 'dead' WHEN (t - changed_at) * 2 > 900000 THEN 'suspect' ELSE 'live' END AS liveness FROM leases, now")
def lease_classify(spark: SparkSession, d: str) -> DataFrame:
    obs = A.observations(spark, d)
    now = obs.agg(F.max("observed_us")).first()[0]
    return V.classify_leases(V.last_change(obs), now, 900_000, 100_000).select("node_id", "liveness")


@query(f"WITH {LEASES}, now AS (SELECT max(heard_us) AS t FROM beats) SELECT viewer, 1 + count(*) FILTER (WHERE t - heard_us < 25 AND viewer <> peer) AS heard, 1 + count(*) FILTER (WHERE t - heard_us < 25 AND viewer <> peer) >= 3 AS quorum FROM latest, now GROUP BY viewer")
def has_quorum(spark: SparkSession, d: str) -> DataFrame:
    b = A.beats(spark, d)
    now = b.agg(F.max("heard_us")).first()[0]
    members = spark.range(5).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"))
    return V.has_quorum(members, V.latest_beats(b), now, 25).select("viewer", "heard", "quorum")


@query(
    f"""WITH {LEASES}, now AS (SELECT max(heard_us) AS t FROM beats), v AS (
      SELECT peer, 'i' || (substr(peer, 2)::INT % 3) AS asked, incarnation AS seen, t - heard_us + substr(viewer, 2)::INT * 7 AS age, viewer = 'n1' AND peer = 'n2' AS gone FROM latest, now WHERE substr(viewer, 2)::INT * 7 < 28)
    SELECT peer AS node_id, CASE WHEN count(*) FILTER (WHERE gone OR (seen <> asked AND age < 28) OR age > 30) >= 3 THEN 'dead'
      WHEN min(CASE WHEN NOT gone AND seen = asked THEN age END) < 28 THEN 'live' ELSE 'suspect' END AS verdict FROM v GROUP BY peer, asked"""
)
def quorum_verdict(spark: SparkSession, d: str) -> DataFrame:
    b = A.beats(spark, d)
    now = b.agg(F.max("heard_us")).first()[0]
    number = lambda c: F.substring(c, 2, 9).cast("long")
    votes = V.latest_beats(b).select(F.col("peer").alias("node_id"), F.concat(F.lit("i"), (number("peer") % 3).cast("string")).alias("asked"), F.col("incarnation").alias("seen"), (F.lit(now) - F.col("heard_us")).alias("age_us"), ((F.col("viewer") == "n1") & (F.col("peer") == "n2")).alias("gone"), F.when(F.col("viewer") != "n0", number("viewer") * 7).alias("since_us"))
    return V.verdicts(votes, 5, True, 28, 30).select("node_id", "verdict")


@query("SELECT max(event_id * 7 % 1000) AS generation FROM events")
def newest_generation(spark: SparkSession, d: str) -> DataFrame:
    return V.newest_generation(A.beats(spark, d))


@query(
    """WITH c AS (SELECT o_custkey % 100 AS object, o_orderkey, o_orderkey * 7919 % 1000 AS epoch, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    w AS (SELECT *, epoch > coalesce(max(epoch) OVER (PARTITION BY object ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS won FROM c)
    SELECT o_orderkey, won, won AND epoch = max(epoch) OVER (PARTITION BY object) AS holder FROM w"""
)
def epoch_claims(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    o = A.table(spark, d, "orders").withColumn("object", F.col("o_custkey") % 100)
    c = o.select("object", "o_orderkey", (F.col("o_orderkey") * 7919 % 1000).alias("epoch"), F.row_number().over(W.partitionBy("object").orderBy("o_orderdate", "o_orderkey")).alias("i"))
    return V.epoch_holds(c).select("o_orderkey", "won", "holder")


# --- storage ---


@query(f"WITH {REQUESTS} SELECT i, path, component, CASE WHEN component LIKE 'ctl_%' THEN 'lease' WHEN component = 'log_segment' THEN 'segment' ELSE 'other' END AS kind, component LIKE 'ctl_%' OR component IN ('retention_report', 'other') AS in_place FROM requests")
def component_classify(spark: SparkSession, d: str) -> DataFrame:
    t = A.requests(spark, d)
    return t.select("i", "path", "component", S.throttle_kind(F.col("component")).alias("kind"), S.overwrites_in_place(F.col("component")).alias("in_place"))


MEANS = "means AS (SELECT component, (sum(size) // count(*))::BIGINT AS mean FROM requests WHERE op = 'list' GROUP BY component)"
EFFECTS = f"""{REQUESTS}, {MEANS}, prev AS (
  SELECT r.*, coalesce(mean, 0) AS mean, lag(op) OVER w AS last_op, lag(size) OVER w AS last_size FROM requests r LEFT JOIN means USING (component) WINDOW w AS (PARTITION BY path ORDER BY i, op, kind, size)
), known AS (SELECT *, CASE WHEN last_op <> 'delete' THEN last_size END AS old FROM prev), effects AS (
  SELECT i, component, CASE WHEN op = 'list' THEN 0 WHEN op = 'delete' THEN -1 WHEN kind = 'create' THEN 1 WHEN old IS NOT NULL THEN 0 WHEN kind = 'replace' OR component LIKE 'ctl_%' OR component IN ('retention_report', 'other') THEN 0 ELSE 1 END::BIGINT AS objects,
    CASE WHEN op = 'list' THEN 0 WHEN op = 'delete' THEN -coalesce(old, mean) WHEN kind = 'create' THEN size WHEN old IS NOT NULL THEN size - old WHEN kind = 'replace' OR component LIKE 'ctl_%' OR component IN ('retention_report', 'other') THEN 0 ELSE size END::BIGINT AS bytes,
    CASE WHEN op = 'list' THEN 0 WHEN op = 'delete' AND old IS NULL THEN 1 WHEN op = 'put' AND kind <> 'create' AND old IS NULL AND (kind = 'replace' OR component LIKE 'ctl_%' OR component IN ('retention_report', 'other')) THEN 1 ELSE 0 END::BIGINT AS uncertain
  FROM known)"""
NONZERO = "HAVING sum(objects) <> 0 OR sum(bytes) <> 0 OR sum(uncertain) <> 0"


def _means(t: DataFrame) -> DataFrame:
    return t.filter("op = 'list'").groupBy("component").agg(F.expr("sum(size) div count(*)").alias("mean"))


def _effects(spark, d):
    t = A.requests(spark, d)
    return C.effects(t, _means(t))


@query(f"WITH {EFFECTS} SELECT i, objects, bytes, uncertain FROM effects")
def put_delete_effects(spark: SparkSession, d: str) -> DataFrame:
    return _effects(spark, d).select("i", "objects", "bytes", "uncertain")


@query(
    f"""WITH {REQUESTS}, {MEANS}, c AS (SELECT i, component, CASE WHEN l_partkey % 3 > 0 THEN size END AS s, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 40 END AS o FROM requests)
    SELECT i, CASE WHEN o IS NULL THEN 1 ELSE 0 END::BIGINT AS objects, CASE WHEN o IS NOT NULL AND s IS NOT NULL THEN s - o WHEN o IS NOT NULL THEN 0 WHEN s IS NOT NULL THEN s ELSE coalesce(mean, 0) END::BIGINT AS bytes, CASE WHEN s IS NULL THEN 1 ELSE 0 END::BIGINT AS uncertain FROM c LEFT JOIN means USING (component)"""
)
def copy_effects(spark: SparkSession, d: str) -> DataFrame:
    t = A.requests(spark, d)
    c = t.select("i", "component", F.when(F.col("l_partkey") % 3 > 0, F.col("size")).alias("src_size"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 40).alias("dest_size"))
    return C.copy_effects(c, _means(t)).select("i", "objects", "bytes", "uncertain")


@query(f"WITH {EFFECTS} SELECT component, sum(objects)::BIGINT AS objects, sum(bytes)::BIGINT AS bytes, sum(uncertain)::BIGINT AS uncertain FROM effects GROUP BY component {NONZERO}")
def storage_fold(spark: SparkSession, d: str) -> DataFrame:
    return C.fold_counts(_effects(spark, d))


@query(
    f"""WITH {EFFECTS}, t AS (SELECT component, sum(CASE WHEN i % 3 = 0 THEN -objects ELSE objects END) AS objects, sum(CASE WHEN i % 3 = 0 THEN -bytes ELSE bytes END) AS bytes, greatest(0, sum(CASE WHEN i % 3 = 0 THEN -uncertain ELSE uncertain END)) AS uncertain FROM effects GROUP BY component)
    SELECT component, objects::BIGINT AS objects, bytes::BIGINT AS bytes, uncertain::BIGINT AS uncertain FROM t WHERE objects <> 0 OR bytes <> 0 OR uncertain <> 0"""
)
def storage_subtract(spark: SparkSession, d: str) -> DataFrame:
    return C.net_counts(_effects(spark, d), F.col("i") % 3 == 0)


@query(f"WITH {REQUESTS} SELECT component, (sum(size) // count(*))::BIGINT AS mean FROM requests GROUP BY component")
def storage_means(spark: SparkSession, d: str) -> DataFrame:
    t = A.requests(spark, d).groupBy("component").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
    return C.component_means(t)


PAGES = "pages(s, r, last) AS (VALUES (1000::BIGINT, 1100::BIGINT, 'blob/3'), (5000, 5100, 'nodes/2'), (9000, 9100, 'state/2'))"
SIDES = f"""{REQUESTS}, {PAGES}, ops AS (SELECT i, path, component, size, i % 9973 AS start, i % 9973 + l_suppkey % 300 AS stop FROM requests), sides AS (
  SELECT ops.*, CASE WHEN p.s IS NULL THEN 'after' WHEN stop + 250 < p.s THEN 'before' WHEN start > p.r + 250 THEN 'after' ELSE 'unsure' END AS side FROM ops ASOF LEFT JOIN pages p ON ops.path <= p.last)"""


def _window(spark, d):
    ops = A.requests(spark, d).select("i", "path", "component", F.lit(1).cast("long").alias("objects"), F.col("size").alias("bytes"), F.lit(0).cast("long").alias("uncertain"), (F.col("i") % 9973).alias("start"), (F.col("i") % 9973 + F.col("l_suppkey") % 300).alias("end"))
    return ops, spark.createDataFrame([(1000, 1100, "blob/3"), (5000, 5100, "nodes/2"), (9000, 9100, "state/2")], "s long, r long, last string")


@query(f"WITH {SIDES} SELECT i, side FROM sides")
def window_side(spark: SparkSession, d: str) -> DataFrame:
    ops, pages = _window(spark, d)
    return C.window_sides(ops, pages, 250).select("i", "side")


@query(f"WITH {SIDES} SELECT component, count(*) AS objects, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE side = 'unsure') AS uncertain FROM sides WHERE side <> 'before' GROUP BY component")
def window_classify(spark: SparkSession, d: str) -> DataFrame:
    ops, pages = _window(spark, d)
    return C.classify_window(ops, pages, 250)


OBSERVED = "observed AS (SELECT CASE p_size % 3 WHEN 0 THEN 'a' || p_partkey % 50 WHEN 1 THEN 'a' || p_partkey % 50 || '/b' || p_size ELSE 'a' || p_partkey % 70 || '/b' || p_size || '/c/' END AS prefix, p_partkey AS ms, p_size AS objects, p_size * 10 AS bytes FROM part), lists AS (SELECT prefix, arg_max(objects, ms)::BIGINT AS objects, arg_max(bytes, ms)::BIGINT AS bytes, max(ms) AS ms FROM observed GROUP BY prefix)"


def _observed(spark, d):
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    a = lambda k: F.concat(F.lit("a"), (p % k).cast("string"))
    prefix = F.when(F.col("p_size") % 3 == 0, a(50)).when(F.col("p_size") % 3 == 1, F.concat(a(50), F.lit("/b"), size)).otherwise(F.concat(a(70), F.lit("/b"), size, F.lit("/c/")))
    return A.table(spark, d, "part").select(prefix.alias("prefix"), F.col("p_size").cast("long").alias("objects"), (F.col("p_size") * 10).cast("long").alias("bytes"), p.alias("ms"))


@query(f"WITH {OBSERVED} SELECT prefix, objects, bytes, ms FROM lists")
def latest_lists(spark: SparkSession, d: str) -> DataFrame:
    return C.latest_lists(_observed(spark, d))


@query(f"WITH {OBSERVED} SELECT coalesce(sum(objects), 0)::BIGINT AS objects, coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) AS n FROM lists k WHERE NOT EXISTS (SELECT 1 FROM lists p WHERE p.prefix <> k.prefix AND starts_with(k.prefix, rtrim(p.prefix, '/') || '/'))")
def observed_total(spark: SparkSession, d: str) -> DataFrame:
    return C.observed_total(C.latest_lists(_observed(spark, d)))


@query(f"WITH {OBSERVED}, a AS (SELECT * FROM lists WHERE ms % 2 = 0 OR ms % 5 = 0), b AS (SELECT prefix, objects + 1 AS objects, bytes, ms + ms % 2 AS ms FROM lists WHERE ms % 3 > 0) SELECT coalesce(a.prefix, b.prefix) AS prefix, CASE WHEN a.ms IS NULL OR b.ms > a.ms THEN b.objects ELSE a.objects END AS objects, greatest(a.ms, b.ms) AS ms FROM a FULL JOIN b ON a.prefix = b.prefix")
def observed_merge(spark: SparkSession, d: str) -> DataFrame:
    lists = C.latest_lists(_observed(spark, d))
    other = lists.filter("ms % 3 > 0").withColumn("objects", F.col("objects") + 1).withColumn("ms", F.col("ms") + F.col("ms") % 2)
    return C.merge_observed(lists.filter("ms % 2 = 0 or ms % 5 = 0"), other).select("prefix", "objects", "ms")


# --- requests ---


@query(f"WITH {REQUESTS} SELECT op, component, client, result, count(*) AS requests FROM requests GROUP BY ALL")
def request_rollup(spark: SparkSession, d: str) -> DataFrame:
    return C.request_rollup(A.requests(spark, d))


@query(f"WITH {REQUESTS} SELECT CASE op WHEN 'put' THEN 'up' ELSE 'down' END AS dir, component, client, sum(size)::BIGINT AS bytes FROM requests WHERE size > 0 GROUP BY ALL")
def byte_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = A.requests(spark, d).withColumn("dir", F.when(F.col("op") == "put", "up").otherwise("down"))
    return C.byte_rollup(t.withColumnRenamed("size", "bytes"))


@query(f"WITH {REQUESTS} SELECT component, sum(1 + (size * 100) // 1000)::BIGINT AS pages FROM requests WHERE op = 'list' GROUP BY component")
def list_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.page_rollup(A.requests(spark, d).filter("op = 'list'").withColumn("keys", F.col("size") * 100))


BOUNDS = ", ".join(f"({i}, {1e-4 * 2**i!r}::DOUBLE)" for i in range(20))


@query(f"WITH {REQUESTS}, bounds(bucket, le) AS (VALUES {BOUNDS}) SELECT op, component, bucket, le, count(*) FILTER (WHERE seconds <= le) AS n FROM requests, bounds WHERE result = 'ok' GROUP BY ALL")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return C.histogram(A.requests(spark, d).filter("result = 'ok'"), "seconds", ["op", "component"], S.latency_bounds())


@query(f"WITH {REQUESTS} SELECT CASE WHEN component LIKE 'ctl_%' THEN 'lease' WHEN component = 'log_segment' THEN 'segment' ELSE 'other' END AS kind, count(*) AS throttled FROM requests WHERE l_partkey % 17 = 0 OR (l_partkey % 17 = 1 AND l_suppkey % 2 = 0) GROUP BY 1")
def throttled(spark: SparkSession, d: str) -> DataFrame:
    t = A.requests(spark, d).withColumn("kind", S.throttle_kind(F.col("component")))
    t = t.withColumn("status", F.when(F.col("l_partkey") % 17 == 0, 429).when(F.col("l_partkey") % 17 == 1, 503).otherwise(200)).withColumn("message", F.when(F.col("l_suppkey") % 2 == 0, "<Code>SlowDown</Code>").otherwise("unavailable"))
    return C.throttled(t)


@query("SELECT format, count(event_id) AS n FROM (VALUES ('segment'), ('log_stream'), ('applied_marker'), ('cluster_version'), ('control_object')) f(format) LEFT JOIN (SELECT event_id, CASE event_type WHEN 'error' THEN 'segment' WHEN 'click' THEN 'control_object' END AS format FROM events) e USING (format) GROUP BY format")
def format_errors(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select(F.when(F.col("event_type") == "error", "segment").when(F.col("event_type") == "click", "control_object").alias("format")).filter("format is not null")
    return C.format_errors(e)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'precondition' WHEN 2 THEN 'timeout' ELSE 'error' END ELSE 'ok' END AS result FROM events")
def result_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    err = F.when(F.col("event_type") == "error", F.when(k == 0, "NotFound").when(k == 1, "AlreadyExists").otherwise("Generic"))
    return A.table(spark, d, "events").select("event_id", S.result_label(err, F.when(k == 2, "request Timed Out").otherwise("retry_timeout: 5s")).alias("result"))


# --- metric series ---

SERIES = "updates AS (SELECT CASE event_type WHEN 'click' THEN 'slatedb.db.l0' WHEN 'view' THEN 'slatedb.wal.bytes' ELSE 'process.load' END AS name, 'db' || (user_id % 3) AS db, user_id % 20 AS handle, event_id AS ts, (event_id % 50)::DOUBLE AS value FROM events), shares AS (SELECT name, db, sum(v) AS value FROM (SELECT name, db, handle, arg_max(value, ts) AS v FROM updates WHERE handle % 5 <> 0 GROUP BY ALL) GROUP BY ALL)"


def _updates(spark, d):
    name = F.when(F.col("event_type") == "click", "slatedb.db.l0").when(F.col("event_type") == "view", "slatedb.wal.bytes").otherwise("process.load")
    return A.table(spark, d, "events").select(name.alias("name"), F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("db"), (F.col("user_id") % 20).alias("handle"), F.col("event_id").alias("ts"), F.lit(0).alias("seq"), (F.col("event_id") % 50).cast("double").alias("value"))


def _shares(spark, d):
    return C.gauge_shares(_updates(spark, d), spark.range(0, 20, 5).withColumnRenamed("id", "handle"))


@query(f"WITH {SERIES} SELECT * FROM shares")
def gauge_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d)


@query(f"WITH {SERIES} SELECT name, sum(value) AS total FROM shares WHERE db = 'db1' GROUP BY name")
def series_sum(spark: SparkSession, d: str) -> DataFrame:
    return C.series_sum(_shares(spark, d), "db1")


@query(f"WITH {SERIES} SELECT DISTINCT name, db, regexp_replace(name, '[^A-Za-z0-9]', '_', 'g') AS prom, CASE WHEN name LIKE 'slatedb.%' THEN 'db=' || db || ',kind=x' ELSE 'kind=x' END AS labels FROM updates")
def series_labels(spark: SparkSession, d: str) -> DataFrame:
    raw = F.create_map(F.lit("kind"), F.lit("x"), F.lit("worker_id"), F.lit("01H"))
    t = _updates(spark, d).select("name", "db").distinct().withColumn("l", S.series_labels(F.col("name"), raw, F.col("db")))
    text = F.array_join(F.transform(F.map_entries("l"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return t.select("name", "db", S.prom_name(F.col("name")).alias("prom"), text.alias("labels"))


@query("SELECT event_type AS kind, coalesce(sum(CASE WHEN event_id % 3 = 0 THEN event_id % 10 END), 0)::BIGINT AS hits, coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 10 END), 0)::BIGINT AS misses FROM events GROUP BY event_type")
def cache_pivot(spark: SparkSession, d: str) -> DataFrame:
    r = F.when(F.col("event_id") % 3 == 0, "hit").when(F.col("event_id") % 3 == 1, "miss")
    return C.cache_pivot(A.table(spark, d, "events").select(F.col("event_type").alias("kind"), r.alias("result"), (F.col("event_id") % 10).alias("n")))


@query(
    """WITH s AS (SELECT l_orderkey AS db, l_linenumber AS k, l_quantity::BIGINT AS q FROM lineitem), r AS (SELECT db, k % 3 AS run, sum(q) AS b, count(*) AS n FROM s WHERE k > 2 GROUP BY ALL),
    t AS (SELECT db, count(*) AS runs, sum(n)::BIGINT AS compacted_ssts, sum(b)::BIGINT AS compacted_bytes, max(b)::BIGINT AS largest_run FROM r GROUP BY db)
    SELECT s.db, count(*) FILTER (WHERE k <= 2) AS l0_count, coalesce(sum(q) FILTER (WHERE k <= 2), 0)::BIGINT AS l0_bytes, coalesce(any_value(runs), 0) AS runs, coalesce(any_value(compacted_ssts), 0) AS compacted_ssts, coalesce(any_value(compacted_bytes), 0) AS compacted_bytes, coalesce(any_value(largest_run), 0) AS largest_run
    FROM s LEFT JOIN t USING (db) GROUP BY s.db"""
)
def lsm_totals(spark: SparkSession, d: str) -> DataFrame:
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("db"), F.col("l_linenumber").alias("k"), F.col("l_quantity").cast("long").alias("q"))
    some = lambda c: F.collect_list(F.when(c, F.col("q")))
    shape = li.groupBy("db").agg(some(F.col("k") <= 2).alias("l0"), *[some((F.col("k") > 2) & (F.col("k") % 3 == m)).alias(f"r{m}") for m in range(3)])
    runs = F.filter(F.array("r0", "r1", "r2"), lambda r: F.size(r) > 0)
    return C.lsm_totals(shape.select("db", "l0", runs.alias("runs")))


@query("SELECT o_orderpriority || o_custkey % 10 AS name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS handle, max(o_orderdate) AS registered FROM orders GROUP BY 1")
def newest_handle(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    return C.newest_handle(o.select(F.concat("o_orderpriority", (F.col("o_custkey") % 10).cast("string")).alias("name"), F.col("o_orderkey").alias("handle"), F.col("o_orderdate").alias("registered")))


@query("SELECT 'parts{brand=\"' || p_brand || '\",size=\"' || p_size || '\"} ' || count(*) AS line FROM part GROUP BY p_brand, p_size")
def prometheus_text(spark: SparkSession, d: str) -> DataFrame:
    n = A.table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("value"))
    return C.prometheus_text(n.select(F.lit("parts").alias("name"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("labels"), "value"))


# --- heap profiles: parts as stacks ---


@query("SELECT p_partkey, round(objs * scale)::BIGINT AS objs, round(bytes * scale)::BIGINT AS bytes FROM (SELECT p_partkey, objs, bytes, 1 / (1 - exp(-(bytes / objs) / 524288)) AS scale FROM (SELECT p_partkey, p_size AS objs, (p_partkey % 1000 + 1) * 1000.0::DOUBLE AS bytes FROM part))")
def heap_unbias(spark: SparkSession, d: str) -> DataFrame:
    t = A.table(spark, d, "part").select("p_partkey", S.unbias(F.col("p_size"), (F.col("p_partkey") % 1000 + 1) * 1000.0, 524288.0).alias("u"))
    return t.select("p_partkey", "u.objs", "u.bytes")


LIBS = "libs AS (SELECT s_suppkey * 1000 AS start, s_suppkey * 1000 + 700 AS stop, s_name AS path FROM supplier)"


@query(f"WITH {LIBS} SELECT p_partkey, path FROM (SELECT p_partkey, p_partkey * 37 % 120000 AS addr FROM part) LEFT JOIN libs ON addr >= start AND addr < stop")
def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    maps = A.table(spark, d, "supplier").select((F.col("s_suppkey") * 1000).alias("start"), (F.col("s_suppkey") * 1000 + 700).alias("end"), F.col("s_name").alias("path"))
    at = A.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 120000).alias("addr"))
    return H.locate_library(at, maps).select("p_partkey", "path")


@query("SELECT p_brand AS function, sum(q)::BIGINT AS objs, sum(q * 16)::BIGINT AS bytes FROM (SELECT DISTINCT l_orderkey, p_brand, l_orderkey % 90 + 1 AS q FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY p_brand")
def inuse_by_function(spark: SparkSession, d: str) -> DataFrame:
    li = A.table(spark, d, "lineitem")
    q = F.col("stack") % 90 + 1
    stacks = li.groupBy(F.col("l_orderkey").alias("stack")).agg(F.collect_list("l_partkey").alias("addrs")).withColumn("dump", F.lit("d")).withColumn("objs", q).withColumn("bytes", q * 16)
    return H.in_use_by_function(stacks, A.table(spark, d, "part").select(F.col("p_partkey").alias("addr"), F.col("p_brand").alias("function")))
