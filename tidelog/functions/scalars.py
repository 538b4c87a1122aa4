"""Scalar functions as Column expressions: slots and shards, keys, sequence numbers, labels and sizes.

Everything here is built from Spark's own functions, so it stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 65536
MAX_U32 = 4294967295


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


# --- slots, shards and ranges ---


def slot_of(did: Column) -> Column:
    """The first two bytes of the SHA-256, big-endian: a hash slot in [0, 65536)."""
    return F.conv(F.substring(F.sha2(did, 256), 1, 4), 16, 10).cast("int")


def event_slot(did: Column) -> Column:
    """slot_of, but slot 0 where the frame named nobody."""
    return F.coalesce(slot_of(did), F.lit(0))


def shard_of_slot(slot: Column, shards) -> Column:
    return F.shiftright(_long(slot) * _long(shards), 16)


def slot_range(k: Column, n: Column) -> Column:
    """struct(lo, hi) of part k of n equal parts of the slots; null unless 1 <= n <= 65536 and 0 <= k < n."""
    k, n = _long(k), _long(n)
    up = lambda i: F.floor((i * SLOTS + n - 1) / F.when(n > 0, n)).cast("int")
    return F.when((n >= 1) & (n <= SLOTS) & (k >= 0) & (k < n), F.struct(up(k).alias("lo"), up(k + 1).alias("hi")))


def parse_slot_range(s: Column) -> Column:
    """'k/n' in digits alone to slot_range(k, n); anything else is null."""
    ok = s.rlike(r"^[0-9]{1,9}/[0-9]{1,9}$")
    part = lambda i: F.when(ok, F.split(s, "/")[i]).cast("long")
    return slot_range(part(0), part(1))


def in_range(slot: Column, lo, hi) -> Column:
    return (slot >= lo) & (slot < hi)


def shard_key(shard: Column) -> Column:
    """Ten digits; null for a number that no 32 bits hold, whose first ten digits would name another shard."""
    return F.when(_long(shard).between(0, MAX_U32), F.lpad(shard.cast("string"), 10, "0"))


def parse_shard_key(key: Column) -> Column:
    """The shard of ten digits that fit 32 bits; null for anything else."""
    v = F.when(key.rlike(r"^[0-9]{10}$"), key.cast("long"))
    return F.when(v <= MAX_U32, v)


# --- binary keys ---


def slot_key_prefix(slot: Column) -> Column:
    return F.concat(F.unhex(F.lit("01")), F.unhex(F.lpad(F.hex(_long(slot)), 4, "0")))


def slot_key(slot: Column, family: Column, rest: Column) -> Column:
    """0x01, the slot in two bytes, a family byte, the rest."""
    return F.concat(slot_key_prefix(slot), F.unhex(F.lpad(F.hex(_long(family)), 2, "0")), rest.cast("binary"))


def key_slot(key: Column) -> Column:
    fits = (F.octet_length(key) >= 3) & (F.hex(F.substring(key, 1, 1)) == "01")
    return F.when(fits, F.conv(F.hex(F.substring(key, 2, 2)), 16, 10).cast("int"))


def key_body(key: Column) -> Column:
    fits = (F.octet_length(key) >= 3) & (F.hex(F.substring(key, 1, 1)) == "01")
    return F.when(fits, F.substring(key, 4, 1 << 30))


def slot_range_keys(lo: Column, hi: Column) -> Column:
    """struct(start, end) of binary keys that hold the slots [lo, hi)."""
    end = F.when(_long(hi) >= SLOTS, F.unhex(F.lit("02"))).otherwise(slot_key_prefix(F.least(_long(hi), F.lit(SLOTS - 1))))
    return F.struct(slot_key_prefix(lo).alias("start"), end.alias("end"))


def prefix_end(prefix: Column) -> Column:
    """The least key above all keys with the prefix: its last byte under 0xff is raised and what follows
    cut; of a prefix of 0xff alone, one more 0xff."""
    h = F.hex(prefix)
    core = F.regexp_replace(h, "^((?:..)*?)(?:FF)*$", "$1")
    n = F.length(core)
    last = F.lpad(F.hex(F.conv(F.substring(core, -2, 2), 16, 10).cast("long") + 1), 2, "0")
    return F.unhex(F.when(n == 0, F.concat(h, F.lit("FF"))).otherwise(F.concat(F.left(core, n - 2), last)))


# --- sequence numbers: microseconds << 8 | writer ---


def micros(ts: Column) -> Column:
    """Of a timestamp without zone, read as UTC (sessions are pinned to UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seq_floor(us: Column) -> Column:
    return F.shiftleft(_long(us), 8)


def seq_time(seq: Column) -> Column:
    return F.timestamp_micros(F.shiftright(seq, 8))


def own_seq_at_or_below(v: Column, writer) -> Column:
    """The greatest value at most v whose low byte is the writer."""
    v, w = _long(v), _long(writer)
    base = v.bitwiseAND(F.lit(~255))
    return F.when(v.bitwiseAND(F.lit(255).cast("long")) >= w, base.bitwiseOR(w)).otherwise((base - 256).bitwiseOR(w))


def emit_delay(now_us: Column, seq: Column) -> Column:
    """Seconds from a seq's time to now, never negative."""
    return F.greatest(F.lit(0).cast("long"), _long(now_us) - F.shiftright(seq, 8)) / 1e6


# --- object keys ---

#: Components of the first path part (fixed values).
TOP_COMPONENTS = {
    "log": "log_segment", "retain": "retention_report", "nodes": "ctl_lease", "assign": "ctl_assign", "writers": "ctl_writer", "cluster": "ctl_version", "handle": "account_index", "email": "account_index",
    "stats": "ctl_stats", "blob": "blob", "blob-gc": "blob", "blob-tmp": "blob", "discovery": "discovery_state", "policy": "policy",
}
#: Components of a state directory (fixed values).
STATE_COMPONENTS = {"manifest": "state_manifest", "compacted": "state_sst", "wal": "state_wal", "compactions": "state_compactions", "gc": "state_gc_boundary"}
SEED_COMPONENTS = {"manifest": "plc_seeds_manifest", "compacted": "plc_seeds_sst", "wal": "plc_seeds_wal", "compactions": "plc_seeds_compactions", "gc": "plc_seeds_gc_boundary"}
REPO_COMPONENTS = {"manifest.json": "delta_manifest", "keys": "delta_keys", "wal": "delta_wal", "packs": "delta_pack"}
#: Components whose unseen overwrites are replacements (fixed values), besides all of the control ones.
IN_PLACE = ("retention_report", "state_gc_boundary", "state_other", "plc_seeds_gc_boundary", "plc_seeds_other", "plc_checkpoint", "discovery_state", "policy", "other")


def _choose(x: Column, of: dict[str, str], other: Column | str) -> Column:
    out = None
    for k, v in of.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out.otherwise(other)


def component(path: Column, prefix: str = "") -> Column:
    """The class of an object key, by its parts below the prefix."""
    head = F.lit(prefix + "/")
    rel = F.when(path.startswith(head), F.substr(path, F.length(head) + 1)).otherwise(path) if prefix else path
    part = lambda i: F.coalesce(F.get(F.split(rel, "/"), F.lit(i)), F.lit(""))
    a, b, c, d = part(0), part(1), part(2), part(3)
    state = lambda x: _choose(x, STATE_COMPONENTS, "state_other")
    qlog = F.when(b == "manifest", "qlog_manifest").when(b == "leader", "qlog_leader").when(b.startswith("state"), state(c)).when(b == "", "qlog").otherwise("other")
    plc = F.when(b == "seeds", _choose(c, SEED_COMPONENTS, "plc_seeds_other")).when(b == "export-checkpoint.json", "plc_checkpoint").otherwise("other")
    repos = F.when(c.isin(*REPO_COMPONENTS), _choose(c, REPO_COMPONENTS, "other")).when(c.startswith("state"), state(d)).otherwise("other")
    return _choose(a, TOP_COMPONENTS, F.when(a == "qlog", qlog).when(a == "plc", plc).when(a == "state", state(c)).when(a == "repos", repos).otherwise("other"))


def throttle_kind(comp: Column) -> Column:
    return F.when(comp.startswith("ctl_"), "lease").when(comp == "log_segment", "segment").otherwise("other")


def request_kind(uri: Column, bucket: str, prefix: str = "") -> Column:
    """throttle_kind of a path-style request: of its key, or of a listing's prefix parameter."""
    whole = F.concat(F.lit("http://h"), uri)
    listed = F.parse_url(whole, F.lit("QUERY"), F.lit("prefix"))
    key = F.regexp_replace(F.parse_url(whole, F.lit("PATH")), f"^/{bucket}/?", "")
    return throttle_kind(component(F.url_decode(F.when(F.length(key) > 0, key).otherwise(F.coalesce(listed, F.lit("")))), prefix))


def overwrites_in_place(comp: Column) -> Column:
    return comp.startswith("ctl_") | comp.isin(*IN_PLACE)


def result_label(error: Column, message: Column) -> Column:
    """ok, not_found, precondition, timeout or error, by an error's class and message."""
    return (
        F.when(error.isNull(), "ok")
        .when(error == "NotFound", "not_found")
        .when(error.isin("Precondition", "AlreadyExists", "NotModified"), "precondition")
        .when(F.lower(message).contains("timed out"), "timeout")
        .otherwise("error")
    )


def op_label(op: Column, mode: Column) -> Column:
    """put, put_create, put_cas; get, get_range, head."""
    return F.when((op == "put") & (mode == "create"), "put_create").when((op == "put") & (mode == "update"), "put_cas").when((op == "get") & (mode == "range"), "get_range").when((op == "get") & (mode == "head"), "head").otherwise(op)


def reserved_lane(write: Column, comp: Column) -> Column:
    """Requests that a limiter lets through first: control documents, and writes of the log."""
    return comp.startswith("ctl_") | (write & (comp == "log_segment"))


def is_transient(error: Column) -> Column:
    return F.coalesce(error == "Generic", F.lit(False))


# --- names, labels and sizes ---

#: Metric families that are kept apart by database, and those of them that aren't (fixed values).
DB_FAMILIES = ("slatedb.db.", "slatedb.db_cache.", "slatedb.compactor.", "slatedb.wal.", "slatedb.memtable_flush.")
NOT_DB_FAMILY = "slatedb.db.sst_filter_"


def prom_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def per_db(name: Column) -> Column:
    out = F.lit(False)
    for p in DB_FAMILIES:
        out = out | name.startswith(p)
    return out & ~name.startswith(NOT_DB_FAMILY)


def series_labels(name: Column, labels: Column, db: Column) -> Column:
    """Labels without ids of instances; with the database's name where the family is kept apart by it."""
    kept = F.map_filter(labels, lambda k, _: ~k.endswith("_id") & (k != "db"))
    return F.when(per_db(name), F.map_concat(F.create_map(F.lit("db"), db), kept)).otherwise(kept)


def wire_bytes(frame_bytes: Column) -> Column:
    """A frame and its websocket header of 2, 4 or 10 bytes."""
    return frame_bytes + F.when(frame_bytes < 126, 2).when(frame_bytes <= 65535, 4).otherwise(10)


def user_agent(ua: Column) -> Column:
    return F.substring(F.coalesce(ua, F.lit("")), 1, 120)


def unbias(objs: Column, size: Column, rate: float) -> Column:
    """struct(objs, bytes) of a heap sample scaled by its chance of having been taken."""
    scale = 1 / (1 - F.exp(-(size / objs) / rate))
    return F.struct(F.round(objs * scale).cast("long").alias("objs"), F.round(size * scale).cast("long").alias("bytes"))


def latency_bounds(n: int = 20, first: float = 1e-4) -> list[float]:
    return [first * 2.0**i for i in range(n)]


def header_length(log_id: Column, checksum: Column | None = None) -> Column:
    """Bytes of a segment header."""
    extra = F.when(checksum, 8).otherwise(0) if checksum is not None else F.lit(0)
    return F.octet_length(log_id) + 51 + extra


def body_checksum(body: Column) -> Column:
    return F.substring(F.sha2(body, 256), 1, 16)


def segment_path(prefix: Column | str, log_id: Column, ordinal: Column) -> Column:
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat_ws("/", p, F.lit("log"), log_id.cast("string"), F.concat(F.lpad(ordinal.cast("string"), 12, "0"), F.lit(".seg")))


def report_path(log_id: Column) -> Column:
    return F.concat(F.lit("retain/"), log_id)


def lease_path(node_id: Column) -> Column:
    return F.concat(F.lit("nodes/"), node_id)


def assignment_path(shard: Column) -> Column:
    return F.concat(F.lit("assign/"), shard_key(shard))


def list_pages(keys: Column, page: int = 1000) -> Column:
    """Requests that list so many keys; a full last page needs one more."""
    return 1 + F.floor(keys / page)
