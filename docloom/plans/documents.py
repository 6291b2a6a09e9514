"""The document operators over the driver's tables, with their SQL.

Events serve as JSON documents (``props`` is their text); line items, whose key
is not unique, as a log of versions; orders as the relation that changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import compat
from docloom.functions.filters import json_predicate
from docloom.operators import analytics, changes, dml, keyspace, placement, quorum, security, triggers
from docloom.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The time at which the queries look at the documents.
NOW = 1_705_276_800
NODES = ["n1", "n2", "n3"]


def query(sql: str | None = None, name: str | None = None):
    """Register a query, and its SQL if there is any."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    t = F.col(ts)
    return (F.datediff(t, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("bigint")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored documents; every seventh expires a day later."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("props").alias("value"),
        F.when(F.col("event_id") % 7 == 0, epoch("ts") + 86400).alias("ttl"),
        epoch("ts").alias("timestamp"),
        F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("origin"),
    )


#: The same rows in SQL.
EVENTS = """(SELECT CAST(event_id AS VARCHAR) AS id, props AS value, CASE WHEN event_id % 7 = 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 86400 END AS ttl,
 CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS timestamp, 'n' || (event_id % 3) AS origin, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
LIVE = f"(ttl IS NULL OR ttl >= {NOW})"


def _space(spark: SparkSession, sf_dir: str) -> keyspace.Keyspace:
    return keyspace.Keyspace(event_rows(spark, sf_dir), NOW)


@query(f"SELECT id, timestamp, value FROM {EVENTS} WHERE id = '43' AND {LIVE}")
def kv_get(spark, sf_dir):
    return _space(spark, sf_dir).get("43")


@query(f"SELECT value FROM {EVENTS} WHERE {LIVE}")
def kv_all(spark, sf_dir):
    return _space(spark, sf_dir).all()


@query(f"SELECT id, timestamp, value FROM {EVENTS} WHERE {LIVE}")
def kv_meta(spark, sf_dir):
    return _space(spark, sf_dir).meta()


@query(f"SELECT id FROM {EVENTS} WHERE {LIVE} ORDER BY timestamp, id")
def kv_ids_by_time(spark, sf_dir):
    return _space(spark, sf_dir).ids()


@query(f"SELECT count(*) AS n FROM {EVENTS} WHERE {LIVE}")
def kv_count(spark, sf_dir):
    return _space(spark, sf_dir).count()


@query(f"""SELECT id, '{{"id":"' || id || '",' || substr(value, 2) AS document FROM {EVENTS} WHERE {LIVE}""")
def kv_documents(spark, sf_dir):
    return _space(spark, sf_dir).documents()


@query(f"SELECT id, k FROM {EVENTS} WHERE {LIVE}")
def kv_as_table(spark, sf_dir):
    return _space(spark, sf_dir).table("k bigint")


FILTERS = {
    "filter_eq_integer": ([{"key": "k", "operator": "eq", "value": 42}], "k = 42"),
    "filter_eq_whole_double": ([{"key": "k", "operator": "eq", "value": 42.0}], "k = 42"),
    "filter_eq_other_type": ([{"key": "k", "operator": "eq", "value": "42"}], "false"),
    "filter_eq_boolean": ([{"key": "k", "operator": "eq", "value": True}], "false"),
    "filter_eq_null": ([{"key": "k", "operator": "eq", "value": None}], "false"),
    "filter_ne": ([{"key": "k", "operator": "ne", "value": 42}], "k <> 42"),
    "filter_ne_missing_key": ([{"key": "none", "operator": "ne", "value": 1}], "false"),
    "filter_eq_missing_key": ([{"key": "none", "operator": "eq", "value": 1}], "false"),
    "filter_gt": ([{"key": "k", "operator": "gt", "value": 42}], "k > 42"),
    "filter_gte": ([{"key": "k", "operator": "gte", "value": 42}], "k >= 42"),
    "filter_lt": ([{"key": "k", "operator": "lt", "value": 42.5}], "k < 42.5"),
    "filter_lte": ([{"key": "k", "operator": "lte", "value": 42}], "k <= 42"),
    "filter_and": ([{"key": "k", "operator": "gte", "value": 10}, {"key": "k", "operator": "lt", "value": 20}], "k >= 10 AND k < 20"),
    "filter_none": ([], "true"),
}
for _name, (_filters, _where) in FILTERS.items():
    query(f"SELECT id, value FROM {EVENTS} WHERE {LIVE} AND {_where}", _name)(
        lambda spark, sf_dir, f=_filters: _space(spark, sf_dir).live(f).select("id", "value")
    )


def priority_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with a boolean, a null and a member that some lack."""
    o = load(spark, sf_dir, "orders")
    low = F.col("o_custkey") % 3
    value = F.concat(
        F.lit('{"f":'), F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"), F.lit(',"c":'), F.when(low == 0, "null").otherwise(F.col("o_custkey").cast("string")),
        F.when(low == 1, F.lit(',"some":"x"')).otherwise(""), F.lit(',"big":'), (F.col("o_orderkey") + 9007199254740990).cast("string"), F.lit("}"),
    )
    return o.select(F.col("o_orderkey").cast("string").alias("id"), value.alias("value"))


PRIORITY_FILTERS = {
    "filter_boolean_found": ([{"key": "f", "operator": "eq", "value": True}], "o_orderstatus = 'F'"),
    "filter_null_found": ([{"key": "c", "operator": "eq", "value": None}], "o_custkey % 3 = 0"),
    "filter_ne_null_found": ([{"key": "c", "operator": "ne", "value": None}], "o_custkey % 3 <> 0"),
    "filter_ne_member_of_some": ([{"key": "some", "operator": "ne", "value": "y"}], "o_custkey % 3 = 1"),
    "filter_other_type_found": ([{"key": "some", "operator": "ne", "value": 1}, {"key": "f", "operator": "ne", "value": "true"}], "o_custkey % 3 = 1"),
    "filter_past_double": ([{"key": "big", "operator": "gt", "value": 9007199254740993}], "o_orderkey > 3"),
}
for _name, (_filters, _where) in PRIORITY_FILTERS.items():
    query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE {_where}", _name)(
        lambda spark, sf_dir, f=_filters: keyspace.Keyspace(priority_rows(spark, sf_dir).withColumns({"ttl": F.lit(None).cast("bigint"), "timestamp": F.lit(0)}), NOW).live(f).select("id")
    )


@query("""SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand = 'Brand#1' OR false""")
def filter_native_columns(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    return keyspace.where(parts, [{"key": "p_size", "operator": "gt", "value": 10}, {"key": "p_brand", "operator": "eq", "value": "Brand#1"}]).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 200 AND c_nationkey = 7")
def filter_nested_path(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    doc = F.to_json(F.struct(F.struct("c_acctbal", F.struct("c_nationkey").alias("n")).alias("a")))
    filters = [{"key": "a.c_acctbal", "operator": "gte", "value": 100}, {"key": "a.c_acctbal", "operator": "lte", "value": 200}, {"key": "a.n.c_nationkey", "operator": "eq", "value": 7}]
    return c.withColumn("doc", doc).filter(json_predicate(F.col("doc"), filters)).select("c_custkey")


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS id, 'region' AS space, r_name AS name, r_regionkey AS timestamp FROM region
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'nation', n_name, n_nationkey FROM nation""")
def partition_newest_first(spark, sf_dir):
    r = load(spark, sf_dir, "region").select("id", F.col("r_name").alias("name"), F.col("r_regionkey").alias("timestamp"))
    n = load(spark, sf_dir, "nation").select("id", F.col("n_name").alias("name"), F.col("n_nationkey").alias("timestamp"))
    return keyspace.newest_first({"region": r, "nation": n}).withColumnRenamed("_keyspace", "space")


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versions of their order's line; returned ones delete it."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.when(F.col("l_returnflag") == "R", "delete").otherwise("put").alias("op"),
        F.concat(F.lit('{"part":'), F.col("l_partkey").cast("string"), F.lit(',"qty":'), F.col("l_quantity").cast("int").cast("string"), F.lit("}")).alias("value"),
        F.when(F.col("l_suppkey") % 4 == 0, epoch("l_shipdate") + 86400 * 365).alias("ttl"),
        epoch("l_shipdate").alias("ts"),
        F.concat(F.lit("n"), (F.col("l_suppkey") % 3).cast("string")).alias("origin"),
    )


LOG = """(SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'put' END AS op,
 '{"part":' || l_partkey || ',"qty":' || CAST(l_quantity AS INT) || '}' AS value,
 CASE WHEN l_suppkey % 4 = 0 THEN CAST(epoch(l_shipdate) AS BIGINT) + 86400 * 365 END AS ttl, CAST(epoch(l_shipdate) AS BIGINT) AS ts, 'n' || (l_suppkey % 3) AS origin FROM lineitem)"""
#: Last writes by SQL, ties by the whole row.
WON = f"""(SELECT id, op, CASE WHEN op = 'put' THEN value END AS value, CASE WHEN op = 'delete' THEN ts - 5 ELSE ttl END AS ttl, ts, origin FROM (SELECT *,
 row_number() OVER (PARTITION BY id ORDER BY ts DESC, origin DESC, op DESC, value DESC, ttl DESC NULLS LAST) AS rn FROM {LOG}) WHERE rn = 1)"""
THEN = 852_076_800


@query(f"SELECT id, op, value, ttl, ts, origin FROM {WON}")
def lww_latest(spark, sf_dir):
    return changes.latest(item_log(spark, sf_dir), "id")


@query(f"SELECT id, op, value, ttl, ts, origin FROM {WON} WHERE op <> 'delete' AND (ttl IS NULL OR ttl >= {THEN})")
def lww_current(spark, sf_dir):
    return changes.current(item_log(spark, sf_dir), THEN, "id")


@query(f"SELECT id, op, value, ttl, ts, origin FROM {WON} WHERE op = 'delete'")
def lww_tombstones(spark, sf_dir):
    return changes.latest(item_log(spark, sf_dir), "id").filter("op = 'delete'")


@query(f"SELECT id, op, value, ttl, ts, origin FROM {WON} WHERE ttl IS NULL OR ttl >= {THEN} - 7200")
def ttl_purged(spark, sf_dir):
    return changes.purged(changes.latest(item_log(spark, sf_dir), "id"), THEN)


@query(f"SELECT id, value, ttl FROM {EVENTS} WHERE {LIVE} AND ttl IS NOT NULL")
def ttl_live(spark, sf_dir):
    return event_rows(spark, sf_dir).filter(changes.live(NOW) & F.col("ttl").isNotNull()).select("id", "value", "ttl")


@query(f"SELECT id, op, value, ttl, ts, origin FROM {WON}")
def delta_caught_up(spark, sf_dir):
    log = item_log(spark, sf_dir)
    early = log.filter(F.col("ts") < THEN)
    return changes.caught_up(early, log.filter(F.col("ts") >= THEN), "id")


@query("""SELECT seq, target, cid FROM (SELECT event_id AS seq, event_type AS target, CAST(event_id AS VARCHAR) AS cid,
 row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events WHERE event_id % 5 <> 0) WHERE rn <= 256""")
def changes_pending(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("target"), F.col("event_id").cast("string").alias("cid"))
    return changes.pending(e, e.filter("seq % 5 = 0")).select("seq", "target", "cid")


@query("SELECT event_type AS target, CAST(event_id % 1000 AS VARCHAR) AS cid FROM events GROUP BY ALL")
def changes_once(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("target"), (F.col("event_id") % 1000).cast("string").alias("cid"))
    return changes.distinct_changes(e)


@query("SELECT DISTINCT event_type AS p, md5(md5(event_type) || ':' || md5('k' || (user_id % 5))) AS key FROM events")
def shard_keys(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("p"), F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")).alias("k")).distinct()
    return e.select("p", changes.shard_key(F.col("p"), F.col("k")).alias("key"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on three replicas: one lacks every tenth, one is behind in every seventh."""
    e = load(spark, sf_dir, "events").withColumn("replica", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter(F.col("event_id") % 10 != F.col("replica"))
    stale = F.col("event_id") % 7 == F.col("replica")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(stale, epoch("ts") - 100).otherwise(epoch("ts")).alias("timestamp"),
        F.when(stale, F.lit('{"k":-1}')).otherwise(F.col("props")).alias("value"),
        "replica",
    )


COPIES = """(SELECT CAST(event_id AS VARCHAR) AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CASE WHEN event_id % 7 = r THEN 100 ELSE 0 END AS timestamp,
 CASE WHEN event_id % 7 = r THEN '{"k":-1}' ELSE props END AS value, r AS replica FROM events, (VALUES (0), (1), (2)) v(r) WHERE event_id % 10 <> r)"""
TOP = f"(SELECT *, first_value(value) OVER w AS tv, first_value(timestamp) OVER w AS tt FROM {COPIES} WINDOW w AS (PARTITION BY id ORDER BY timestamp DESC, replica))"


@query(f"SELECT id, tt AS timestamp, tv AS value FROM {TOP} GROUP BY id, tt, tv HAVING count(*) FILTER (WHERE value = tv) >= 2")
def quorum_rows(spark, sf_dir):
    return quorum.merged_rows(copies(spark, sf_dir), 2)


@query(f"SELECT id, tt AS timestamp, tv AS value FROM {TOP} GROUP BY id, tt, tv HAVING count(*) FILTER (WHERE value = tv) >= 2")
def quorum_repeated_replies(spark, sf_dir):
    """Every reply comes twice, and still counts once."""
    once = copies(spark, sf_dir)
    return quorum.merged_rows(once.unionByName(once), 2)


@query(f"SELECT id FROM {COPIES} GROUP BY id HAVING count(DISTINCT replica) >= 3")
def quorum_ids(spark, sf_dir):
    return quorum.merged_ids(copies(spark, sf_dir), 3)


@query(f"""SELECT id, CASE WHEN 3 - answers >= 2 THEN 'absent' WHEN best IS NULL THEN 'undecided' ELSE 'found' END AS outcome,
 CASE WHEN 3 - answers < 2 THEN best.t END AS timestamp, CASE WHEN 3 - answers < 2 THEN best.v END AS value FROM (
 SELECT id, CAST(sum(n) AS BIGINT) AS answers, max(CASE WHEN n >= 2 THEN {{'t': t, 'v': value}} END) AS best FROM
 (SELECT id, value, count(DISTINCT replica) AS n, max(timestamp) AS t FROM {COPIES} GROUP BY id, value) GROUP BY id)""")
def quorum_get(spark, sf_dir):
    return quorum.read_keys(copies(spark, sf_dir), 3, 2)


@query("""SELECT cid, acked, acked >= 2 AS accepted FROM (SELECT CAST(event_id AS VARCHAR) AS cid,
 CAST((event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT AS BIGINT) AS acked FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0)""")
def quorum_write(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    acks = e.select(F.col("event_id").cast("string").alias("cid"), F.explode(F.array_compact(F.array(*[F.when(F.col("event_id") % p == 0, n) for p, n in ((2, "n1"), (3, "n2"), (5, "n3"))]))).alias("node"))
    nodes = spark.createDataFrame([(n, True) for n in NODES], "node string, online boolean")
    return quorum.write_decision(nodes, acks, 3)


@query("SELECT md5(value) AS print, count(*) AS n FROM (SELECT props AS value FROM events) GROUP BY md5(value)")
def value_fingerprints(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(quorum.fingerprint(F.col("props")).alias("print")).agg(F.count("*").alias("n"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.md5(F.col("c_name").cast("binary")).alias("key"))


def _slice(n: int) -> str:
    return f"least(CAST(('0x' || substr(key, 1, 8)) AS BIGINT) // {(1 << 32) // n}, {n - 1})"


SHARDS = "(SELECT md5(c_name) AS key FROM customer)"


@query(f"SELECT key, 'n' || ({_slice(3)} + 1) AS owner FROM {SHARDS}")
def placement_owners(spark, sf_dir):
    return placement.owners(shards(spark, sf_dir), NODES)


@query(f"SELECT key, p AS place, 'n' || (({_slice(3)} + p) % 3 + 1) AS node FROM {SHARDS}, (VALUES (0), (1)) v(p)")
def placement_holders(spark, sf_dir):
    return placement.holders(shards(spark, sf_dir), NODES, 2)


@query(f"""WITH o AS (SELECT key, 'n' || (({_slice(3)} + p) % 3 + 1) AS node FROM {SHARDS}, (VALUES (0), (1)) v(p)),
 a AS (SELECT key, 'n' || (({_slice(4)} + p) % 4 + 1) AS node FROM {SHARDS}, (VALUES (0), (1)) v(p))
 SELECT key, node, 'copy' AS action FROM (SELECT * FROM a EXCEPT SELECT * FROM o) UNION ALL SELECT key, node, 'drop' FROM (SELECT * FROM o EXCEPT SELECT * FROM a)""")
def rebalance_moves(spark, sf_dir):
    return placement.moves(shards(spark, sf_dir), NODES, [*NODES, "n4"], 2)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as others last saw them."""
    s = load(spark, sf_dir, "events")
    return s.select(F.concat(F.lit("n"), (F.col("user_id") % 9).cast("string")).alias("node"), epoch("ts").alias("last_seen"), (F.col("event_id") % 4).alias("compliant"), (F.col("event_id") % 2500 == 7).alias("removed"))


VIEWS = "(SELECT 'n' || (user_id % 9) AS node, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS last_seen, event_id % 4 AS compliant, event_id % 2500 = 7 AS removed FROM events)"


@query(f"SELECT node, max(last_seen) AS last_seen, max(compliant) AS compliant, bool_or(removed) AS removed FROM {VIEWS} GROUP BY node")
def gossip_merged(spark, sf_dir):
    return placement.gossip(views(spark, sf_dir))


@query(f"SELECT min(node) AS leader FROM (SELECT node FROM {VIEWS} GROUP BY node HAVING max(last_seen) >= {NOW})")
def leader_elected(spark, sf_dir):
    seen = placement.gossip(views(spark, sf_dir)).withColumn("online", F.col("last_seen") >= NOW)
    return placement.leader(seen)


@query("SELECT user_id AS generation, event_id AS node FROM events WHERE user_id = (SELECT max(user_id) FROM events)")
def ranges_newest(spark, sf_dir):
    return placement.newest_ranges(load(spark, sf_dir, "events").select(F.col("user_id").alias("generation"), F.col("event_id").alias("node")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node snapshots made of events: a node is a day's hour."""
    e = load(spark, sf_dir, "events")
    base = e.groupBy((F.col("event_id") % 24).alias("h"), "event_type", (F.col("user_id") % 4).alias("u")).agg(
        F.count("*").alias("n"), F.sum(F.floor(F.abs("value"))).cast("bigint").alias("us"), F.max("event_id").alias("m")
    )
    shard = F.struct(
        F.col("event_type").alias("partition"), F.concat(F.lit("k"), F.col("u").cast("string")).alias("keyspace"), F.col("n").alias("reads"), (F.col("n") * 2).alias("writes"),
        F.lit(0).cast("bigint").alias("updates"), F.lit(1).cast("bigint").alias("deletes"), F.col("us").alias("read_us"), (F.col("us") * 3).alias("write_us"), F.col("m").alias("size_bytes"),
    )
    slow = F.struct(F.lit("query").alias("kind"), F.col("event_type").alias("partition"), F.concat(F.lit("k"), F.col("u").cast("string")).alias("keyspace"), F.lit("a,b").alias("filter"), F.col("n").alias("count"), F.col("us").alias("total_us"), F.col("m").alias("max_us"))
    return base.groupBy(F.concat(F.lit("n"), F.col("h").cast("string")).alias("node")).agg(
        F.lit(NOW).alias("ts"), F.collect_list(shard).alias("shards"), F.collect_list(slow).alias("slow"), F.struct(F.sum("n").alias("pending_changes")).alias("cluster")
    )


SNAPSHOT = "(SELECT event_id % 24 AS h, event_type AS partition, 'k' || (user_id % 4) AS keyspace, count(*) AS n, CAST(sum(floor(abs(value))) AS BIGINT) AS us, max(event_id) AS m FROM events GROUP BY ALL)"
TOTALS = f"""(SELECT partition, keyspace, CAST(sum(n) AS BIGINT) AS reads, CAST(sum(n * 2) AS BIGINT) AS writes, CAST(0 AS BIGINT) AS updates, count(*) AS deletes, CAST(sum(us) AS BIGINT) AS read_us,
 CAST(sum(us * 3) AS BIGINT) AS write_us, max(m) AS size_bytes, sum(us) / sum(n) / 1000.0 AS read_ms, sum(us * 3) / sum(n * 2) / 1000.0 AS write_ms FROM {SNAPSHOT} GROUP BY partition, keyspace)"""


@query(f"SELECT * FROM {TOTALS}")
def analytics_shards(spark, sf_dir):
    return analytics.shard_totals(analytics.newest(snapshots(spark, sf_dir), NOW))


@query(f"SELECT 'query' AS kind, partition, keyspace, 'a,b' AS filter, CAST(sum(n) AS BIGINT) AS count, CAST(sum(us) AS BIGINT) AS total_us, max(m) AS max_us FROM {SNAPSHOT} GROUP BY partition, keyspace")
def analytics_slow(spark, sf_dir):
    return analytics.slow_totals(analytics.newest(snapshots(spark, sf_dir), NOW))


@query(f"SELECT * FROM {TOTALS} ORDER BY size_bytes DESC, partition, keyspace LIMIT 10")
def analytics_largest(spark, sf_dir):
    return analytics.largest(analytics.shard_totals(analytics.newest(snapshots(spark, sf_dir), NOW)))


@query(f"SELECT 'query' AS kind, partition, keyspace, 'a,b' AS filter, CAST(sum(n) AS BIGINT) AS count, CAST(sum(us) AS BIGINT) AS total_us, max(m) AS max_us FROM {SNAPSHOT} GROUP BY partition, keyspace ORDER BY max_us DESC, partition, keyspace LIMIT 10")
def analytics_slowest(spark, sf_dir):
    return analytics.slowest(analytics.slow_totals(analytics.newest(snapshots(spark, sf_dir), NOW)))


@query("SELECT CAST(count(*) AS BIGINT) AS pending_changes FROM events")
def analytics_pending(spark, sf_dir):
    return analytics.pending_total(analytics.newest(snapshots(spark, sf_dir), NOW))


@query("SELECT DISTINCT array_to_string(list_sort([event_type, 'm', 'k' || (user_id % 3)]), ',') AS label FROM events")
def analytics_filter_labels(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(analytics.filter_label(F.array("event_type", F.lit("m"), F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")))).alias("label")).distinct()


@query("SELECT event_id, CAST(floor(round(event_id / (user_id % 3 + 1)) / (user_id % 2 + 1)) AS BIGINT) AS us FROM events")
def analytics_attributed(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", analytics.attributed(F.col("event_id"), F.col("user_id") % 3 + 1, F.col("user_id") % 2 + 1).alias("us"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 8 = 0 OR ((o_custkey % 8) & 5) <> 0")
def permission_masks(spark, sf_dir):
    return load(spark, sf_dir, "orders").filter(security.allowed(F.col("o_custkey") % 8, 5)).select("o_orderkey")


def order_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("id", F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))


DOC = """'{"cust":' || o_custkey || ',"status":"' || o_orderstatus || '"}'"""


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {DOC} AS value FROM orders UNION ALL SELECT 'new' || n_nationkey, '{{\"cust\":' || n_nationkey || ',\"status\":\"N\"}}' FROM nation")
def dml_insert(spark, sf_dir):
    base = order_relation(spark, sf_dir)
    new = load(spark, sf_dir, "nation").select(F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("cust"), F.lit("N").alias("status"))
    return dml.applied(base, dml.insert(base, new, NOW))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, '{"cust":' || (o_custkey + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) || ',"status":"' || o_orderstatus || '"}' AS value FROM orders""")
def dml_update(spark, sf_dir):
    base = order_relation(spark, sf_dir)
    return dml.applied(base, dml.update(base, {"cust": "cust + 1"}, "status = 'F'", NOW))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN '{{"cust":' || o_custkey || ',"status":"F","band":"old","gone":null}}' ELSE {DOC} END AS value FROM orders""")
def dml_update_new_columns(spark, sf_dir):
    base = order_relation(spark, sf_dir)
    return dml.applied(base, dml.update(base, {"band": F.lit("old"), "gone": F.lit(None).cast("string")}, "status = 'F'", NOW))


@query(f"SELECT CASE WHEN o_orderkey < 50 THEN 'moved' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS id, {DOC} AS value FROM orders")
def dml_rename(spark, sf_dir):
    base = order_relation(spark, sf_dir)
    return dml.applied(base, dml.update(base, {"id": "concat('moved', id)"}, "try_cast(id as bigint) < 50", NOW))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {DOC} AS value FROM orders WHERE o_orderstatus <> 'F'")
def dml_delete(spark, sf_dir):
    base = order_relation(spark, sf_dir)
    return dml.applied(base, dml.delete(base, "status = 'F'", NOW))


@query(f"SELECT 'delete' AS op, CAST(o_orderkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS ttl, CAST({NOW} AS BIGINT) AS ts FROM orders WHERE o_custkey % 10 = 0")
def dml_delete_changes(spark, sf_dir):
    return dml.delete(order_relation(spark, sf_dir), "cust % 10 = 0", NOW)


@query("""SELECT id, _keyspace, value FROM (SELECT CAST(r_regionkey AS VARCHAR) AS id, 'region' AS _keyspace, '{"name":"X"}' AS value FROM region WHERE r_regionkey > 2
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'nation', '{"name":"X"}' FROM nation WHERE n_nationkey > 2)""")
def dml_partition_update(spark, sf_dir):
    r = load(spark, sf_dir, "region").select("id", F.col("r_name").alias("name"))
    n = load(spark, sf_dir, "nation").select("id", F.col("n_name").alias("name"))
    return dml.update(keyspace.union({"region": r, "nation": n}), {"name": F.lit("X")}, "cast(id as int) > 2", NOW).select("id", "_keyspace", "value")


def _stamp(entity, key, ctx):
    return {**entity, "seen": ctx.now, "id": key}


def _veto(entity, key, ctx):
    if entity.get("k", 0) > 90:
        ctx.rollback("too large")


def _audit(entity, key, ctx):
    if entity.get("k", 0) % 10 == 0:
        ctx.put("audit", "writes", f"a{key}", {"k": entity["k"]})


@query("""SELECT CAST(event_id AS VARCHAR) AS id, '{"k":' || json_extract(props, '$.k') || ',"seen":7}' AS value, CAST(NULL AS VARCHAR) AS veto FROM events""")
def trigger_before_rewrites(spark, sf_dir):
    return triggers.before(event_rows(spark, sf_dir), [_stamp], 7)


@query(f"SELECT id, CASE WHEN k > 90 THEN 'too large' END AS veto FROM {EVENTS}")
def trigger_before_vetoes(spark, sf_dir):
    return triggers.before(event_rows(spark, sf_dir), [_veto], 7).select("id", "veto")


@query(f"""SELECT 'audit' AS partition, 'writes' AS keyspace, 'a' || id AS id, 'put' AS op, '{{"k":' || k || '}}' AS value FROM {EVENTS} WHERE k % 10 = 0""")
def trigger_after_audits(spark, sf_dir):
    return triggers.after(event_rows(spark, sf_dir), [_audit], 7)


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, length(p_name) AS len, trim(p_name) AS trimmed, replace(p_name, '1', 'one') AS swapped, instr(p_name, 'a') AS at,
 substr(p_name, 2, 3) AS mid, substr(p_name, -3) AS tail, hex(p_name) AS hexed, unicode(p_name) AS code, '''' || replace(p_name, '''', '''''') || '''' AS quoted, substr(p_name, 1, 2) AS from_zero FROM part""")
def functions_text(spark, sf_dir):
    x = F.col("p_name")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.upper(x).alias("up"), F.lower(x).alias("low"), F.length(x).alias("len"), F.trim(x).alias("trimmed"), F.replace(x, F.lit("1"), F.lit("one")).alias("swapped"),
        F.instr(x, "a").alias("at"), compat.substr(x, 2, 3).alias("mid"), compat.substr(x, -3).alias("tail"), F.hex(x).alias("hexed"), compat.unicode(x).alias("code"),
        compat.quote(x).alias("quoted"), compat.substr(x, 0, 3).alias("from_zero"),
    )


@query("""SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INT) AS s, round(c_acctbal, 1) AS r, greatest(c_acctbal, 100.0) AS most, least(c_acctbal, 100.0) AS least,
 coalesce(NULL, c_nationkey) AS c, nullif(c_nationkey, 3) AS n, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS i, c_nationkey // 4 AS d, c_nationkey % 4 AS m, CAST(NULL AS DOUBLE) AS none FROM customer""")
def functions_numbers(spark, sf_dir):
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.abs(b).alias("a"), compat.sign(b).alias("s"), compat.rounded(b, 1).alias("r"), compat.maximum(b, F.lit(100.0)).alias("most"), compat.minimum(b, F.lit(100.0)).alias("least"),
        F.coalesce(F.lit(None).cast("int"), n).alias("c"), F.nullif(n, F.lit(3)).alias("n"), F.when(b > 0, "in").otherwise("out").alias("i"), compat.divide(n, F.lit(4), True).cast("int").alias("d"),
        compat.modulo(n, F.lit(4)).alias("m"), compat.maximum(b, F.lit(None).cast("double")).alias("none"),
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS clock, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch, round(epoch(date_trunc('second', ts)) / 86400.0 + 2440587.5, 6) AS julian,
 CAST(date_trunc('month', ts) AS DATE) AS month, CAST(date_trunc('month', ts) AS DATE) + INTERVAL 1 MONTH + INTERVAL (day(ts) - 1) DAY AS later, CAST(date_trunc('day', ts) AS DATE) + INTERVAL ((7 + 1 - dayofweek(ts)) % 7) DAY AS monday FROM events""")
def functions_dates(spark, sf_dir):
    t = F.col("ts")
    ntz = lambda x: x.cast("date").cast("timestamp_ntz")
    return load(spark, sf_dir, "events").select(
        "event_id", compat.strftime("%Y-%m-%d", t).alias("day"), compat.strftime("%H:%M:%S", t).alias("clock"), epoch("ts").alias("epoch"), F.round(epoch("ts") / 86400.0 + 2440587.5, 6).alias("julian"),
        compat.start_of(t, "month").cast("date").alias("month"), ntz(compat.add_months(t, 1)).alias("later"), ntz(compat.next_weekday(t, 1)).alias("monday"),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, 'integer' AS kind, true AS valid, '{"k":' || json_extract(props, '$.k') || ',"type":"' || event_type || '"}' AS body, '[' || event_id || ',' || user_id || ']' AS pair FROM events""")
def functions_json(spark, sf_dir):
    p = F.col("props")
    return load(spark, sf_dir, "events").select(
        "event_id", compat.json_extract(p, "$.k").alias("k"), compat.typeof(p, "$.k").alias("kind"), compat.json_valid(p).alias("valid"),
        F.to_json(F.struct(F.get_json_object(p, "$.k").cast("int").alias("k"), F.col("event_type").alias("type"))).alias("body"), F.to_json(F.array("event_id", "user_id")).alias("pair"),
    )


@query("""SELECT p_partkey, printf('%05d/%s', p_size, p_brand) AS form, p_name || p_brand AS both, chr(65) || chr(98) AS made, p_size // 4 AS whole, '"' || p_brand || '"' AS quoted,
 lower(p_name) LIKE '%a%' AS has_a, 2 AS members FROM part""")
def functions_more_text(spark, sf_dir):
    b, n = F.col("p_brand"), F.col("p_size")
    return load(spark, sf_dir, "part").select(
        "p_partkey", compat.printf("%05d/%s", n, b).alias("form"), compat.concat(F.col("p_name"), F.lit(None), b).alias("both"), compat.char(65, 98).alias("made"),
        compat.divide(n, F.lit(4), True).cast("int").alias("whole"), compat.json_quote(b).alias("quoted"), compat.like(F.col("p_name"), "%A%").alias("has_a"),
        compat.json_array_length(F.to_json(F.array(n, n))).alias("members"),
    )


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#[1-3]$') AS g, regexp_matches(p_type, '^.*A.$') AS h, coalesce(TRY_CAST(regexp_extract(p_brand || '9', '^(\\d+)', 1) AS BIGINT), 0) AS i FROM part")
def functions_patterns(spark, sf_dir):
    return load(spark, sf_dir, "part").select(
        "p_partkey", compat.glob(F.col("p_brand"), "Brand#[1-3]").alias("g"), compat.glob(F.col("p_type"), "*A?").alias("h"), compat.cast_integer(F.concat("p_brand", F.lit("9"))).alias("i")
    )


@query("""SELECT n_regionkey, coalesce(sum(CAST(n_nationkey AS DOUBLE)), 0.0) AS total, string_agg(n_name, ';' ORDER BY n_name) AS names, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS keys,
 '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS pairs FROM nation GROUP BY n_regionkey""")
def functions_groups(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return n.groupBy("n_regionkey").agg(
        compat.total(F.col("n_nationkey")).alias("total"), compat.group_concat(F.col("n_name"), ";").alias("names"), compat.group_array(F.col("n_nationkey")).alias("keys"), compat.group_object(F.col("n_name"), F.col("n_nationkey")).alias("pairs")
    )


@query("""SELECT 'writes' AS phase, count(*) AS n, CAST(count(*) AS BIGINT) AS hits FROM orders
UNION ALL SELECT 'gets', count(*), count(*) FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 17 = 0)
UNION ALL SELECT 'queries', 20, CAST(sum(c) AS BIGINT) FROM (SELECT (SELECT count(*) FROM orders WHERE o_custkey % 100 < 10 + 5 * q) AS c FROM range(20) t(q))
UNION ALL SELECT 'updates', count(*), count(*) FROM orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT 'deletes', count(*), 0 FROM orders""")
def workload_phases(spark, sf_dir):
    """The workload's phases as bulk operators: write, get, query, update, delete."""
    o = load(spark, sf_dir, "orders").withColumn("age", F.col("o_custkey") % 100)
    row = lambda phase, n, hits: o.agg(F.lit(phase).alias("phase"), n.cast("bigint").alias("n"), hits.cast("bigint").alias("hits"))
    got = F.count(F.when(F.col("o_orderkey") % 17 == 0, 1))
    asked = sum((F.count(F.when(F.col("age") < 10 + 5 * q, 1)) for q in range(20)), F.lit(0))
    put = F.count(F.when(F.col("o_orderkey") % 13 == 0, 1))
    every = F.count("*")
    rows = [("writes", every, every), ("gets", got, got), ("queries", F.lit(20), asked), ("updates", put, put), ("deletes", every, F.lit(0))]
    first, *rest = [row(*r) for r in rows]
    for r in rest:
        first = first.unionByName(r)
    return first
