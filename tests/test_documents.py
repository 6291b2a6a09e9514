import itertools
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import compat
from docloom.operators import analytics, changes, dml, keyspace, placement, quorum, security, triggers
from docloom.operators.catalog import Catalog, StatementError
from docloom.sources import results, storage
from docloom.streaming import changelog

STAFF = [("emp001", "Ada", 36, "mgr01"), ("emp002", "Grace", 45, "mgr02"), ("emp003", "Alan", 29, "mgr01"), ("emp004", "Edsger", 41, "mgr01"), ("emp005", "Barbara", 33, "mgr02"),
         ("emp006", "Dennis", 38, "mgr01"), ("emp007", "Radia", 47, "mgr03"), ("emp008", "Linus", 25, "mgr01"), ("emp009", "Margaret", 60, "mgr03"), ("emp010", "Niklaus", 31, "mgr02")]


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame(STAFF, "id string, name string, age bigint, manager string").cache()


@pytest.fixture(scope="module")
def catalog(spark, staff):
    c = Catalog(spark)
    c.ensure("demo", "people", "employees", lambda: staff)
    c.ensure("demo", "people", "managers", lambda: spark.createDataFrame([("mgr01", "Joan", "eng"), ("mgr02", "Mia", "ops"), ("mgr03", "Kay", "eng")], "id string, name string, dept string"))
    c.ensure("demo", "people", "contractors", lambda: spark.createDataFrame([(f"con00{i}", f"C{i}", "v", i) for i in range(1, 6)], "id string, name string, vendor string, rate bigint"))
    c.ensure("demo", "people", "ghosts", lambda: spark.createDataFrame([], "id string, name string"))
    c.ensure("demo", "ops", "projects", lambda: spark.createDataFrame([("p1", "Atlas", "mgr01", True), ("p2", "Borealis", "mgr02", True), ("p3", "Cygnus", "mgr03", False)], "id string, title string, lead string, active boolean"))
    return c


@pytest.mark.parametrize(("sql", "rows"), [
    ("SELECT COUNT(*) FROM {demo.people.employees} WHERE manager='mgr01'", [(5,)]),
    ("SELECT SUM(age) FROM {demo.people.employees}", [(385,)]),
    ("SELECT manager FROM {demo.people.employees} GROUP BY manager HAVING COUNT(*) >= 4", [("mgr01",)]),
    ("SELECT e.id FROM {demo.people.employees} e LEFT JOIN {demo.people.ghosts} m ON e.id = m.id WHERE m.id IS NULL ORDER BY e.id LIMIT 2", [("emp001",), ("emp002",)]),
    ("SELECT upper(name) AS u FROM {demo.people.employees} WHERE name IN ('Ada','Alan') AND age BETWEEN 30 AND 36", [("ADA",)]),
    ("SELECT COUNT(*) FROM {demo.people}", [(18,)]),
    ("SELECT p.title, m.name FROM {demo.ops.projects} p JOIN {demo.people.managers} m ON p.lead = m.id WHERE p.active = 1 ORDER BY 1", [("Atlas", "Joan"), ("Borealis", "Mia")]),
])
def test_statements(catalog, sql, rows):
    assert [tuple(r) for r in catalog.sql(sql).collect()] == rows


def test_statement_errors(catalog):
    for bad in ("DELETE FROM {demo.people.employees}", "SELECT 1", "SELECT * FROM {demo.people.none}", "SELECT * FROM {demo}", "DROP TABLE {demo.people.employees}"):
        with pytest.raises(StatementError):
            catalog.sql(bad)


def test_permissions(catalog):
    catalog.set_masks("demo", "ops", read=6)
    try:
        with pytest.raises(security.Denied):
            catalog.sql("SELECT * FROM {demo.ops.projects} p JOIN {demo.people.managers} m ON p.lead = m.id", groups=8)
        assert catalog.sql("SELECT * FROM {demo.ops.projects}", groups=2).count() == 3
    finally:
        catalog.set_masks("demo", "ops", read=0)
    assert security.next_group_bit([1, 2, 4]) == 3
    with pytest.raises(ValueError):
        security.next_group_bit(range(1, 64))


def test_catalog_entities(spark):
    c = Catalog(spark)
    c.create_database("a", 3)
    with pytest.raises(ValueError):
        c.create_database("a")
    c.ensure("a", "p", "k", lambda: spark.range(1))
    assert c.partitions("a") == ["a.p"] and c.keyspaces() == [("a", "p", "k")]
    c.drop_database("a")
    assert not c.databases() and not c.partitions() and not c.keyspaces()


def test_dml(spark, staff):
    gone = dml.delete(staff, "id IN ('emp002','emp005')", 9)
    assert dml.summary(gone, "DELETE")["count"] == 2
    assert dml.delete(staff, "id = 'none'", 9).count() == 0
    older = dml.update(staff, {"age": "age + 1"}, "manager = 'mgr01'", 9)
    assert older.count() == 5
    assert json.loads(older.filter("id = 'emp001'").head()["value"])["age"] == 37
    moved = dml.update(staff, {"id": F.lit("emp001b")}, "id = 'emp001'", 9)
    assert sorted((r["op"], r["id"]) for r in moved.collect()) == [("delete", "emp001"), ("put", "emp001b")]
    banded = dml.update(staff, {"score": "age + 1", "band": "CASE WHEN age > 40 THEN 'senior' ELSE 'junior' END"}, "id = 'emp004'", 9).head()["value"]
    assert json.loads(banded)["score"] == 42 and json.loads(banded)["band"] == "senior"
    assert '"score":null' in dml.update(staff, {"score": F.lit(None).cast("string")}, "id = 'emp004'", 9).head()["value"]
    new = spark.createDataFrame([("fresh1", "F"), ("emp001", "dup")], "id string, name string")
    with pytest.raises(dml.Conflict):
        dml.insert(staff, new, 9)
    assert dml.insert(staff, new, 9, replace=True).count() == 2
    with pytest.raises(ValueError):
        dml.insert(keyspace.union({"e": staff}), new, 9)


CHANGE = st.tuples(st.sampled_from(["put", "delete"]), st.sampled_from("xyz"), st.integers(0, 5), st.integers(0, 4), st.sampled_from(["n1", "n2"]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(CHANGE, max_size=12))
def test_last_write_wins_whatever_the_order(spark, log):
    schema = "op string, id string, value string, ttl bigint, ts bigint, origin string"
    rows = [(op, k, str(v), None, ts, o) for op, k, v, ts, o in log]
    once = spark.createDataFrame(rows, schema)
    again = spark.createDataFrame(rows[::-1] + rows[:3], schema)
    result = lambda df: sorted(map(repr, changes.latest(df, "id").collect()))
    assert result(once) == result(again) == sorted(map(repr, changes.latest(changes.latest(once, "id").select(once.columns), "id").collect())) or any(op == "delete" for op, *_ in log)


def test_expiry_and_tombstones(spark):
    log = spark.createDataFrame([("put", "a", "1", None, 10, "n1"), ("delete", "a", None, None, 12, "n1"), ("put", "b", "2", 15, 10, "n1"), ("put", "c", "3", None, 11, "n1"), ("put", "c", "4", None, 11, "n2")], "op string, id string, value string, ttl bigint, ts bigint, origin string")
    assert sorted((r["id"], r["value"]) for r in changes.current(log, 15, "id").collect()) == [("b", "2"), ("c", "4")]
    assert sorted(r["id"] for r in changes.current(log, 16, "id").collect()) == ["c"]
    dead = changes.latest(log, "id").filter("id = 'a'").head()
    assert dead["ttl"] == 7 and dead["value"] is None
    assert changes.purged(changes.latest(log, "id"), 7 + 7201).filter("id = 'a'").count() == 0


def test_quorum(spark):
    rows = [("a", 5, "x", 0), ("a", 5, "x", 1), ("a", 4, "old", 2), ("b", 9, "new", 0), ("b", 3, "y", 1), ("b", 3, "y", 2), ("c", 1, "z", 0)]
    c = spark.createDataFrame(rows, "id string, timestamp bigint, value string, replica int")
    assert [tuple(r) for r in quorum.merged_rows(c, 2).collect()] == [("a", 5, "x")]
    assert sorted(r["id"] for r in quorum.merged_ids(c, 2).collect()) == ["a", "b"]
    found = {r["id"]: (r["outcome"], r["value"]) for r in quorum.read_keys(c, 3, 2).collect()}
    assert found == {"a": ("found", "x"), "b": ("found", "y"), "c": ("absent", None)}


def test_placement(spark):
    nodes = ["b", "a", "c"]
    spans = placement.ranges(nodes)
    assert [s[0] for s in spans] == ["a", "b", "c"] and spans[-1][2] == "f" * 32
    keys = spark.createDataFrame([(s[i],) for s in spans for i in (1, 2)], "key string")
    owned = {(r["key"], r["owner"]) for r in placement.owners(keys, nodes).collect()}
    assert owned == {(s[i], s[0]) for s in spans for i in (1, 2)}
    assert placement.holders(keys, nodes, 2).count() == 12


def test_triggers(spark):
    rows = spark.createDataFrame([("a", '{"n":1}'), ("b", '{"n":2}')], "id string, value string")

    def double(e, k, ctx):
        if e["n"] == 2:
            ctx.rollback("no twos")
        return {**e, "n": e["n"] * 2, "seen": ctx.get("p", "k", "z")["v"]}

    def broken(e, k, ctx):
        raise KeyError("x")

    reg = triggers.Triggers()
    reg.on("d", "p", "k", "beforeInsert", double)
    with pytest.raises(ValueError):
        reg.on("d", "p", "k", "whenever", double)
    look = spark.createDataFrame([("p", "k", "z", '{"v":7}')], "partition string, keyspace string, id string, value string")
    out = {r["id"]: (r["value"], r["veto"]) for r in triggers.before(rows, reg.handlers("d", "p", "k", "beforeInsert"), 1, look).collect()}
    assert json.loads(out["a"][0]) == {"n": 2, "seen": 7} and out["b"][1] == "no twos"
    assert all(r["veto"].startswith("handler error") for r in triggers.before(rows, [broken], 1).collect())

    def audit(e, k, ctx):
        ctx.put("p", "audit", k, {"id": k, "n": e["n"]})
        ctx.remove("p", "k", k)

    assert triggers.after(rows, [audit, broken], 1).count() == 4


def test_storage(spark, tmp_path):
    log = storage.ChangeLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    schema = "op string, db string, partition string, keyspace string, id string, value string, ttl bigint, ts bigint, origin string, cid string"
    log.append(spark.createDataFrame([("put", "d", "p", "k", f"i{i}", "{}", None, 1, "n", f"c{i}") for i in range(9)], schema))
    log.append(spark.createDataFrame([("delete", "d", "p", "k", "i3", None, None, 2, "n", "c9")], schema))
    assert log.state(5).count() == 8
    log.compacted(str(tmp_path / "compact"), 5)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 9
    state = log.state(5)
    storage.backup({"k": state, "__system__": state}, str(tmp_path / "b"))
    back = storage.restore_all(spark, ["k"], str(tmp_path / "b"), str(tmp_path / "r"))
    assert sorted(back["k"].collect()) == sorted(state.select(back["k"].columns).collect())
    state.limit(1).write.mode("append").parquet(str(tmp_path / "b/k/data"))
    with pytest.raises(storage.IntegrityError):
        storage.restore(spark, str(tmp_path / "b/k"), str(tmp_path / "r2"))


def test_streaming_state_equals_batch(spark, tmp_path):
    log = storage.ChangeLog(spark, str(tmp_path / "log"))
    schema = "op string, db string, partition string, keyspace string, id string, value string, ttl bigint, ts bigint, origin string, cid string"
    rows = [("put" if i % 4 else "delete", "d", "p", "k", f"i{i % 5}", str(i), None, (i * 7) % 11, "n", f"c{i}") for i in range(20)]
    for part in itertools.batched(rows, 10):
        log.append(spark.createDataFrame(list(part), schema))
        changelog.keep_state(changelog.read(spark, log.path), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "state/state-1"))
    key = lambda df: sorted(map(repr, df.select("id", "op", "value", "ts").collect()))
    assert key(last) == key(changes.latest(log.read()))
    counts = changelog.write_counts(changelog.once_per_change(changelog.read(spark, log.path)))
    assert "op" in counts.columns and counts.isStreaming


def test_results(spark):
    df = spark.createDataFrame([(1, "a\"b", None, bytearray(b"\x01\xff"))], "n int, s string, z string, b binary")
    assert json.loads(results.envelope(df)) == {"columns": ["n", "s", "z", "b"], "rows": [[1, 'a"b', None, "01ff"]], "status": "ok"}
    assert results.table(df).splitlines()[0].startswith("n | s")


def test_compat(spark):
    one = spark.range(1)
    text = F.lit("hello")
    got = one.select(
        compat.substr(text, 0, 3), compat.substr(text, -3, 2), compat.substr(text, -9, 6), compat.glob(text, "h[a-e]*o"), compat.glob(text, "H*"), compat.cast_integer(F.lit("12abc")), compat.cast_integer(F.lit("x")), compat.cast_real(F.lit("1.5e1z")),
        compat.maximum(F.lit(1), F.lit(None).cast("int")), compat.divide(F.lit(-7), F.lit(2), True), compat.divide(F.lit(1), F.lit(0), False), compat.modulo(F.lit(-7), F.lit(3)),
        compat.add_months(F.lit("2024-01-31").cast("date"), 1).cast("string"), compat.json_patch(F.lit('{"a":1,"b":2}'), F.lit('{"b":null,"c":3}')), compat.json_remove(F.lit('{"a":1,"b":2}'), "a"), compat.json_set(F.lit('{"a":1}'), "a", F.lit(5)), compat.quote(F.lit("it's")),
    ).head()
    assert list(got) == ["he", "ll", "he", True, False, 12, 0, 15.0, None, -3, None, -1, "2024-03-02", '{"a":1,"c":3}', '{"b":2}', '{"a":5}', "'it''s'"]


def test_analytics(spark):
    row = lambda node, ts, reads: (node, ts, [("p", "k", reads, 0, 0, 0, 4000, 0, 10 * reads)], [], (3,))
    s = spark.createDataFrame([row("a", 100, 2), row("a", 90, 99), row("b", 100, 6), row("c", 1, 50)],
        "node string, ts bigint, shards array<struct<partition:string,keyspace:string,reads:bigint,writes:bigint,updates:bigint,deletes:bigint,read_us:bigint,write_us:bigint,size_bytes:bigint>>, slow array<struct<kind:string,partition:string,keyspace:string,filter:string,count:bigint,total_us:bigint,max_us:bigint>>, cluster struct<pending_changes:bigint>")
    new = analytics.newest(s, 1850)
    r = analytics.shard_totals(new).head()
    assert (r["reads"], r["size_bytes"], r["read_ms"], r["write_ms"]) == (8, 60, 1.0, 0.0)
    assert analytics.pending_total(new).head()[0] == 6


def test_more_functions(spark):
    got = spark.range(1).select(
        compat.printf("%05.1f|%d|%s|%%", F.lit(2), F.lit(3.9), F.lit("x")), compat.timediff(F.lit("2024-01-02 01:00:00"), F.lit("2024-01-01")), compat.json_quote(F.lit('a"b')),
        compat.json_array_length(F.lit('{"a":[1,2]}'), "$.a"), compat.json_array_length(F.lit('{"a":1}'), "$.a"), compat.concat(F.lit("a"), F.lit(None), F.lit(1)),
    ).head()
    assert list(got) == ["002.0|3|x|%", "+0001 01:00:00", '"a\\"b"', 2, 0, "a1"]
    each = compat.json_each(spark.createDataFrame([(1, '{"x":5,"y":[1]}'), (2, "7")], "id int, doc string"), "doc")
    assert sorted((r["id"], r["key"]) for r in each.select("id", "key").collect()) == [(1, "x"), (1, "y")]
    with pytest.raises(ValueError):
        compat.printf("%d")


def test_demo_and_entities(spark, tmp_path):
    from docloom.sources import demo

    state = changes.current(demo.changes(spark, 5), 6)
    assert state.count() == 10
    staff = keyspace.Keyspace(state.filter("keyspace = 'staff'").withColumnRenamed("ts", "timestamp"), 6)
    assert [r["id"] for r in staff.ids([{"key": "lead.id", "operator": "eq", "value": "s1"}]).collect()] == ["s2"]
    assert staff.documents().filter("id = 's3'").head()["document"] == '{"id":"s3","name":"Cleo","age":41,"office":"o1","email":null}'
    state.write.parquet(str(tmp_path / "t"))
    assert storage.size_bytes(spark, str(tmp_path / "t")) > 500
    c = Catalog(spark)
    assert [c.create_group(g) for g in ("a", "b")] == [1, 2]
    c.groups.delete("a")
    assert c.create_group("c") == 1 and [n for n, _ in c.groups.list()] == ["b", "c"]
    c.settings.create("k", v=1)
    c.settings.update("k", v=2)
    assert c.settings.get("k") == {"v": 2} and c.users.get("x") is None
    with pytest.raises(ValueError):
        c.settings.create("k")
