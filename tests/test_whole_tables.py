"""The whole-table statements leave no row of their tables out."""

from docloom.plans import registry


def test_whole_tables(spark, small):
    run = lambda name: registry.QUERIES[name](spark, small)
    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    assert run("join_json_each_all").select("event_id").distinct().count() == read("events").filter("props LIKE '{\"%'").count()
    assert run("sql_quoted_identifiers_all").count() == read("customer").count()
    joined = run("join_full_all").cache()
    assert joined.filter("c_custkey IS NOT NULL").count() == read("customer").count()
    assert joined.filter("s_suppkey IS NOT NULL").count() == read("supplier").count()
    assert joined.filter("s_suppkey IS NULL").count() and joined.filter("c_custkey IS NULL").count()
    assert joined.filter("c_custkey IS NOT NULL AND s_suppkey IS NOT NULL").count()
