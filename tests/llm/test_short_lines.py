"""Lines below the floor of the edit join have their class as well."""

from docloom.llm import lines, queries


def test_short_lines_have_a_class(spark):
    rows = [(1, "Menu\n你好世界。\n \nonce only"), (2, "menu\n你好世界。\nMenu\n\nMenu"), (3, None), (4, "this line is long enough to take part")]
    got = {(r["doc"], r["line_no"]): r for r in lines.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 3), (2, 0), (2, 1), (2, 2), (2, 4), (4, 0)}
    assert [k for k, r in sorted(got.items()) if not r["first"]] == [(2, 1), (2, 2), (2, 4)]
    assert got[1, 0]["class_id"] == got[2, 2]["class_id"] == got[2, 4]["class_id"] != got[2, 0]["class_id"]


def test_op5_returns_every_line(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\r\x0b\x0c")}
    got = queries.op5_line_dedup(spark, small).select("doc_id", "line_no").collect()
    assert want <= {tuple(r) for r in got} and len(got) == len(set(got))
