"""Operator 1 with nulls in every column, through the registered query."""

import duckdb

from waymark.llm.queries import QUERIES, SQL


def test_chat_format_with_null_ids_turns_roles_and_texts(spark, tmp_path):
    made = [(None, 0, "user", "a <b>"), (None, 1, "assistant", "c"), (None, 2, "user", None), (None, 3, "assistant", "d"), (5, None, "assistant", "last"), (5, 0, "user", "first"), (6, 1, None, "y"), (6, 1, "", "x"), (7, 0, "assistant", None)]
    at = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(made, "conv_id long, turn long, role string, text string").write.parquet(at)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{at}/*.parquet'")
    df = QUERIES["op1_chat_format"](spark, str(tmp_path))
    key = lambda r: str(r[0])
    want = sorted(con.sql(f"select {', '.join(df.columns)} from ({SQL['op1_chat_format']})").fetchall(), key=key)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == want
    assert [r[1] for r in got if r[0] is None] == [4]
