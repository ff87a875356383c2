import duckdb

from matchloom.llm import queries, threads

HELLO = "Hello all,\nthe first line here.\nAnother  line"
ROWS = [
    (1, 0, "user", HELLO),
    (1, 1, "assistant", "> the first line here.\n\nI agree."),
    (1, 2, "user", ">> the first line here.\n> I AGREE.\nAnd I do not.\n"),
    (1, 3, "assistant", "> > the first line here.\n>nothing known\nDeep only"),
    (1, 4, "user", "No quote at all > just a sign"),
    (1, 5, None, "> And I do not.\n> Hello all,\n> another line\ntwo votes"),
    (1, 6, "user", "> two votes"),
    (2, 0, "user", "> the first line here.\nother conversation"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 3, "user", ">"),
    (2, 4, "user", "> later line"),
    (2, 5, "user", "later line"),
    (None, 1, "user", "> later line\nx"),
    (2, None, "user", "later line"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_small_conversations(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("role", "reply")
    result = threads.reply_order(docs, "reply")
    assert result.columns == ["conv_id", "turn", "reply", "text", "reply_"]
    got = {(r.conv_id, r.turn): r for r in result.collect()}
    value = lambda c, t: tuple(got[c, t].reply_)[:4]
    assert value(1, 0) == (None, 0, 0, 1)
    assert value(1, 1) == (0, 0, 1, 2)
    assert value(1, 2) == (1, 0, 2, 5)
    assert value(1, 3) == (0, 0, 1, 3)
    assert value(1, 4) == (None, 4, 0, 7)
    assert value(1, 5) == (0, 0, 1, 4)
    assert value(1, 6) == (5, 0, 2, 6)
    assert got[1, 1].text == "I agree." and got[1, 2].text == "And I do not." and got[1, 6].text == ""
    assert got[1, 4].text == "No quote at all > just a sign" and got[2, 1].text is None
    assert value(2, 4)[0] is None and value(None, 1) == (None, 1, 0, None) and value(2, None)[3] is None
    assert [got[2, t].reply_.position for t in range(6)] == [1, 2, 3, 4, 5, 6]
    assert threads.reply_order(docs.limit(0)).count() == 0


def test_long_chain_equals_sql(spark, tmp_path):
    rows = [(i % 3, i, "user", (f"> said {i - 3}\n" if i > 5 else "") + f"said {i}") for i in range(120)]
    rows += [(7, t, "assistant", "> root\nanswer" if t else "root") for t in range(200)]
    rows += [(7, 1, "assistant", "> root\nanswer")] * 2 + [r for r in ROWS]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    twin = duckdb.connect()
    twin.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    result = queries.QUERIES["op10_quotation_threads"](spark, str(tmp_path))
    want = twin.execute(queries.ORACLES["op10_quotation_threads"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(result.columns)
    assert sorted(map(str, (tuple(r) for r in result.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_quoting_messages(spark, tmp_path):
    said = [(c, t, "user" if t % 2 else "assistant", f"point {c} {t} a\npoint {c} {t} b\npoint {c} {t} c") for c in range(4) for t in range(40)]
    said += [(9, 0, "user", None), (9, 1, "user", "answers nothing"), (9, 2, None, ""), (None, 1, "user", "alone"), (9, None, "user", "alone")]
    docs = spark.createDataFrame(said, SCHEMA)
    made = {(r.conv_id, r.turn): r.text for r in threads.quoting(docs).collect()}
    assert made[0, 0] == said[0][3] and made[9, 0] is None and made[None, 1] == made[9, None] == "alone"
    assert made[0, 1] == "> point 0 0 a\n> point 0 0 c\n" + said[1][3]
    assert any(line.startswith(">>> point 0 ") for line in made[0, 8].split("\n"))
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in queries.QUERIES["op10_quotation_threads"](spark, str(tmp_path)).collect()}
    assert len(got) == len(said)
    for c, t, _, text in said:
        assert got[c, t].text == text
        if c is not None and t and c < 9:
            assert got[c, t].reply_to == t - 1 - (c + t) % min(t, 3) and got[c, t].n_linked == got[c, t].n_quoted > 0
    assert max(r.depth for r in got.values()) > 10 and threads.quoting(docs.limit(0)).count() == 0
