import random

import duckdb
import pytest

from matchloom.llm import quality, queries


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(900):
        words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(12, 80))]
        if i % 40 == 0:
            words = [w + "###" for w in words]
        if i % 55 == 1:
            words = words[:6] * rng.randint(2, 6)
        if i % 70 == 2:
            words = [w.upper() for w in words]
        text = "".join(w + rng.choice("      \n") for w in words)
        if i % 60 == 3:
            text = "\n".join([text] * 2)
        rows.append((i, text, rng.choice(["aa", "aa", "bb", None]), rng.choice(["s0", "s0", "s0", "s1", None])))
    rows += [(1000, None, "aa", "s0"), (1001, "", "aa", "s0"), (1002, " \t\n ", None, None), (1003, "few words", "bb", "s1"), (None, "x " * 30, "zz", "s9")]
    rows += [(1004, "A b c d e f g h i j k", "only", "one")] * 2 + [(1005, " ".join(f"w{k}" for k in range(20_000)), "aa", "s0")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("quality"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").write.parquet(f"{place}/documents.parquet")
    return place


def test_query_equals_sql(spark, folder):
    twin = duckdb.connect()
    twin.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    result = queries.QUERIES["op4_adaptive_quality"](spark, folder)
    want = twin.execute(queries.ORACLES["op4_adaptive_quality"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(result.columns)
    got = sorted(map(str, (tuple(r) for r in result.select(*names).collect())))
    assert got == sorted(map(str, want.fetchall()))
    assert 0 < sum("False)" in g for g in got) < len(got)


def test_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS quality", "2 AS _words", "3 AS g0", "4 AS fence")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.adaptive_rules(docs).columns == [*docs.columns, "quality_"]
    assert quality.keep_good(docs.limit(0)).count() == 0
