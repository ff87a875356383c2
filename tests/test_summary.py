"""Summary of all columns: quartiles, text, nulls, no rows."""

import datetime
import statistics

from conftest import rows
from matchloom.operators import profile as P


def test_numbers_text_and_dates(spark):
    data = [(i % 7 + 0.5, i, f"t{i % 3}", datetime.date(2020, 1, 1 + i)) for i in range(11)] + [(None, 100, None, None)]
    df = spark.createDataFrame(data, "x double, n int, `a.text` string, day date")
    got = {r.column: r for r in P.summary_columns(df).collect()}
    assert list(got) and set(got) == {"x", "n", "a.text", "day"}
    for column, values in (("x", [d[0] for d in data if d[0] is not None]), ("n", [d[1] for d in data])):
        r = got[column]
        assert (r.kind, r["count"], r.nulls) == ("number", len(values), 12 - len(values))
        assert [r.p25, r.p50, r.p75] == statistics.quantiles(values, n=4, method="inclusive")
        assert (r.min, r.max) == (min(values), max(values)) and abs(r.std - statistics.stdev(values)) < 1e-9
    assert (got["a.text"].kind, got["a.text"]["count"], got["a.text"]["first"], got["a.text"]["last"]) == ("text", 11, "t0", "t2")
    assert (got["day"]["first"], got["day"]["last"], got["day"].mean) == ("2020-01-01", "2020-01-11", None)


def test_one_value_in_most_rows_and_no_rows(spark):
    df = spark.range(10_000).selectExpr("CASE WHEN id % 10 < 8 THEN 3.0D ELSE id END AS x", "CAST(NULL AS INT) AS y")
    got = {r.column: r for r in P.summary_columns(df).collect()}
    assert (got["x"].p25, got["x"].p50) == (3.0, 3.0) and got["y"]["count"] == 0 and got["y"].p50 is None
    empty = P.summary_columns(df.where("false"))
    assert rows(empty.select("column", "count", "p50")) == [("x", 0, None), ("y", 0, None)]
    assert P.summary_columns(df.selectExpr("'a' AS t")).first()["last"] == "a"
