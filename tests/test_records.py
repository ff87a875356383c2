from datetime import date

import pytest
from pyspark.sql import functions as F

from matchloom.operators import codelists as L
from matchloom.operators import cohort as H
from matchloom.operators import compare as K
from matchloom.operators import joins as J
from matchloom.operators import missing as N
from matchloom.operators import profile as P
from matchloom.operators import reshape as R
from matchloom.operators.assembly import analysis_table, with_dummies, with_interactions
from matchloom.session import broadcast_if_small, ensure_checkpoint_dir, local_table
from matchloom.sources import batches as B
from matchloom.sources import snapshots as S
from matchloom.sources import tables as T
from matchloom.sources.codelist_files import read_codelist_csv
from conftest import rows


def test_local_table_and_size_checked_broadcast(spark):
    df = local_table(spark, [(1, "a", None), (2, None, 1.5)], "i int, s string, x double")
    assert rows(df) == [(1, "a", None), (2, None, 1.5)]
    assert local_table(spark, [], "i int").count() == 0
    hinted = "ResolvedHint"
    assert hinted in broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert hinted not in broadcast_if_small(df, max_bytes=8)._jdf.queryExecution().analyzed().toString()
    assert "checkpoint" in ensure_checkpoint_dir(spark)


def test_wide_to_long(spark):
    df = spark.createDataFrame([(1, "a", None, 5, 6)], "id int, d_01 string, d_02 string, v_01 int, v_03 int")
    assert rows(R.wide_to_long(df.select("id", "d_01", "d_02"), ["id"], "p", "d_")) == [(1, "01", "a"), (1, "02", None)]
    assert rows(R.wide_to_long_multi(df, ["id"], "p", ["d_", "v_"])) == [(1, "01", "a", 5), (1, "02", None, None), (1, "03", None, 6)]
    assert R.columns_matching(df, r"d_\d\d") == ["d_01", "d_02"]


def test_diagnoses(spark):
    df = spark.createDataFrame([(1, "A41", "A41.X", "", None), (2, None, None, "E11", "J100")], "id int, diag_3_01 string, diag_4_01 string, diag_3_12 string, diag_4_12 string")
    assert rows(R.diagnosis_long(df, ["id"])) == [(1, "1", "3", "A41"), (1, "1", "4", "A41"), (2, "12", "3", "E11"), (2, "12", "4", "J100")]
    checks = rows(R.code_consistency(df, ["id"], "diag_3_", "diag_4_"))
    assert checks == [(1, "01", 1, 0), (1, "12", 0, 1), (2, "01", 1, 1), (2, "12", 0, 1)]
    long = R.codes_long(df, ["id"], "diag_3_", "diag_4_")
    assert rows(R.digits_mismatch(long, ["id"])) == [(2, "12", "E11", "J100")]


def test_deaths(spark):
    df = spark.createDataFrame(
        [
            (1, "20200105", "20200104", "I21", "J1-8", None),
            (1, "20200106", "2020017", "I22", "J19", "K10"),
            (1, "20200106", "2020017", "I20", "X", None),
            (2, "20200101", "bad", "I21", "J18", None),
            (None, "20200101", "20200101", "I21", None, None),
        ],
        "person_id int, reg string, died string, cod_underlying string, cod_1 string, cod_2 string",
    )
    one = R.latest_registration(df, "person_id", "reg", "died", "cod_underlying")
    assert rows(one.select("person_id", "reg", "died", "cod_underlying")) == [
        (1, date(2020, 1, 6), date(2020, 1, 7), "I22"), (2, date(2020, 1, 1), None, "I21"),
    ]
    long = R.deaths_long(one.drop("reg"), "person_id", "died", "cod_")
    assert rows(long.select("diag_position", "diag_digits", "code")) == [
        ("SECONDARY_1", "3", "J19"), ("SECONDARY_1", "4", "J19"), ("SECONDARY_2", "3", "K10"), ("SECONDARY_2", "4", "K10"),
        ("UNDERLYING", "3", "I22"), ("UNDERLYING", "4", "I22"),
    ]


def test_operation_dates(spark):
    df = spark.createDataFrame([(1, "d1", "-", "d2", "W37"), (1, "d1", "-", "d2", "W37"), (2, "d3", None, None, "X1")], "id int, opdate_01 string, opertn_01 string, opdate_02 string, opertn_02 string")
    assert rows(R.operation_dates_long(df, ["id"], "opdate_", "opertn_")) == [(1, "02", "d2", "W37"), (2, "02", None, "X1")]


@pytest.fixture
def matched(spark):
    a = spark.sql("select * from values (1, date'2020-01-02', 'A'), (1, date'2020-01-01', 'B'), (2, date'2020-01-01', 'Z') t(person_id, date, code)")
    b = spark.sql("select * from values (1, date'2020-01-01', 'P', 9), (3, date'2020-01-05', 'P', 9) t(person_id, date, code, extra)")
    first = spark.createDataFrame([("n", "A"), ("n", "B"), ("m", "A")], "name string, code string")
    second = spark.createDataFrame([("n", "P")], "name string, code string")
    return L.codelist_match({"one": (a, first, 2), "two": (b, second, 1)})


def test_codelist_match(spark, matched):
    assert rows(matched.select("person_id", "code", "name", "source", "extra")) == [
        (1, "A", "m", "one", None), (1, "A", "n", "one", None), (1, "B", "n", "one", None), (1, "P", "n", "two", 9), (3, "P", "n", "two", 9),
    ]
    first = L.first_match(matched, ["person_id", "name"]).select("person_id", "name", "source", "code")
    assert rows(first) == [(1, "m", "one", "A"), (1, "n", "two", "P"), (3, "n", "two", "P")]
    last = L.first_match(matched, ["person_id"], last=True).select("person_id", "code")
    assert rows(last) == [(1, "A"), (3, "P")]
    wide = L.match_wide(matched, ["n", "m"]).select("person_id", "out_n_flag", "out_n_date", "out_m_flag")
    assert rows(wide) == [(1, 1, date(2020, 1, 1), 1), (3, 1, date(2020, 1, 5), 0)]
    assert rows(L.match_summary(matched)) == [("m", "all", 1, 1), ("m", "one", 1, 1), ("n", "all", 4, 2), ("n", "one", 2, 1), ("n", "two", 2, 2)]
    assert ("n", "P", "two", 2, 2) in rows(L.match_summary(matched, by_code=True))


def test_first_event_before_the_window_decides(spark):
    windows = spark.sql("select * from values (1, date'2020-01-10', date'2020-12-31'), (2, date'2020-01-10', date'2020-01-20') t(person_id, window_start, window_end)")
    records = spark.sql("select * from values (1, date'2020-01-01', 'A'), (1, date'2020-02-01', 'A'), (2, date'2020-01-20', 'A'), (3, date'2020-01-20', 'A') t(person_id, date, code)")
    source = {"s": (records, spark.createDataFrame([("n", "A")], "name string, code string"))}
    assert [r.person_id for r in H.first_event_in_window(windows, source).collect()] == [2]
    late = H.first_event_in_window(windows, source, first_in_window=True)
    assert rows(late.select("person_id", "date")) == [(1, date(2020, 2, 1)), (2, date(2020, 1, 20))]


def test_cohort_rules(spark):
    df = spark.createDataFrame([(1, 1, 1, "M"), (2, 1, 0, "F"), (3, None, 1, "M"), (4, 1, 1, "X")], "id int, a int, b int, sex string")
    rules = {"a": 1, "sex": ["M", "F"], "b": 1}
    assert [r.id for r in H.cohort_inclusion(df, rules).collect()] == [1]
    assert rows(H.attrition(df, rules)) == [(0, "all", 4, 4, 0), (1, "a", 3, 3, 1), (2, "sex", 3, 2, 1), (3, "b", 3, 1, 1)]
    assert rows(H.inclusion_flags(df.select("id", "a"), {"f": F.col("a") > 0}).select("id", "f")) == [(1, 1), (2, 1), (3, 0), (4, 1)]


def test_code_set_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "code string")
    codes = spark.createDataFrame([("a",), ("a",)], "code string")
    assert rows(J.keep_codes(df, codes)) == [("a",)]
    assert rows(J.drop_codes(df, codes)) == [("b",), (None,)]


def test_validated_merge(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, l string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, r string")
    assert rows(J.validated_merge(a, b, ["k"], "1:1", indicator="s")) == [
        (1, "x", "p", "both"), (2, "y", None, "left_only"), (3, None, "q", "right_only"), (None, "n", None, "left_only"),
    ]
    with pytest.raises(J.MergeError):
        J.validated_merge(a, b, ["k"], "1:1", ["both"])
    with pytest.raises(J.MergeError):
        J.validated_merge(a.unionByName(a), b, ["k"], "1:m")
    assert J.validated_merge(a.unionByName(a), b, ["k"], "m:1").count() == 7


def test_codelists(spark):
    labels = spark.createDataFrame([("AB1", "n2"), ("AB2", "n1"), ("AC1", "n3")], "code string, term string")
    ab = L.prefix_codelist(labels, "ab", "BNF", ["AB"])
    extra = spark.createDataFrame([("x", "ICD10", "A41.X", "t", "src")], "name string, terminology string, code string, term string, origin string")
    out = L.build_codelist([ab, extra], excluded=spark.createDataFrame([("AB2",)], "code string"))
    assert rows(out.select("name", "code", "origin")) == [("ab", "AB1", None), ("x", "A41", "src")]
    long_codes = spark.createDataFrame([("1234567000000000",), ("123456789012345",), ("000000000",)], "code string")
    assert rows(L.suspicious_codes(long_codes)) == [("1234567000000000",)]
    assert rows(L.prefix_problems(labels, ["AB", "atenolol"])) == [("atenolol", 0)]
    assert L.code_labels(spark.createDataFrame([("c", "z"), ("c", "a")], "code string, term string"), "code", "term").first().term == "a"
    listed = L.reference_codelist(labels.selectExpr("'old' name", "'T' terminology", "code", "term"), ["old"], {"old": "new"})
    assert {r.name for r in listed.collect()} == {"new"}


def test_codelist_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_bytes("﻿Name,terminology,code,term\nx,SNOMED,123456789012345678,first\n".encode("utf-8"))
    out = read_codelist_csv(spark, str(path))
    assert out.columns == ["name", "terminology", "code", "term"]
    assert out.first().code == "123456789012345678"


def test_snapshots(spark):
    df = spark.createDataFrame([("2020-01-01", 1), ("2020-02-01", 2), ("2020-02-01", 3), ("2020-03-01", 4)], "archived_on string, x int")
    assert tuple(S.latest_snapshot(df, "2020-02-15").first()) == ("2020-02-01", 2)
    assert tuple(S.first_snapshot_after(df, "2020-02-02").first()) == ("2020-03-01", 1)
    registry = S.snapshot_registry(spark.createDataFrame([("d",)], "dataset string"), {"d": df}, "2020-02-01")
    assert S.read_snapshot(registry, df, "d").count() == 2
    with pytest.raises(S.SnapshotError):
        S.read_snapshot(registry, df, "other")
    with pytest.raises(S.SnapshotError):
        S.read_snapshot(registry, df.unionByName(df), "d")
    with pytest.raises(J.MergeError):
        S.snapshot_registry(spark.createDataFrame([("d",), ("e",)], "dataset string"), {"d": df}, "2020-02-01")


def test_saved_tables(spark, tmp_path):
    assert T.save_table(spark.range(3), "Kept_Table") is None
    old = T.save_table(spark.range(5).withColumn("y", F.lit(1)), "kept_table")
    assert old.startswith("kept_table_pre")
    assert (spark.table(old).count(), spark.table("kept_table").count(), spark.table("kept_table").columns) == (3, 5, ["id", "y"])
    assert T.checkpoint_table(spark.range(4), "Stored").count() == 4
    with pytest.raises(ValueError):
        T.normalise_names(spark.createDataFrame([(1, 2)], "a int, A int"))


def test_resume_skips_what_is_stored(spark, tmp_path):
    path, calls = str(tmp_path / "out"), []

    def work(i):
        calls.append(i)
        return spark.range(i)

    assert B.run_missing(spark, path, [1, 2], work) == [1, 2]
    assert B.run_missing(spark, path, [1, 2, 3], work) == [3]
    assert calls == [1, 2, 3]
    assert rows(B.read_batches(spark, path).groupBy("imp").count()) == [(1, 1), (2, 2), (3, 3)]


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), ("b", None)], "k string, v double")
    assert rows(P.freq_one(df, "k")) == [("a", 2, 50.0), ("b", 1, 25.0), (None, 1, 25.0)]
    assert tuple(P.count_var(df, "k").first()) == (4, 3, 2)
    assert tuple(P.count_keys(df, ["k"]).first()) == (4, 3)
    stats = {r.k: (r["count"], r.p25, r.p50, r.p75) for r in P.describe_by(df, "k", "v").collect()}
    assert stats == {"a": (2, 1.25, 1.5, 1.75), "b": (0, None, None, None), None: (1, 3.0, 3.0, 3.0)}
    assert P.describe_by(df, "k", "v", accuracy=100).count() == 3
    assert rows(P.duplicate_keys(df, ["k"])) == [("a", 2)]
    assert rows(N.missing_by_column(df, ["k", "v"])) == [("k", 1, 25.0), ("v", 1, 25.0)]
    assert rows(N.missing_per_row(df, ["k", "v"])) == [(0, 2), (1, 2)]
    assert rows(N.missing_patterns(df, ["k", "v"])) == [(0, 0, 2), (0, 1, 1), (1, 0, 1)]
    sample = P.sample_rows(spark.range(1000), 10, ["id"])
    assert rows(sample) == rows(P.sample_rows(spark.range(1000).repartition(7), 10, ["id"]))


def test_compare_versions(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, "z", None), (4, "d", 1)], "k int, x string, y int")
    assert rows(K.compare_versions(old, new, ["k"])) == [(2, "differs", "x,y"), (3, "only_old", ""), (4, "only_new", "")]


def test_assembly(spark):
    sets = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "set int, person_id int")
    people = spark.createDataFrame([(1, "M")], "person_id int, sex string")
    one = spark.createDataFrame([(1, 1, 5)], "person_id int, set int, a int")
    two = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "person_id int, set int, b int")
    out = analysis_table(sets, people, [one, two], zero_flags=["b"])
    assert rows(out.select("set", "person_id", "sex", "a", "b")) == [(1, 1, "M", 5, 1), (1, 2, None, None, 0), (2, 1, "M", None, 0)]
    df, names = with_dummies(out, {"sex": (["M", "F"], "M")})
    assert names == ["sex_F"]
    df, products = with_interactions(df, [("a", "b")])
    assert rows(df.select("sex_F", f"`{products[0]}`")) == [(0, 5), (0, None), (None, None)]
