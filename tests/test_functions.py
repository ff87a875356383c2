from datetime import date

import pytest
from pyspark.sql import functions as F

from matchloom.functions import codes as C
from matchloom.functions import dates as D
from matchloom.functions import values as V


def column(spark, values, type_name, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_clean_code_keeps_the_order_of_steps(spark):
    raw = ["A41.X", "A41X.", "E11-1", "J10 .0", "X59", "A,1", "", None]
    assert column(spark, raw, "string", C.clean_code("v")) == ["A41", "A41X", "E111", "J100", "X59", "A1", "", None]
    assert column(spark, ["A,1X"], "string", C.clean_code("v", comma=False)) == ["A,1"]


def test_prefix_rule_include_minus_exclude(spark):
    codes = ["0204AA", "0204R0", "020502G1", "020502Z", "99", None]
    rule = C.prefix_rule("v", ["0204", "020502"], ["0204R0", "020502G"])
    assert column(spark, codes, "string", F.coalesce(rule, F.lit(False))) == [True, False, False, True, False, False]


def test_positions_and_equality(spark):
    assert column(spark, ["01", "10", "00"], "string", C.clean_position("v")) == ["1", "10", "0"]
    assert column(spark, ["UNDERLYING", "3"], "string", C.cause_position("v")) == ["UNDERLYING", "SECONDARY_3"]
    assert column(spark, ["a", None], "string", C.same("v", F.lit(None).cast("string"))) == [0, 1]


def test_compact_dates(spark):
    raw = ["20200229", "2020013", "20190229", "notadate", "", None]
    assert column(spark, raw, "string", D.parse_compact_date("v")) == [date(2020, 2, 29), date(2020, 1, 3), None, None, None, None]


def test_lookback_window_at_month_ends(spark):
    days = [date(2024, 3, 31), date(2024, 2, 29)]
    start, end = D.lookback_window("v", 12, end_offset=-1)
    assert column(spark, days, "date", start) == [date(2023, 3, 31), date(2023, 2, 28)]
    assert column(spark, days, "date", end) == [date(2024, 3, 30), date(2024, 2, 28)]
    start, _ = D.lookback_window("v", 1, start_offset=2)
    assert column(spark, days, "date", start) == [date(2024, 3, 2), date(2024, 1, 31)]
    with pytest.raises(ValueError):
        D.lookback_window("v", None)


def test_windows_closed_and_half_open(spark):
    days = [date(2020, 1, d) for d in (1, 2, 5, 6)]
    a, b = F.to_date(F.lit("2020-01-02")), F.to_date(F.lit("2020-01-05"))
    assert column(spark, days, "date", D.within("v", a, b)) == [False, True, True, False]
    assert column(spark, days, "date", D.within("v", a, b, closed=False)) == [False, True, False, False]


def test_observation_window(spark):
    entries = [date(2018, 5, 1), date(2020, 5, 1), None]
    assert column(spark, entries, "date", D.observation_start("v", "2019-04-01")) == [date(2019, 4, 1), date(2020, 5, 1), None]
    deaths = [date(2026, 1, 1), None]
    assert column(spark, deaths, "date", D.observation_end("2024-12-02", "v")) == [date(2026, 1, 1), date(2024, 12, 2)]
    assert column(spark, deaths, "date", D.observation_end("2024-12-02", "v", bounded=True)) == [date(2024, 12, 2)] * 2


def test_age_counts_whole_years(spark):
    births = [date(2000, 3, 1)]
    assert column(spark, births, "date", D.age_years("v", F.to_date(F.lit("2020-02-29")))) == [19]
    assert column(spark, births, "date", D.age_years("v", F.to_date(F.lit("2020-03-01")))) == [20]


def test_body_mass_bands(spark):
    values = [18.4, 18.45, 18.5, 22.95, 24.95, 27.45, 29.95, 30.0, None]
    gap = column(spark, values, "double", V.band_by_group("v", F.lit(1), gaps=True))
    assert gap == ["Underweight", None, "Healthy weight", "Healthy weight", None, "Overweight", None, "Obese", None]
    whole = column(spark, values, "double", V.band_by_group("v", F.lit(2)))
    assert whole == ["Underweight", "Underweight", "Healthy weight", "Healthy weight", "Overweight", "Overweight", "Obese", "Obese", None]
    assert column(spark, values, "double", V.band_by_group("v", F.lit(None).cast("int"))) == [None] * 9


def test_filtration_rate_by_hand(spark):
    # 88.4 umol/L is 1 mg/dL. Woman of 50: 142 * (1/0.7)^-1.2 * 0.9938^50 * 1.012 = 68.6;
    # man of 50: 142 * (1/0.9)^-1.2 * 0.9938^50 = 91.7
    assert column(spark, [88.4], "double", V.ckd_epi_2021("v", F.lit("F"), F.lit(50))) == [69.0]
    assert column(spark, [88.4], "double", V.ckd_epi_2021("v", F.lit("M"), F.lit(50))) == [92.0]
    # below kappa the other exponent applies: 142 * (0.5/0.7)^-0.241 * 0.9938^30 * 1.012 = 129.3
    assert column(spark, [44.2], "double", V.ckd_epi_2021("v", F.lit("F"), F.lit(30))) == [129.0]


def test_numbers_flags_and_groups(spark):
    assert column(spark, ["88.9", "x", "", None], "string", V.safe_number("v")) == [88.9, None, None, None]
    assert column(spark, ["88.9", "-1.5"], "string", V.safe_number("v", whole=True)) == [88, -1]
    assert column(spark, [1, 0, 2, None], "int", V.one_or_zero("v")) == [1, 0, 0, 0]
    assert column(spark, [1234567], "long", V.with_thousands("v")) == ["1,234,567"]
    assert column(spark, [1, 0, None], "int", V.exposure_group("v", F.lit(1), F.lit(0))) == ["both", "non_recent_only", "non_recent_only"]
    assert column(spark, [1, 0, None], "int", V.exposure_group("v", F.lit(0))) == ["recent_only", "none", "none"]
    assert column(spark, [29.9, 30.0, 131.0, None], "double", V.binned("v", [30, 49, 131], ["a", "b"])) == [None, "a", None, None]
