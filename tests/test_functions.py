"""Edge-case vectors (FIXTURES §4) on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarmac.functions import calendar as cal
from tarmac.functions.coerce import clean_text, strip, to_date_lenient, to_double
from tarmac.functions.timeofday import daypart, hhmm_to_minutes, minutes_to_hour
from tarmac.operators.explain import percent_text, reason_codes, risk_bucket
from tarmac.operators.labels import label_flights


def one_col(spark, values, typ):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_hhmm_minutes_hour_daypart(spark):
    cases = [(0, 0, 0, "night"), (5, 5, 0, "night"), (559, 359, 5, "night"), (600, 360, 6, "morning"),
             (945, 585, 9, "morning"), (2359, 1439, 23, "late"), (2400, 1440, 24, None), (1260, None, None, None),
             (-5, None, None, None), (-100, -60, -1, None), (None, None, None, None)]
    df = one_col(spark, [c[0] for c in cases], "int")
    m = hhmm_to_minutes("v")
    out = df.select("v", m.alias("m"), minutes_to_hour(m).alias("h"), daypart(minutes_to_hour(m)).alias("d")).collect()
    got = {r.v: (r.m, r.h, r.d) for r in out}
    for v, mm, hh, dd in cases:
        assert got[v] == (mm, hh, dd), v


def test_daypart_bounds_batch_and_request(spark):
    batch = {5: "night", 6: "morning", 11: "morning", 12: "afternoon", 17: "afternoon", 18: "evening",
             21: "evening", 22: "late", 23: "late", 24: None, -1: None}
    df = one_col(spark, list(batch), "int")
    got = {r.v: r.d for r in df.select("v", daypart("v").alias("d")).collect()}
    assert got == batch
    req = {r.v: r.d for r in df.select("v", daypart("v", closed_top=False).alias("d")).collect()}
    assert req[24] == "late" and req[-1] == "night" and req[12] == "afternoon"


def test_guarded_numeric_cast(spark):
    cases = {" 5 ": 5.0, "1e3": 1000.0, "-3.5": -3.5, ".5": 0.5, "5.": 5.0, "0.00": 0.0,
             "": None, "abc": None, "5d": None, "0x1F": None, "1_0": None, "nan": None, "inf": None}
    df = one_col(spark, list(cases), "string")
    got = {r.v: r.d for r in df.select("v", to_double("v").alias("d")).collect()}
    assert got == cases


def test_date_parse(spark):
    cases = {"2024-01-05": dt.date(2024, 1, 5), "1/6/2024 12:00:00 AM": dt.date(2024, 1, 6),
             "2024-02-30": None, "junk": None, "": None}
    df = one_col(spark, list(cases), "string")
    got = {r.v: r.d for r in df.select("v", to_date_lenient("v").alias("d")).collect()}
    assert got == cases


def test_na_tokens_and_strip(spark):
    df = one_col(spark, ["NA", "nan", "", "\t A \n", "DL"], "string")
    got = [r.c for r in df.select(clean_text("v").alias("c")).collect()]
    assert got == [None, None, None, "A", "DL"]
    assert df.select(strip(F.lit("\t A \n")).alias("s")).first().s == "A"


def test_label_rule(spark):
    df = spark.createDataFrame(
        [(15.0,), (14.9,), (None,), (float("nan"),)], "ARR_DELAY double").withColumns(
        {"FL_DATE": F.lit(dt.date(2024, 1, 1)), "YEAR": F.lit(2024), "MONTH": F.lit(1), "DAY_OF_MONTH": F.lit(1)})
    out = label_flights(df).select("ARR_DELAY", "delayed_15").collect()
    assert sorted((r.ARR_DELAY, r.delayed_15) for r in out) == [(14.9, 0), (15.0, 1)]


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2023, 1, 1),), (dt.date(2025, 6, 15),)], "d date")
    out = df.select(cal.iso_week("d").alias("w"), cal.iso_day_of_week("d").alias("dow")).collect()
    assert [r.w for r in out] == [1, 52, 24]
    assert out[2].dow == 7
    wk = one_col(spark, [5, 6, 7, None], "int").select(cal.is_weekend("v").alias("w")).collect()
    assert [r.w for r in wk] == [0, 1, 1, 0]


def test_route_null_propagates(spark):
    df = spark.createDataFrame([("A", "B"), (None, "C")], "o string, d string")
    assert [r.r for r in df.select(cal.route("o", "d").alias("r")).collect()] == ["A-B", None]


def test_risk_bucket_and_percent(spark):
    vals = [0.1999, 0.20, 0.3999, 0.40, 0.23449, 0.2346, 0.99999]
    df = one_col(spark, vals, "double")
    out = df.select(risk_bucket("v").alias("b"), percent_text("v").alias("p")).collect()
    assert [r.b for r in out] == ["Low", "Medium", "Medium", "High", "Medium", "Medium", "High"]
    assert [r.p for r in out] == [f"{v:.1%}" for v in vals]


def test_reason_codes(spark):
    df = spark.createDataFrame([(18, 1, 1500.0, "A-B"), (7, 0, 100.0, None), (12, 0, 100.0, None)],
                               "CRS_DEP_HOUR int, is_weekend int, DISTANCE double, route string")
    out = [r.r for r in df.select(reason_codes().alias("r")).collect()]
    assert len(out[0]) == 4 and out[0][0].startswith("Evening")
    assert len(out[1]) == 1 and out[1][0].startswith("Early")
    assert out[2] == []
