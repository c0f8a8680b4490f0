"""Strict CSV ingest reads its text once, and the coercions stay small enough to be compiled."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import coerce as CO
from tarmac.plans import io_queries as IQ
from tarmac.plans import stages
from tarmac.schemas import RAW_COLUMNS
from tarmac.sources import csv as C

HEADER = ",".join(c for c, (need, _) in RAW_COLUMNS.items() if need)


def _by_pattern(text):
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    d = F.when(F.col(text).rlike(CO.NUMERIC_PATTERN), s.try_cast("double"))
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def test_numbers_are_those_of_the_pattern(spark):
    texts = ["5", "+5", "-.5", "5.", ".", "+.", "1e5", "1e", "5.e-3", "1e999", "-1e999", "0x1p3", "0X1P3", "0x1.8", "1d", "1f", "Infinity", "+NaN", "- 5", "1_0",
             "5\x01", "\x015", " 5", "5\t", "5 ", "٣", "2001-01-01", "5/6", "", " ", "9223372036854775808", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", CO.to_double("t").alias("got"), _by_pattern("t").alias("want")).collect():
        assert r.got == r.want, repr(r.t)


def test_plain_dates_are_those_of_the_format(spark):
    texts = ["2024-01-05", "2024-02-30", "0000-01-01", "0001-01-01", "2024-1-005", "2024-01-1T", "2024-01-1\x01", "+2024-1-01", "20240-1-01", "abcd-ef-g1", "2024-01-05 ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.when(F.col("t").rlike(r"^\d{4}-\d{1,2}-\d{1,2}"),
                  F.try_to_date(F.regexp_extract(F.regexp_replace("t", r"^\s+|\s+$", ""), r"^\d{4}-\d{1,2}-\d{1,2}(?=$|[ T])", 0), "yyyy-M-d"))
    for r in df.select("t", CO.to_date_lenient("t").cast("string").alias("got"), want.cast("string").alias("want")).collect():
        assert r.got == r.want, repr(r.t)


def test_coercion_has_few_copies_of_a_column(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS]))
    plan = C.coerce_types(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"DISTANCE#", plan)) < 60  # was in the hundreds: the copies of copies


def test_strict_ingest_parses_the_text_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n2024, 1 ,2,3,DL,ATL,NA,900,1000,1.5,700\n2024,1,2,3,DL,ATL,JFK,900,1000,x,700\n")
    rows = C.read_raw_csv(spark, str(tmp_path), strict=True)
    assert all("/tables/typed-" in f for f in rows.inputFiles())  # was the CSV, read a second time
    assert sorted(map(str, rows.collect())) == sorted(map(str, C.read_raw_csv(spark, str(tmp_path)).collect()))
    (tmp_path / "a.csv").write_text(f"{HEADER}\n2024,1.5,2,3,DL,ATL,JFK,900,1000,1.5,700\n")
    with pytest.raises(C.IngestError, match="'MONTH': 1"):
        C.read_raw_csv(spark, str(tmp_path), strict=True)


def test_flights_are_joined_once_for_both_layouts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(IQ, "materialize", lambda df, name, **k: made.append(name) or stages.materialize(df, name, **k))
    root = IQ._csv_tree(spark, "/root/testdata/sf0.001")
    assert made == ["flights"]
    n = spark.read.option("header", True).option("recursiveFileLookup", True).csv(root).count()
    assert n == stages.flights(spark, "/root/testdata/sf0.001").where("MONTH IS NOT NULL").count()
