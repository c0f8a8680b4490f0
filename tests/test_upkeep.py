"""Rolling tables kept up in steps equal those built at once."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import rolling, upkeep
from tarmac.plans import stages
from tarmac.schemas import SPECS

from conftest import SF_SMALL


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs}


@pytest.fixture(scope="module")
def base(spark):
    return stages.base_table(spark, SF_SMALL)


def test_steps_equal_one_build(spark, base, tmp_path):
    """A long first part, then single days, then the rest; no written file changes."""
    days = [r[0] for r in base.select("flight_date").where("flight_date IS NOT NULL").distinct().orderBy("flight_date").collect()]
    cuts = [days[len(days) // 2], days[len(days) // 2 + 1], days[len(days) // 2 + 2], days[-1]]
    root, since, seen = str(tmp_path / "state"), dt.date(1900, 1, 1), {}
    assert upkeep.watermark(spark, root) is None
    for upto in cuts:
        got = upkeep.advance(spark, root, base.where((F.col("flight_date") > since) & (F.col("flight_date") <= upto)))
        assert got["upto"] == upto == upkeep.watermark(spark, root) and got["late"] == 0
        now = _files(root)
        assert seen.items() <= now.items()
        since, seen = upto, now
    for spec in SPECS:
        assert _rows(upkeep.features(spark, root, spec)) == _rows(rolling.rolling_table(base, spec))


def test_late_flights_and_failed_steps(spark, tmp_path, monkeypatch):
    rng, d0 = random.Random(1), dt.date(2024, 1, 1)
    rows = [(rng.choice(["A", "B", None]), rng.choice(["A", "C"]), "X", "r", rng.choice([7, None]), d0 + dt.timedelta(days=rng.randrange(900)), rng.choice([0, 1, None]))
            for _ in range(800)]
    rows += [("A", "C", "X", "r", 7, None, 1)]
    df = spark.createDataFrame(rows, "ORIGIN string, DEST string, OP_CARRIER string, route string, CRS_DEP_HOUR int, flight_date date, delayed_15 int")
    root, mid = str(tmp_path / "state"), d0 + dt.timedelta(days=500)
    upkeep.advance(spark, root, df.where(F.col("flight_date") <= mid))
    with pytest.raises(ValueError, match="watermark"):
        upkeep.advance(spark, root, df)
    # A step that fails before its mark is no part of the state.
    with monkeypatch.context() as m:
        m.setattr(upkeep, "trailing_sums", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            upkeep.advance(spark, root, df, drop_late=True)
    assert upkeep.watermark(spark, root) <= mid
    got = upkeep.advance(spark, root, df, drop_late=True)
    assert got["late"] == df.where(F.col("flight_date") <= mid).count()
    assert upkeep.advance(spark, root, df.limit(0))["flights"] == 0
    dated = df.where("flight_date IS NOT NULL")
    for spec in SPECS:
        assert _rows(upkeep.features(spark, root, spec)) == _rows(rolling.rolling_table(dated, spec))


def test_an_advance_reads_only_the_longest_window(spark, tmp_path, monkeypatch):
    d0 = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("A", "B", "X", "r", 7, d0 + dt.timedelta(days=i), i % 2) for i in range(0, 1500, 5)],
                               "ORIGIN string, DEST string, OP_CARRIER string, route string, CRS_DEP_HOUR int, flight_date date, delayed_15 int")
    root, read = str(tmp_path / "state"), []
    for k in range(3):
        upkeep.advance(spark, root, df.where(F.col("flight_date").between(d0 + dt.timedelta(days=500 * k), d0 + dt.timedelta(days=500 * k + 499))))
    real = upkeep._read
    monkeypatch.setattr(upkeep, "_read", lambda s, b, n: (read.append(len(b)), real(s, b, n))[1])
    upkeep.advance(spark, root, df.limit(1).withColumn("flight_date", F.lit(d0 + dt.timedelta(days=1600))))
    assert read == [1, 1]  # its own counts, and of three batches the one within 365 days
