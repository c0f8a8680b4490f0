"""Trailing windows, smoothing and join-back properties."""

import datetime as dt

from pyspark.sql import functions as F

from tarmac.operators import rolling
from tarmac.schemas import SPECS, AggSpec

from conftest import SF_SMALL


def test_left_closed_trailing_sum(spark):
    # values 1, 2, 4, 8, 16 on consecutive days, 3-day window -> 0, 1, 3, 7, 14
    d0 = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([("X", d0 + dt.timedelta(days=i), v, 0) for i, v in enumerate([1, 2, 4, 8, 16])],
                                  "ORIGIN string, flight_date date, n long, s long")
    out = rolling.trailing_sums(daily, ["ORIGIN"], (3,)).orderBy("flight_date").collect()
    assert [r.n_3d for r in out] == [0, 1, 3, 7, 14]


def test_smoothing_rule(spark):
    r = spark.range(1).select(
        rolling.smoothed_rate(F.lit(3), F.lit(7), F.lit(0.2), 50.0).alias("a"),
        rolling.smoothed_rate(F.lit(0), F.lit(0), F.lit(0.2), 50.0).alias("b")).first()
    assert abs(r.a - 13 / 57) < 1e-12 and r.b == 0.2


def test_same_day_labels_do_not_leak(spark):
    d0 = dt.date(2024, 1, 1)
    rows = [("A", d0 + dt.timedelta(days=i), i % 2) for i in range(10)]
    base = spark.createDataFrame(rows, "ORIGIN string, flight_date date, delayed_15 int")
    spec = AggSpec("origin", ("ORIGIN",))
    a = rolling.rolling_features_for_spec(base, spec, F.lit(0.25), (30,))
    flipped = base.withColumn("delayed_15", F.when(F.col("flight_date") == d0 + dt.timedelta(days=9),
                                                   1 - F.col("delayed_15")).otherwise(F.col("delayed_15")))
    b = rolling.rolling_features_for_spec(flipped, spec, F.lit(0.25), (30,))
    last = d0 + dt.timedelta(days=9)
    ra = a.where(F.col("flight_date") == last).first()
    rb = b.where(F.col("flight_date") == last).first()
    assert ra.origin_delay_rate_30d == rb.origin_delay_rate_30d


def test_join_back_properties(spark, with_aggs):
    from tarmac.plans import stages

    base = stages.base_table(spark, SF_SMALL)
    assert with_aggs.count() == base.count()               # J1 keeps the row count
    g = base.agg(F.avg("delayed_15")).first()[0]
    for spec in SPECS:
        f30, f90, f365 = (F.col(f"{spec.name}_freq_{w}d") for w in (30, 90, 365))
        r30 = F.col(f"{spec.name}_delay_rate_30d")
        bad = with_aggs.where((f30 > f90) | (f90 > f365) | (r30 < 0) | (r30 > 1)).count()
        assert bad == 0, spec.name
        zero = with_aggs.where(f30 == 0).select(r30.alias("r")).distinct().collect()
        assert all(abs(z.r - g) < 1e-12 for z in zero), spec.name


def test_one_window_node_per_spec(spark, capsys):
    """All 3 windows x (n, s) of a spec share one Window operator; no Python in the plan."""
    from tarmac.plans import stages

    base = rolling.sanitize_keys(stages.base_table(spark, SF_SMALL))
    t = rolling.rolling_features_for_spec(base, SPECS[4], rolling.global_rate(base))
    t.explain("formatted")
    plan = capsys.readouterr().out
    tree = plan.split("\n\n")[0]
    assert tree.count("Window (") == 1
    assert "Python" not in plan
