"""Plan checks: pushdown, pruning, broadcast choices, no Python outside H1."""

from pyspark.sql import functions as F

from tarmac.operators import scope
from tarmac.plans import stages
from tarmac.sources.fixture import FIXTURE_SCOPE

from conftest import SF_SMALL


def _plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_scan_prunes_columns(spark, capsys):
    plan = _plan(stages.flights(spark, SF_SMALL).select("OP_CARRIER", "ORIGIN"), capsys)
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan


def test_date_filter_pushed_to_scan(spark, capsys, tmp_path):
    lab = stages.labeled_flights(spark, SF_SMALL)
    path = str(tmp_path / "labeled")
    lab.write.parquet(path)
    scoped = scope.scope_filter(spark.read.parquet(path), FIXTURE_SCOPE)
    plan = _plan(scoped, capsys)
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert pushed and "GreaterThanOrEqual(flight_date,1996-01-01)" in pushed[0]
    assert "LessThanOrEqual(flight_date,2000-12-31)" in pushed[0]


def _join_back(spark, **kw):
    from tarmac.operators.rolling import add_rolling_features

    return add_rolling_features(stages.base_table(spark, SF_SMALL), **kw)


def test_no_python_in_feature_pipeline(spark, capsys):
    plan = _plan(_join_back(spark), capsys)
    assert "Python" not in plan and "ArrowEval" not in plan


def test_daily_tables_broadcast_when_small(spark, capsys):
    plan = _plan(_join_back(spark), capsys)
    assert plan.count("BroadcastHashJoin LeftOuter") >= 6


def test_daily_tables_shuffle_join_when_over_bound(spark, capsys):
    from tarmac.operators.rolling import add_rolling_features

    base = stages.base_table(spark, SF_SMALL)
    out = add_rolling_features(base, broadcast_max_bytes=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(out, capsys)
        assert "SortMergeJoin LeftOuter" in plan
        assert out.count() == base.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_shuffled_joins_run_before_broadcast_joins(spark, capsys, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        # Sizes differ by spec; a bound between the smallest two leaves one broadcast.
        import tarmac.operators.rolling as R
        sizes, real = {}, R.materialize_family

        def spy(*a, **k):
            found = real(*a, **k)
            sizes.update({t: n for t, (_, n) in found.items()})
            return found

        monkeypatch.setattr(R, "materialize_family", spy)
        _join_back(spark)
        out = _join_back(spark, broadcast_max_bytes=sorted(sizes.values())[0])
        plan = _plan(out, capsys)
        joins = [l for l in plan.split("\n\n")[0].splitlines() if "Join" in l]
        assert "BroadcastHashJoin" in joins[0]                 # the top (last) join is the broadcast one
        assert all("SortMergeJoin" in j for j in joins[1:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_flights_are_scanned_once_for_all_specs(spark, capsys, monkeypatch):
    """Only the grouping-sets aggregate reads the base; the six tables and the global rate read its result."""
    import tarmac.operators.rolling as R

    plans = {}
    real = R.materialize_family
    monkeypatch.setattr(R, "materialize_family", lambda frames, *a, **k: (plans.update(frames), real(frames, *a, **k))[1])
    base = stages.base_table(spark, SF_SMALL)
    R.add_rolling_features(base)
    files = {f for f in base.inputFiles()}
    assert len(plans) == 6 and not any(files & set(t.inputFiles()) for t in plans.values())


def test_daily_counts_of_all_specs_are_one_aggregate(spark, capsys):
    """One scan, one shuffle of partial rows per (key set, key, day); equal to the plain group-bys."""
    import tarmac.operators.rolling as R
    from tarmac.schemas import SPECS

    base = R.sanitize_keys(stages.base_table(spark, SF_SMALL))
    tables = R.daily_tables(base, materialize_table=False)
    plan = _plan(tables["route"], capsys).split("\n\n")[0]
    assert plan.count("Expand") == 1 and plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
    for spec in SPECS:
        plain, got = R.daily_counts(base, list(spec.keys)), R.daily_tables(base)[spec.name]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        assert got.schema.fieldNames() == plain.schema.fieldNames()


def test_own_lookups_come_from_the_daily_tables(spark, capsys):
    from tarmac.operators import store as ST

    store = stages.feature_store(spark, SF_SMALL)
    plain, got = ST.build_lookups(store), stages.lookups(spark, SF_SMALL)
    for name, t in got.items():
        assert "Aggregate" not in _plan(t, capsys)
        assert sorted(map(tuple, t.collect()), key=str) == sorted(map(tuple, plain[name].select(t.columns).collect()), key=str)
