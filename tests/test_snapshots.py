"""A stream scored against snapshots: the next batch uses a newly published one and no batch mixes two."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tarmac.operators import model as MD
from tarmac.plans import modeling as MO
from tarmac.plans import stages
from tarmac.session import materialize
from tarmac.streaming import snapshots as SN


def test_a_published_snapshot_serves_from_the_next_batch_on(spark, tmp_path, with_aggs):
    cfg = MD.ModelConfig(max_iter=2, patience=2, max_depth=2, max_bins=16)
    MD.save(MO.train(with_aggs, cfg), cfg, str(tmp_path / "m"))
    store = stages.feature_store(spark, SF_SMALL)
    half = store.agg(F.expr("date_from_unix_date(cast(avg(unix_date(flight_date)) as int))")).first()[0]
    asked = materialize(stages.fixture_requests(spark, SF_SMALL).limit(60), "asked").withColumn("k", F.pmod(F.xxhash64("request_id"), F.lit(2)))
    root, src, out, ckpt = (str(tmp_path / x) for x in ("snapshots", "incoming", "out", "ckpt"))

    def send(k):
        part = asked.where(F.col("k") == k).drop("k")
        if k:  # a request from and to one airport is rejected
            part = part.unionByName(part.limit(1).withColumn("request_id", F.lit("bad")).withColumn("dest", F.col("origin")))
        part.coalesce(1).write.mode("append").json(src)
        q = SN.start_scoring(spark, src, root, str(tmp_path / "m"), out, ckpt, available_now=True)
        q.awaitTermination(300)
        return q

    assert SN.newest(spark, root) is None
    with pytest.raises(Exception, match="no snapshot is published"):
        send(0)
    assert SN.publish(spark, root, store.where(F.col("flight_date") <= F.lit(half))) == 1
    # Files of a snapshot that is not published yet are not read.
    store.limit(1).write.parquet(f"{root}/v9/store")
    SN.start_scoring(spark, src, root, str(tmp_path / "m"), out, ckpt, available_now=True).awaitTermination(300)
    first = spark.read.parquet(out)
    assert first.select("store_version").distinct().collect() == [(1,)]
    # Some requests of the fixture are not valid: every one is in one of the two outputs.
    assert first.count() + spark.read.parquet(f"{out}_rejected").count() == asked.where("k = 0").count()
    assert SN.publish(spark, root, store) == 2 and SN.newest(spark, root)[0] == 2
    send(1)
    rows = spark.read.parquet(out)
    assert rows.groupBy("batch").agg(F.countDistinct("store_version").alias("n")).where("n > 1").count() == 0
    assert sorted(r.store_version for r in rows.select("store_version").distinct().collect()) == [1, 2]
    rejected = [r.request_id for r in spark.read.parquet(f"{out}_rejected").collect()]
    kept = [r.request_id for r in rows.collect()]
    assert "bad" in rejected and sorted(kept + rejected) == sorted([r.request_id for r in asked.collect()] + ["bad"])
    # The restarted query has nothing new.
    SN.start_scoring(spark, src, root, str(tmp_path / "m"), out, ckpt, available_now=True).awaitTermination(300)
    assert spark.read.parquet(out).count() == len(kept)
