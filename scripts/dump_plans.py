"""Write PLANS.md: the physical plan trees of the headline operators at sf0.01.

Usage: python scripts/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n")[0]
    pushed = [l for l in text.splitlines() if l.startswith(("PushedFilters", "PartitionFilters", "ReadSchema"))]
    return head + "\n" + "\n".join(sorted(set(pushed))[:6])


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from tarmac.session import build_session
    from tarmac.operators import metrics as M
    from tarmac.operators import rolling, store as ST
    from tarmac.operators import scope
    from tarmac.plans import stages
    from tarmac.schemas import SPECS
    from tarmac.sources.fixture import FIXTURE_SCOPE

    spark = build_session("local[8]", 8)
    base = stages.base_table(spark, sf)
    sb = rolling.sanitize_keys(base)
    items = [
        ("Flights view (fixture joins; nation broadcast, others by planner size stats)",
         stages.flights(spark, sf)),
        ("Scope filter on a written labeled table (date range pushed to the scan)",
         scope.scope_filter(spark.read.parquet(base.inputFiles()[0].rsplit("/", 1)[0]), FIXTURE_SCOPE)),
        ("One spec: collapse of the flights, daily roll-up -> one Window node for 3 windows x (n, s)",
         rolling.rolling_features_for_spec(sb, SPECS[4], rolling.global_rate(sb))),
        ("Join-back of six daily tables (written in one job, broadcast under the size bound)",
         rolling.add_rolling_features(base)),
        ("Request enrichment, own mode (six lookup tables, one write)",
         ST.enrich_requests(stages.request_table(spark, sf), stages.feature_store(spark, sf), mode="own")),
        ("Exact AUC / AP per split (threshold collapse, written range partitions, bounded windows)",
         M.ranking_metrics(stages.scored_fixture(stages.with_aggregates(spark, sf)), group_cols=["split"])),
    ]
    out = ["# PLANS", "", f"Physical plan trees of the headline operators (generated by `scripts/dump_plans.py` on `{sf}`).", ""]
    for title, df in items:
        out += [f"## {title}", "", "```", tree(df), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
