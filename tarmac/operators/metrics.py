"""Evaluation metrics as DataFrame queries.

Exact ROC AUC (ties count half) and step-wise average precision need a
running total over scores in descending order.  Plan:

1. collapse to one row per distinct score: ``tp``, ``fp`` (partial aggregate);
2. range-partition the distinct scores and write them with their partition's number;
3. per-partition totals -> prefix offsets (a window over that many rows);
4. running sums inside each partition (bounded by its distinct scores) + the offset.

No step orders the whole table in one task.  Every metric can be computed
per group (e.g. per split) in the same pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def confusion_matrix(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5,
                     group_cols=()) -> DataFrame:
    """``tn, fp, fn, tp`` at ``score >= threshold`` (A11); layout [[TN, FP], [FN, TP]]."""
    y = F.col(label).cast("int")
    pred = F.col(score) >= F.lit(threshold)
    return df.groupBy(*group_cols).agg(
        F.count_if((y == 0) & ~pred).alias("tn"), F.count_if((y == 0) & pred).alias("fp"),
        F.count_if((y == 1) & ~pred).alias("fn"), F.count_if((y == 1) & pred).alias("tp"))


def brier(df: DataFrame, label: str = "label", score: str = "score", group_cols=()) -> DataFrame:
    """Mean squared error of the probability."""
    return df.groupBy(*group_cols).agg(
        F.avg(F.pow(F.col(score).cast("double") - F.col(label).cast("double"), 2)).alias("brier"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``max_count / count_c`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n")).scalar()
    return counts.select(label, "n", (top.cast("double") / F.col("n").cast("double")).alias("weight"))


def threshold_table(df: DataFrame, label: str = "label", score: str = "score", group_cols=()) -> DataFrame:
    """One row per (group, distinct score): positives ``tp`` and negatives ``fp``."""
    y = F.col(label).cast("long")
    return df.where(F.col(score).isNotNull()).groupBy(*group_cols, F.col(score).alias("p")).agg(
        F.sum(y).alias("tp"), F.sum(1 - y).alias("fp"))


def cumulative_rates(thr: DataFrame, group_cols=(), n_buckets: int | None = None) -> DataFrame:
    """Add inclusive running totals ``ctp``, ``cfp`` over descending score per group.

    ``n_buckets`` range partitions (the shuffle setting by default) are written once with their number;
    any count gives the same totals.
    """
    order = [*group_cols, F.desc("p")]
    ranged = thr.repartitionByRange(n_buckets, *order) if n_buckets else thr.repartitionByRange(*order)
    b = materialize(ranged.withColumn("_b", F.spark_partition_id()), "thresholds")
    totals = b.groupBy(*group_cols, "_b").agg(F.sum("tp").alias("_btp"), F.sum("fp").alias("_bfp"))
    higher = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, "_b",
                            F.coalesce(F.sum("_btp").over(higher), F.lit(0)).alias("_otp"),
                            F.coalesce(F.sum("_bfp").over(higher), F.lit(0)).alias("_ofp"))
    within = Window.partitionBy(*group_cols, "_b").orderBy(F.desc("p")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    run = b.withColumns({"_ctp": F.sum("tp").over(within), "_cfp": F.sum("fp").over(within)})
    return run.join(offsets, [*group_cols, "_b"]).select(
        *group_cols, "p", "tp", "fp",
        (F.col("_ctp") + F.col("_otp")).alias("ctp"), (F.col("_cfp") + F.col("_ofp")).alias("cfp"))


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", group_cols=(),
                    n_buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC and average precision per group (A13, A14; §M1, M2).

    AUC = sum_t (ctp_t - tp_t/2) * fp_t / (P * N)
    AP  = sum_t (tp_t / P) * ctp_t / (ctp_t + cfp_t)
    P = 0 or N = 0 gives null.  All arithmetic in double (D16).
    """
    return _ranking(cumulative_rates(threshold_table(df, label, score, group_cols), group_cols, n_buckets), group_cols)


def _ranking(cum: DataFrame, group_cols=(), more=()) -> DataFrame:
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    ctp, cfp = F.col("ctp").cast("double"), F.col("cfp").cast("double")
    agg = cum.groupBy(*group_cols).agg(
        F.sum(tp).alias("P"), F.sum(fp).alias("N"),
        F.sum((ctp - tp / 2.0) * fp).alias("_auc_num"),
        F.sum(tp * ctp / (ctp + cfp)).alias("_ap_num"),
        F.count(F.lit(1)).alias("thresholds"), *more)
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(
        *group_cols,
        F.when(ok, F.col("_auc_num") / (F.col("P") * F.col("N"))).alias("roc_auc"),
        F.when(F.col("P") > 0, F.col("_ap_num") / F.col("P")).alias("average_precision"),
        F.col("P").cast("long").alias("positives"), F.col("N").cast("long").alias("negatives"),
        "thresholds", *[c for c in agg.columns if c in ("tn", "fp", "fn", "tp", "brier")])


def evaluate(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5,
             group_cols=()) -> DataFrame:
    """AUC, AP, Brier and confusion counts per group in one tidy table.

    All come from one table of distinct scores, so the scored rows are read once.
    """
    cum = cumulative_rates(threshold_table(df, label, score, group_cols), group_cols)
    p, hit = F.col("p").cast("double"), F.col("p") >= F.lit(threshold)
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    more = [total("fp", ~hit).alias("tn"), total("fp", hit).alias("fp"), total("tp", ~hit).alias("fn"), total("tp", hit).alias("tp"),
            (F.sum(F.col("tp") * F.pow(1 - p, 2) + F.col("fp") * F.pow(p, 2)) / F.sum(F.col("tp") + F.col("fp"))).alias("brier")]
    return _ranking(cum, group_cols, more).withColumn("threshold", F.lit(float(threshold)))
