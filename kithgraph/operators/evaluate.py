"""Classifier metrics from score histograms; predictions are never collected.

Predictions are (TransactionID, isFraud, proba). Equal scores are one point of every
curve. A metric whose denominator is empty is null, except precision, recall and F1 at a
threshold, which are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions import normalize as N
from kithgraph.operators.skew import SLICE_ROWS, equi_depth, running_sums

STEPS = 100  # thresholds are whole hundredths
SWEEP = (10, 90)
DEMO_SWEEP = (5, 95)
DEFAULT_THRESHOLD = 0.5
METRICS = ("roc_auc", "pr_auc", "precision", "recall", "f1", "accuracy")


def score_histogram(pred: DataFrame) -> DataFrame:
    """(proba, pos, neg): one row per distinct score; rows without a label are left out."""
    return (
        pred.filter(F.col("isFraud").isNotNull())
        .groupBy("proba")
        .agg(
            F.sum(N.is_fraud()).cast("bigint").alias("pos"),
            F.sum(F.lit(1) - N.is_fraud()).cast("bigint").alias("neg"),
        )
    )


def cumulative_counts(hist: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """(proba, pos, neg, tp, fp): positives and negatives scored at or above each score.

    Distinct scores fall into slices of equal depth, so peaked scores are spread as well;
    only the slice totals are summed in one task.
    """
    sliced, column = equi_depth(hist, ["proba"], rows)
    return running_sums(sliced, [], column, "proba", {"tp": "pos", "fp": "neg"}, descending=True).select("proba", "pos", "neg", F.col("tp").cast("bigint"), F.col("fp").cast("bigint"))


def _div(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0)).cast("double")


def _auc(rows: DataFrame) -> DataFrame:
    below = F.sum(F.col("neg") * (2 * (F.col("tp") - F.col("pos")) + F.col("pos")).cast("double"))
    gain = F.sum(F.col("pos") * _div(F.col("tp"), F.col("tp") + F.col("fp")))
    total = rows.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), below.alias("twice"), gain.alias("gain")
    )
    return total.select(
        _div(F.col("twice"), 2.0 * F.col("p") * F.col("n")).alias("roc_auc"),
        _div(F.col("gain"), F.col("p")).alias("pr_auc"),
    )


def roc_auc(pred: DataFrame) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting one half."""
    return _auc(cumulative_counts(score_histogram(pred))).select("roc_auc")


def average_precision(pred: DataFrame) -> DataFrame:
    """Precision averaged over the steps of recall (a step sum, no interpolation)."""
    return _auc(cumulative_counts(score_histogram(pred))).select("pr_auc")


def confusion(pred: DataFrame, threshold: float) -> DataFrame:
    """tn, fp, fn, tp and fraud support at `proba >= threshold`, one row."""
    hit, fraud = F.col("proba") >= threshold, F.col("isFraud") == 1

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return pred.filter(F.col("isFraud").isNotNull()).agg(
        n(~hit & ~fraud).alias("tn"),
        n(hit & ~fraud).alias("fp"),
        n(~hit & fraud).alias("fn"),
        n(hit & fraud).alias("tp"),
        n(fraud).alias("support_fraud"),
    )


def _with_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return counts.withColumns(
        {
            "precision": F.coalesce(_div(tp, tp + fp), zero),
            "recall": F.coalesce(_div(tp, tp + fn), zero),
            "f1": F.coalesce(_div(2 * tp, 2 * tp + fp + fn), zero),
            "accuracy": _div(tp + tn, tp + tn + fp + fn),
        }
    )


def threshold_metrics(pred: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and accuracy at a threshold, one row."""
    return _with_scores(confusion(pred, threshold)).select("precision", "recall", "f1", "accuracy")


def threshold_sweep(pred: DataFrame, start: int = SWEEP[0], stop: int = SWEEP[1]) -> DataFrame:
    """Counts and scores at every threshold i/100 with start <= i < stop.

    Each score goes to the largest threshold it reaches; the counts at a threshold are
    sums over one row per hundredth, so predictions meet no grid.
    """
    guess = F.floor(F.col("proba") * STEPS)
    step = (
        F.when(F.col("proba") >= (guess + 1) / F.lit(float(STEPS)), guess + 1)
        .when(F.col("proba") < guess / F.lit(float(STEPS)), guess - 1)
        .otherwise(guess)
    )
    bins = score_histogram(pred).groupBy(
        F.greatest(F.least(step, F.lit(stop - 1)), F.lit(start - 1)).cast("bigint").alias("step")
    ).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = pred.sparkSession.range(start - 1, stop).withColumnRenamed("id", "step")
    full = grid.join(bins, "step", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    counts = full.select(
        "step",
        F.sum("pos").over(above).cast("bigint").alias("tp"),
        F.sum("neg").over(above).cast("bigint").alias("fp"),
        F.coalesce(F.sum("pos").over(below), F.lit(0)).cast("bigint").alias("fn"),
        F.coalesce(F.sum("neg").over(below), F.lit(0)).cast("bigint").alias("tn"),
    ).filter(F.col("step") >= start)
    return _with_scores(counts).select(
        (F.col("step") / F.lit(float(STEPS))).alias("threshold"),
        "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy",
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the highest F1; 0.5 if no threshold has a positive F1."""
    best = sweep.filter(F.col("f1") > 0).agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"),
        F.max("f1").alias("f1"),
    )
    return best.select(
        F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce("f1", F.lit(0.0)).alias("f1"),
    )


def _curve(pred: DataFrame) -> DataFrame:
    hist = score_histogram(pred)
    totals = hist.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return cumulative_counts(hist).select(
        "proba",
        "tp",
        "fp",
        totals.select("p").scalar().alias("p"),
        totals.select("n").scalar().alias("n"),
    )


def roc_points(pred: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    return _curve(pred).select(
        F.col("proba").alias("threshold"),
        _div(F.col("fp"), F.col("n")).alias("fpr"),
        _div(F.col("tp"), F.col("p")).alias("tpr"),
    )


def pr_points(pred: DataFrame) -> DataFrame:
    """(threshold, recall, precision) at every distinct score."""
    return _curve(pred).select(
        F.col("proba").alias("threshold"),
        _div(F.col("tp"), F.col("p")).alias("recall"),
        _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def recall_at_precision(pred: DataFrame, precision: float) -> DataFrame:
    """Highest recall among thresholds with at least this precision; null if there is none."""
    ok = pr_points(pred).filter(F.col("precision") >= precision)
    return ok.agg(F.max("recall").alias("recall"))


def metrics_at(pred: DataFrame, threshold: float) -> DataFrame:
    """All metrics of one model as (metric, value) rows, plus the confusion counts."""
    curve = _auc(cumulative_counts(score_histogram(pred)))
    at = _with_scores(confusion(pred, threshold))
    names = ["precision", "recall", "f1", "accuracy", "tn", "fp", "fn", "tp", "support_fraud"]
    return _rows(curve, ["roc_auc", "pr_auc"]).unionByName(_rows(at, names))


def metrics_from(
    pred: DataFrame, start: int = SWEEP[0], stop: int = SWEEP[1], tune: DataFrame | None = None
) -> DataFrame:
    """All metrics at the best threshold, with that threshold as a metric.

    The threshold comes from `tune`, or from the scored rows themselves as published.
    """
    best = best_threshold(threshold_sweep(pred if tune is None else tune, start, stop))
    chosen = best.select(F.lit("threshold").alias("metric"), F.col("threshold").cast("double").alias("value"))
    return metrics_at(pred, best.select("threshold").scalar()).unionByName(chosen)


def _rows(one: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]
    )
    return one.select(F.inline(cells))


def compare(base: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Two metric frames side by side: delta, lift in percent, frauds gained, alarms saved."""
    both = base.withColumnRenamed("value", "baseline").join(
        enhanced.withColumnRenamed("value", "enhanced"), "metric"
    )
    delta = F.col("enhanced") - F.col("baseline")
    return both.select(
        "metric",
        "baseline",
        "enhanced",
        delta.alias("delta"),
        F.when(
            F.col("metric").isin(*METRICS), F.lit(100.0) * delta / F.nullif("baseline", F.lit(0.0))
        ).alias("lift_pct"),
        F.when(F.col("metric") == "tp", delta.cast("bigint")).alias("extra_frauds_caught"),
        F.when(F.col("metric") == "fp", (-delta).cast("bigint")).alias("fewer_false_alarms"),
    )


def run_record(name: str, logged_at: int, params: dict[str, str], metrics: DataFrame) -> DataFrame:
    """One experiment run as rows (run_name, logged_at, kind, name, value)."""
    spark = metrics.sparkSession
    cells = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(str(v)).alias("value")) for k, v in params.items()])
    given = spark.range(1).select(F.lit("param").alias("kind"), F.inline(cells))
    measured = metrics.select(
        F.lit("metric").alias("kind"),
        F.col("metric").alias("name"),
        F.round("value", 4).cast("string").alias("value"),
    )
    return given.unionByName(measured).select(
        F.lit(name).alias("run_name"), F.lit(logged_at).cast("bigint").alias("logged_at"), "kind", "name", "value"
    )


def log_run(path: str, record: DataFrame) -> None:
    """Append a run to the log table."""
    record.write.mode("append").parquet(path)


def read_runs(runs: DataFrame) -> DataFrame:
    """The log with only the last write of each run; a rerun replaces all of its rows."""
    last = runs.groupBy("run_name").agg(F.max("logged_at").alias("logged_at"))
    return runs.join(last, ["run_name", "logged_at"], "left_semi")


def save_predictions(pred: DataFrame, path: str) -> None:
    pred.select("TransactionID", "isFraud", "proba").write.mode("overwrite").parquet(path)
