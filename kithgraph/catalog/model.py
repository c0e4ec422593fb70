"""Encoding, training and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kithgraph.catalog.registry import SPLIT, Given, over, query
from kithgraph.operators import encode as E
from kithgraph.operators import evaluate as V
from kithgraph.operators import features as Fe
from kithgraph.operators import train as M
from kithgraph.plans import workflows
from kithgraph.session import cut_lineage, scratch_path
from kithgraph.sources import tables as T

CATS = ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "M1", "DeviceType", "DeviceInfo", "id_23", "id_30", "id_31"]

_ENCODER = (
    "\nvals AS (SELECT DISTINCT column_name, value FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, coalesce({c}, '__missing__') AS value FROM keys WHERE TransactionDT <= {SPLIT}"
        f" UNION ALL SELECT '{c}', '__missing__'"
        for c in CATS
    )
    + ")),\nenc AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS code FROM vals)"
)


def _encoder(g: Given):
    train, _ = Fe.temporal_split(g.joined, SPLIT)
    return E.fit_encoder(train, CATS)


@query("m1_fit_encoder", over("keys", extra=_ENCODER, sql="SELECT column_name, value, code FROM enc"))
def fit_encoder(g: Given):
    return _encoder(g)


_ENCODED = (
    "SELECT TransactionID, "
    + ", ".join(f"coalesce(e_{c}.code, m_{c}.code) AS {c}" for c in CATS)
    + " FROM keys "
    + " ".join(
        f"LEFT JOIN enc e_{c} ON e_{c}.column_name = '{c}' AND e_{c}.value = coalesce(keys.{c}, '__missing__')"
        f" JOIN enc m_{c} ON m_{c}.column_name = '{c}' AND m_{c}.value = '__missing__'"
        for c in CATS
    )
)


@query("m2_encode", over("keys", extra=_ENCODER, sql=_ENCODED))
def encode(g: Given):
    return E.encode(g.joined.select("TransactionID", *CATS), _encoder(g), CATS)


@query("m2_encode_by_shuffle", over("keys", extra=_ENCODER, sql=_ENCODED))
def encode_by_shuffle(g: Given):
    """The path taken when the encoder is too large to broadcast."""
    return E.encode(g.joined.select("TransactionID", *CATS), _encoder(g), CATS, max_codes=0)


NUMBERS = ["TransactionAmt", "addr1", "addr2", "dist1"]


@query(
    "m3_feature_matrix",
    over(
        "tx",
        sql=f"SELECT TransactionID, isFraud, [{', '.join(f'coalesce({c}, -999.0)' for c in NUMBERS)}] AS features FROM tx",
    ),
)
def feature_matrix(g: Given):
    out = E.feature_matrix(g.tx, NUMBERS)
    return out.select("TransactionID", "isFraud", vector_to_array("features").alias("features"))


# Trees of the shorter queries are few and shallow, so that a run over the given tables takes seconds.
SMALL = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3, "maxBins": 32}


def _experiment(g: Given, settings: dict = SMALL, **options):
    """Graph-enhanced model without embeddings, entity rates from training labels."""
    features = workflows.features(g.tx, g.identity, label_scope="train", split_dt=SPLIT)
    dataset = cut_lineage(Fe.attach_features(g.joined, features))
    return workflows.run_experiment(dataset, ("tabular", "graph"), SPLIT, **options, **settings)


def _published(g: Given):
    """The published settings: up to 1000 trees of depth 7, stopped 50 trees after the best average precision."""
    return _experiment(g, {}, stop_on_ap=True, binned=True)


@query("m4_train_gbt")
def train_gbt(g: Given):
    """Metrics of the trained model on the later period."""
    return _experiment(g).metrics


@query("m4_train_gbt_tuned")
def train_gbt_tuned(g: Given):
    """Stopped on average precision and tuned on the first half of the later period."""
    return _experiment(g, tune_dt=SPLIT + 3 * 86_400, stop_on_ap=True).metrics


@query(
    "m4_train_gbt_published",
    over(
        "tx",
        sql=f"""SELECT count(*) AS scored, CAST(sum(isFraud) AS BIGINT) AS support_fraud, count(*) AS confusion_sum,
  CAST(0 AS BIGINT) AS out_of_range, CAST(sum(TransactionID) AS BIGINT) AS id_sum, true AS beats_constant
FROM tx WHERE TransactionDT > {SPLIT}""",
    ),
)
def train_gbt_published(g: Given):
    """The published settings: up to 1000 trees of depth 7, stopped 50 trees after the best average precision.

    What can be known without the model is checked: which rows are scored, that every score
    is a probability, that the confusion counts add up, and that the ranking beats a constant.
    """
    made = _published(g)
    wide = made.metrics.filter("metric in ('tn', 'fp', 'fn', 'tp')").agg(F.sum("value").cast("bigint").alias("confusion_sum"))
    ap = made.metrics.filter("metric = 'pr_auc'").select(F.col("value").alias("pr_auc"))
    rows = made.predictions.agg(
        F.count(F.lit(1)).alias("scored"),
        F.sum("isFraud").cast("bigint").alias("support_fraud"),
        F.coalesce(F.sum(F.when(F.col("proba").between(0, 1), 0).otherwise(1)), F.lit(0)).cast("bigint").alias("out_of_range"),
        F.sum("TransactionID").cast("bigint").alias("id_sum"),
    )
    beats = F.col("pr_auc") > F.col("support_fraud") / F.col("scored")
    return rows.select("*", wide.scalar().alias("confusion_sum"), ap.scalar().alias("pr_auc")).select(
        "scored", "support_fraud", "confusion_sum", "out_of_range", "id_sum", beats.alias("beats_constant")
    )


@query("m5_score")
def score(g: Given):
    return _experiment(g).predictions


@query("m13_importance_table")
def importance_table(g: Given):
    return _experiment(g).importances


@query("t2_top_features")
def top_features(g: Given):
    """Of the model with the published settings."""
    return M.top_features(_published(g).importances, 25)


@query("e3_train_and_compare")
def train_and_compare(g: Given):
    """Tabular against graph-enhanced with embeddings, one temporal split."""
    return workflows.train_and_compare(g.tx, g.identity, SPLIT, dim=8, **SMALL)[2]


_CUM = """
hist AS (SELECT proba, CAST(sum(isFraud) AS BIGINT) AS pos, CAST(sum(1 - isFraud) AS BIGINT) AS neg FROM pred GROUP BY proba),
cum AS (SELECT proba, pos, neg, CAST(sum(pos) OVER (ORDER BY proba DESC) AS BIGINT) AS tp,
  CAST(sum(neg) OVER (ORDER BY proba DESC) AS BIGINT) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM hist)"""


@query("w6_cumulative_counts", over("pred", extra=_CUM, sql="SELECT proba, pos, neg, tp, fp FROM cum"))
def cumulative_counts(g: Given):
    return V.cumulative_counts(V.score_histogram(g.pred))


@query(
    "m6_roc_auc",
    over(
        "pred",
        sql="""SELECT round((sum(r) - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS roc_auc FROM (
  SELECT isFraud, rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2.0::DOUBLE AS r,
    CAST(sum(isFraud) OVER () AS DOUBLE) AS p, CAST(sum(1 - isFraud) OVER () AS DOUBLE) AS n FROM pred)
WHERE isFraud = 1 GROUP BY p, n""",
    ),
)
def roc_auc(g: Given):
    return V.roc_auc(g.pred).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(
    "m7_average_precision",
    over(
        "pred",
        extra=_CUM,
        sql="SELECT round(sum(pos / CAST(p AS DOUBLE) * tp / (tp + fp)), 6) AS pr_auc FROM cum",
    ),
)
def average_precision(g: Given):
    return V.average_precision(g.pred).select(F.round("pr_auc", 6).alias("pr_auc"))


_AT = """
counted AS (SELECT count(*) FILTER (proba < {t} AND isFraud = 0) AS tn, count(*) FILTER (proba >= {t} AND isFraud = 0) AS fp,
  count(*) FILTER (proba < {t} AND isFraud = 1) AS fn, count(*) FILTER (proba >= {t} AND isFraud = 1) AS tp FROM pred)"""
_SCORES = """coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
  coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy"""


@query("m8_threshold_metrics", over("pred", extra=_AT.format(t="0.5::DOUBLE"), sql=f"SELECT {_SCORES} FROM counted"))
def threshold_metrics(g: Given):
    return V.threshold_metrics(g.pred, 0.5)


@query(
    "m9_confusion",
    over("pred", extra=_AT.format(t="0.5::DOUBLE"), sql="SELECT tn, fp, fn, tp, fn + tp AS support_fraud FROM counted"),
)
def confusion(g: Given):
    return V.confusion(g.pred, 0.5)


def _sweep_sql(start: int, stop: int) -> str:
    return f"""
sweep AS (SELECT threshold, tp, fp, fn, tn, {_SCORES} FROM (
  SELECT i / 100.0::DOUBLE AS threshold, count(*) FILTER (proba >= i / 100.0::DOUBLE AND isFraud = 1) AS tp,
    count(*) FILTER (proba >= i / 100.0::DOUBLE AND isFraud = 0) AS fp,
    count(*) FILTER (proba < i / 100.0::DOUBLE AND isFraud = 1) AS fn,
    count(*) FILTER (proba < i / 100.0::DOUBLE AND isFraud = 0) AS tn
  FROM pred, range({start}, {stop}) r(i) GROUP BY i))"""


@query("m10_threshold_sweep", over("pred", extra=_sweep_sql(10, 90), sql="SELECT * FROM sweep"))
def threshold_sweep(g: Given):
    return V.threshold_sweep(g.pred)


@query("m10_threshold_sweep_wide", over("pred", extra=_sweep_sql(5, 95), sql="SELECT * FROM sweep"))
def threshold_sweep_wide(g: Given):
    return V.threshold_sweep(g.pred, *V.DEMO_SWEEP)


@query(
    "w7_best_threshold",
    over("pred", extra=_sweep_sql(10, 90), sql="SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1"),
)
def best_threshold(g: Given):
    return V.best_threshold(V.threshold_sweep(g.pred))


@query(
    "m11_roc_points",
    over(
        "pred",
        extra=_CUM,
        sql="SELECT proba AS threshold, fp / CAST(n AS DOUBLE) AS fpr, tp / CAST(p AS DOUBLE) AS tpr FROM cum",
    ),
)
def roc_points(g: Given):
    return V.roc_points(g.pred)


@query(
    "m12_pr_points",
    over(
        "pred",
        extra=_CUM,
        sql="SELECT proba AS threshold, tp / CAST(p AS DOUBLE) AS recall, CAST(tp AS DOUBLE) / (tp + fp) AS precision FROM cum",
    ),
)
def pr_points(g: Given):
    return V.pr_points(g.pred)


@query(
    "m16_recall_at_precision",
    over(
        "pred",
        extra=_CUM,
        sql="SELECT max(tp / CAST(p AS DOUBLE)) AS recall FROM cum WHERE CAST(tp AS DOUBLE) / (tp + fp) >= 0.8",
    ),
)
def recall_at_precision(g: Given):
    return V.recall_at_precision(g.pred, 0.8)


def _metrics_sql(src: str, t: str) -> str:
    """Metric rows of one score column at a threshold."""
    return f"""
SELECT unnest(['precision', 'recall', 'f1', 'accuracy', 'tn', 'fp', 'fn', 'tp', 'support_fraud']) AS metric,
  unnest([precision, recall, f1, accuracy, tn, fp, fn, tp, fn + tp]) AS value
FROM (SELECT *, {_SCORES} FROM (SELECT count(*) FILTER (proba < {t} AND isFraud = 0) AS tn,
  count(*) FILTER (proba >= {t} AND isFraud = 0) AS fp, count(*) FILTER (proba < {t} AND isFraud = 1) AS fn,
  count(*) FILTER (proba >= {t} AND isFraud = 1) AS tp FROM {src}))
UNION ALL SELECT unnest(['roc_auc', 'pr_auc']), unnest([sum(neg * (2 * (tp - pos) + pos)) / (2.0::DOUBLE * sum(pos) * sum(neg)),
  sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(pos)])
FROM (SELECT pos, neg, sum(pos) OVER (ORDER BY proba DESC) AS tp, sum(neg) OVER (ORDER BY proba DESC) AS fp
  FROM (SELECT proba, CAST(sum(isFraud) AS DOUBLE) AS pos, CAST(sum(1 - isFraud) AS DOUBLE) AS neg FROM {src} GROUP BY proba))"""


_WEAK = """
weak AS (SELECT TransactionID, isFraud, (2 + 20 * isFraud + (TransactionID * 7919) % 61) / 100.0::DOUBLE AS proba FROM tx)"""


def _weak(g: Given):
    """A second score with less separation, standing for the baseline."""
    steps = F.lit(2) + F.lit(20) * F.col("isFraud") + F.pmod(F.col("TransactionID") * 7919, F.lit(61))
    return g.tx.select("TransactionID", "isFraud", (steps / F.lit(100.0)).alias("proba"))


@query(
    "m14_compare",
    over(
        "pred",
        extra=_WEAK + ",\na AS (" + _metrics_sql("weak", "0.5::DOUBLE") + "),\nb AS (" + _metrics_sql("pred", "0.6::DOUBLE") + ")",
        sql="""SELECT a.metric, round(a.value, 6) AS baseline, round(b.value, 6) AS enhanced, round(b.value - a.value, 6) AS delta,
  CASE WHEN a.metric IN ('roc_auc', 'pr_auc', 'precision', 'recall', 'f1', 'accuracy')
    THEN round(100.0::DOUBLE * (b.value - a.value) / nullif(a.value, 0), 6) END AS lift_pct,
  CASE WHEN a.metric = 'tp' THEN CAST(b.value - a.value AS BIGINT) END AS extra_frauds_caught,
  CASE WHEN a.metric = 'fp' THEN CAST(a.value - b.value AS BIGINT) END AS fewer_false_alarms
FROM a JOIN b ON a.metric = b.metric""",
    ),
)
def compare(g: Given):
    out = V.compare(V.metrics_at(_weak(g), 0.5), V.metrics_at(g.pred, 0.6))
    rounded = ("baseline", "enhanced", "delta", "lift_pct")
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "m15_log_run",
    over(
        "pred",
        extra=_WEAK + ",\na AS (" + _metrics_sql("weak", "0.5::DOUBLE") + "),\nb AS (" + _metrics_sql("pred", "0.6::DOUBLE") + ")",
        sql="""SELECT 'tabular' AS run_name, CAST(1 AS BIGINT) AS logged_at, 'metric' AS kind, metric AS name, round(value, 4) AS value FROM a
UNION ALL SELECT 'enhanced', 3, 'metric', metric, round(value, 4) FROM b
UNION ALL SELECT 'tabular', 1, 'param', 'n_features', 5 UNION ALL SELECT 'enhanced', 3, 'param', 'n_features', 27""",
    ),
)
def log_run(g: Given):
    """Three runs are logged; the second `enhanced` run replaces the first."""
    path = scratch_path(g.spark, "runs")
    V.log_run(path, V.run_record("tabular", 1, {"n_features": "5"}, V.metrics_at(_weak(g), 0.5)))
    V.log_run(path, V.run_record("enhanced", 2, {"n_features": "5"}, V.metrics_at(_weak(g), 0.6)))
    V.log_run(path, V.run_record("enhanced", 3, {"n_features": "27"}, V.metrics_at(g.pred, 0.6)))
    runs = V.read_runs(g.spark.read.parquet(path))
    return runs.withColumn("value", F.col("value").cast("double"))


@query(
    "m17_metrics_from_saved",
    over(
        "pred",
        extra=_sweep_sql(10, 90)
        + ",\nbest AS (SELECT threshold FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)",
        sql="SELECT metric, round(value, 6) AS value FROM ("
        + _metrics_sql("pred", "(SELECT threshold FROM best)")
        + " UNION ALL SELECT 'threshold', threshold FROM best)",
    ),
)
def metrics_from_saved(g: Given):
    path = scratch_path(g.spark, "predictions")
    V.save_predictions(g.pred, path)
    out = V.metrics_from(T.read_features(g.spark, path))
    return out.withColumn("value", F.round("value", 6))
