"""Data profiles, feature signal, distributions and key audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions import normalize as N
from kithgraph.operators.skew import SLICE_ROWS, equi_depth, running_sums

MISSING = -1.0  # fill value that means "no data" in feature frames
TINY = 1e-9
COSINE_EPS = 1e-10
TIERS = ((0.0, "complete"), (0.1, "low"), (0.5, "medium"), (0.9, "high"), (1.01, "sparse"))


def _unpivot(one_row: DataFrame, names: Sequence[str], fields: dict[str, str], label: str) -> DataFrame:
    """Turn `{field}__{name}` columns of a one-row frame into one row per name."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias(label), *[F.col(f"{p}__{c}").alias(f) for p, f in fields.items()])
            for c in names
        ]
    )
    return one_row.select(F.inline(rows))


def signal_summary(features: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each feature for fraud and for all others, "no data" left out, and their ratio."""
    df = features.join(labels.select("transactionId", "isFraud"), "transactionId", "left")
    fraud = F.coalesce(F.col("isFraud") == 1, F.lit(False))
    means = []
    for c in columns:
        value = F.when(F.col(c) != MISSING, F.col(c))
        means.append(F.avg(F.when(fraud, value)).alias(f"fraud__{c}"))
        means.append(F.avg(F.when(~fraud, value)).alias(f"legit__{c}"))
    out = _unpivot(
        df.agg(*means), columns, {"fraud": "fraud_mean", "legit": "legit_mean"}, "feature"
    )
    ratio = F.when(F.col("legit_mean") > TINY, F.col("fraud_mean") / F.col("legit_mean"))
    return out.withColumn("ratio", ratio)

SLOTS = 12  # log2; a relative error of 1.04 / sqrt(2 ** 12), 1.6 per cent


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage of each column, one scan for all columns."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"n__{c}") for c in columns]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                (F.col("_rows") - F.col(f"n__{c}")).alias("null_count"),
                N.pct(F.col("_rows") - F.col(f"n__{c}"), F.col("_rows"), 2).alias("missing_pct"),
            )
            for c in columns
        ]
    )
    return counts.select(F.inline(rows))


def missing_tiers(
    df: DataFrame, columns: Sequence[str] | None = None, bands: Sequence[tuple[float, str]] = TIERS
) -> DataFrame:
    """Columns grouped by the band their missing share falls in."""
    profile = null_profile(df, columns)
    share = F.col("missing_pct") / 100.0
    tier = None
    for limit, name in bands:
        tier = F.when(share <= limit, name) if tier is None else tier.when(share <= limit, name)
    return profile.select(tier.alias("tier"), "column_name").groupBy("tier").agg(
        F.count(F.lit(1)).alias("columns"),
        F.concat_ws(",", F.array_sort(F.collect_list("column_name"))).alias("members"),
    )


def cardinality(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column; `approx` needs one pass and fixed memory."""
    if approx:
        counts = df.agg(*[F.approx_count_distinct(c).alias(f"n__{c}") for c in columns])
        return _unpivot(counts, columns, {"n": "distinct_values"}, "column_name")
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(pairs))
        .distinct()
        .groupBy("column_name")
        .agg(F.count("value").alias("distinct_values"))
    )


def cardinality_sketches(df: DataFrame, columns: Sequence[str], by: str, log2_slots: int = SLOTS) -> DataFrame:
    """(by, column_name, sketch): one stored state per load and column, in one pass.

    States add up by `merge_sketches`, so a new day is sketched alone. Nulls do not count.
    """
    states = df.groupBy(by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), log2_slots).alias(f"s__{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s__{c}").alias("sketch")) for c in columns])
    return states.select(by, F.inline(rows))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """(column_name, distinct_values) over all loads; equal values of different loads count once."""
    merged = sketches.groupBy("column_name").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("column_name", F.hll_sketch_estimate("sketch").alias("distinct_values"))


def exact_median(df: DataFrame, column: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Median from a value histogram and two-level running counts, one row.

    Distinct values fall into slices of about `rows` at their own quantiles, so values that
    crowd together, near zero or anywhere, are spread over as many tasks as others.
    """
    value = F.col(column).cast("double")
    hist = df.select(value.alias("v")).dropna().groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    hist, slices = equi_depth(hist, ["v"], rows)
    summed = running_sums(hist, [], slices, "v", {"upto": "n"})
    total = hist.agg(F.sum("n")).scalar()
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    mid = summed.filter(
        ((F.col("upto") > low) & (F.col("upto") - F.col("n") <= low))
        | ((F.col("upto") > high) & (F.col("upto") - F.col("n") <= high))
    )
    return mid.agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def amount_profile(tx: DataFrame, approx: bool = False) -> DataFrame:
    """Smallest, largest and median amount and the time span in days, one row."""
    totals = tx.agg(
        F.min("TransactionAmt").alias("min_amount"),
        F.max("TransactionAmt").alias("max_amount"),
        ((F.max("TransactionDT") - F.min("TransactionDT")) / F.lit(N.DAY)).alias("span_days"),
        *([F.percentile_approx("TransactionAmt", 0.5).alias("median_amount")] if approx else []),
    )
    if approx:
        return totals.select("min_amount", "max_amount", "median_amount", "span_days")
    median = exact_median(tx, "TransactionAmt").scalar()
    return totals.select("min_amount", "max_amount", median.alias("median_amount"), "span_days")


def identity_coverage(joined: DataFrame) -> DataFrame:
    """Transactions, those with identity data, and their percentage."""
    return joined.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count(F.when(F.col("has_identity"), 1)).alias("with_identity"),
    ).withColumn("coverage_pct", N.pct(F.col("with_identity"), F.col("transactions"), 1))


def centroid_quality(emb: DataFrame, dim: int, label: str = "isFraud") -> DataFrame:
    """Cosine and Euclidean distance of the two class centroids, one row.

    The means combine map-side; what meets in one task is one centroid pair.
    """
    columns = [
        F.expr(f"avg(CASE WHEN {label} = {cls} THEN cast(embedding[{i}] AS double) END) AS c{cls}_{i}")
        for cls in (1, 0)
        for i in range(dim)
    ]
    means = emb.filter(F.col(label).isNotNull()).agg(*columns)
    pair = means.select(
        F.array(*[f"c1_{i}" for i in range(dim)]).alias("a"),
        F.array(*[f"c0_{i}" for i in range(dim)]).alias("b"),
    )

    def folded(column):
        return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)

    dot = folded(F.zip_with("a", "b", lambda x, y: x * y))
    norm_a = F.sqrt(folded(F.transform("a", lambda x: x * x)))
    norm_b = F.sqrt(folded(F.transform("b", lambda x: x * x)))
    l2 = F.sqrt(folded(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))))
    return pair.select((dot / (norm_a * norm_b + F.lit(COSINE_EPS))).alias("cosine"), l2.alias("l2"))


def class_histogram(df: DataFrame, column: str, bins: int = 30, label: str = "isFraud") -> DataFrame:
    """Equal-width histogram of a feature per class over the class's own range, as densities.

    Classes are 0 and 1, so the broadcast holds at most two range rows.
    """
    values = (
        df.filter(F.col(label).isin(0, 1))
        .select(F.col(label).alias("label"), F.col(column).cast("double").alias("v"))
        .dropna()
    )
    ranges = values.groupBy("label").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total")
    )
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        "label",
        "total",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    spot = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = (
        values.join(F.broadcast(ranges), "label")
        .groupBy(
            "label", "lo", "hi", "total", F.least(spot, F.lit(bins - 1)).cast("bigint").alias("bin")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(
        "label",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        "n",
        (F.col("n") / (F.col("total") * width)).alias("density"),
    )


def key_audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Duplicate node ids, duplicate edges and edge ends without a node, one row per check.

    Edge ends are made distinct before they meet the nodes, so a hub counts once.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    ids = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = edges.groupBy("src", "dst", "rel_type").agg(F.count(F.lit(1)).alias("n"))

    def check(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("check"), "violations"
        )

    return (
        check(ids.filter("n > 1"), "duplicate node ids")
        .unionByName(check(pairs.filter("n > 1"), "duplicate edges"))
        .unionByName(
            check(ends.join(ids.select("node_id"), "node_id", "left_anti"), "dangling edge ends")
        )
    )
