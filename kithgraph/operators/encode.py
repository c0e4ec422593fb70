"""Label encoding of text columns and the numeric feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.skew import attach, running_sums
from kithgraph.session import cut_lineage
from kithgraph.sources.tables import IDENTITY_CATEGORIES, TRANSACTION_CATEGORIES

MISSING = "__missing__"
SENTINEL = -999.0  # raw "no value"; -1 already means "no entity data"
MAX_BROADCAST_CODES = 200_000


def categories(df: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """The listed text columns that `df` has."""
    wanted = (*TRANSACTION_CATEGORIES, *IDENTITY_CATEGORIES) if wanted is None else wanted
    return [c for c in wanted if c in df.columns]


def _long(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value"),
            )
            for c in columns
        ]
    )
    return df.select(*keys, F.inline(cells))


def fit_encoder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, code): codes count from 0 in the order of the values.

    A missing value is a value of its own and always has a code, also in columns without
    nulls. The rank is a running sum over ranges of the sorted values, so a column of very
    many values, whatever they begin with, is not ranked in one task.
    """
    spark = df.sparkSession
    reserved = spark.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"), F.lit(MISSING).alias("value")
    )
    values = _long(df, columns).unionByName(reserved).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = values.repartitionByRange(parts, "column_name", "value")
    sliced = cut_lineage(ranges.withColumns({"_slice": F.spark_partition_id(), "_one": F.lit(1)}))
    ranked = running_sums(sliced, ["column_name"], "_slice", "value", {"rank": "_one"})
    return ranked.select("column_name", "value", (F.col("rank") - 1).cast("bigint").alias("code"))


def encode(
    df: DataFrame,
    encoder: DataFrame,
    columns: Sequence[str],
    max_codes: int = MAX_BROADCAST_CODES,
) -> DataFrame:
    """Replace text by codes; a value the encoder has not seen takes the missing code.

    The encoder is counted first. Up to `max_codes` entries it is broadcast column by
    column and the rows are not moved; beyond that the cells meet it in a shuffle join.
    Both ways give the same rows, whatever ids they have.
    """
    encoder = cut_lineage(encoder)
    if encoder.count() <= max_codes:
        return _encode_in_place(df, encoder, columns)
    return _encode_by_shuffle(df, encoder, columns)


def _encode_in_place(df: DataFrame, encoder: DataFrame, columns: Sequence[str]) -> DataFrame:
    order = df.columns
    for c in columns:
        codes = encoder.filter(F.col("column_name") == c)
        missing = codes.filter(F.col("value") == MISSING).select(F.max("code")).scalar()
        codes = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        text = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        df = (
            df.withColumn("_text", text)
            .join(F.broadcast(codes), F.col("_text") == F.col("_value"), "left")
            .withColumn(c, F.coalesce("_code", missing))
            .drop("_text", "_value", "_code")
        )
    return df.select(*order)


def _encode_by_shuffle(df: DataFrame, encoder: DataFrame, columns: Sequence[str]) -> DataFrame:
    key = "_row"  # a number of the row, stored with it, since ids may repeat or be missing
    order = df.columns
    df = cut_lineage(df.withColumn(key, F.monotonically_increasing_id()))
    cells = _long(df, columns, key)
    sizes = cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    known = sizes.join(encoder, ["column_name", "value"], "left")
    missing = encoder.filter(F.col("value") == MISSING).select(
        "column_name", F.col("code").alias("_missing")
    )
    # One row per encoded column.
    known = known.join(F.broadcast(missing), "column_name").select(
        "column_name", "value", "n", F.coalesce("code", "_missing").alias("code")
    )
    coded = attach(cells, known, ["column_name", "value"], "n", "inner")
    wide = coded.groupBy(key).agg(
        *[F.max(F.when(F.col("column_name") == c, F.col("code"))).alias(c) for c in columns]
    )
    return df.drop(*columns).join(wide, key, "left").select(*order)


def feature_matrix(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = ("TransactionID", "isFraud"),
    sentinel: float = SENTINEL,
) -> DataFrame:
    """`features` vector of numeric columns; missing values become the sentinel."""
    numeric = df.select(
        *keep, *[F.coalesce(F.col(c).cast("double"), F.lit(sentinel)).alias(f"f__{c}") for c in columns]
    )
    assembler = VectorAssembler(inputCols=[f"f__{c}" for c in columns], outputCol="features")
    return assembler.transform(numeric).select(*keep, "features")
