"""Reading, writing and merging of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NA_TEXT = ("", "NA", "NaN", "nan", "null", "None", "N/A")  # text that stands for a missing value

# The text columns of the raw tables; every other column is a number.
TRANSACTION_CATEGORIES = (
    "ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain",
    "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9",
)
IDENTITY_CATEGORIES = (
    "id_12", "id_15", "id_16", "id_23", "id_27", "id_28", "id_29", "id_30", "id_31",
    "id_33", "id_34", "id_35", "id_36", "id_37", "id_38", "DeviceType", "DeviceInfo",
)
TEXT_COLUMNS = (*TRANSACTION_CATEGORIES, *IDENTITY_CATEGORIES, "data_split")
LONG_COLUMNS = ("TransactionID", "TransactionDT", "card1")
INT_COLUMNS = ("isFraud",)


def pinned_schema(columns: Sequence[str]) -> T.StructType:
    """The fixed types of raw columns, so that no read has to infer them."""

    def kind(c: str) -> T.DataType:
        if c in TEXT_COLUMNS:
            return T.StringType()
        if c in LONG_COLUMNS:
            return T.LongType()
        return T.IntegerType() if c in INT_COLUMNS else T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    key: str = "TransactionID",
    fmt: str = "csv",
) -> DataFrame:
    """Read a headered CSV or Parquet table.

    CSV values that stand for "missing" become null whatever the column type. CSV columns
    are found by name, in any order; one that is not there raises an error. `columns`
    narrows the scan; `limit` takes the first rows by `key`.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        # Columns go by their name in the header; a part with another header is an error.
        raw = spark.read.csv(path, header=True, enforceSchema=False)
        if schema is None:
            schema = pinned_schema(raw.columns)
        absent = [f.name for f in schema if f.name not in raw.columns]
        if absent:
            raise ValueError(f"{path} has no column {', '.join(absent)}")
        typed = []
        for f in schema:
            value = F.when(~F.trim(f.name).isin(*NA_TEXT), F.col(f.name))
            if isinstance(f.dataType, T.StringType):
                typed.append(value.alias(f.name))
            elif isinstance(f.dataType, (T.LongType, T.IntegerType)):
                whole = F.coalesce(
                    F.trim(value).try_cast(f.dataType),
                    F.trim(value).try_cast("double").try_cast(f.dataType),
                )
                typed.append(whole.alias(f.name))
            else:
                typed.append(F.trim(value).try_cast(f.dataType).alias(f.name))
        df = raw.select(*typed)
    if columns is not None:
        df = df.select(*columns)
    return first_rows(df, limit, key) if limit is not None else df


def first_rows(df: DataFrame, n: int, key: str = "TransactionID") -> DataFrame:
    """The first n rows by key: a repeatable subset for trial loads."""
    return df.orderBy(key).limit(n)


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def read_features(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns is not None else df


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables, partitioned by type so that a typed read prunes folders.

    Edges are sorted by target inside each file, which lets a read of one entity skip row groups.
    """
    edges = edges.sortWithinPartitions("rel_type", "dst")
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def build_dataset(tx: DataFrame, features: DataFrame, embedding: DataFrame) -> DataFrame:
    """Transactions with graph features and embedding columns, all transactions kept."""
    features = features.withColumnRenamed("transactionId", "TransactionID")
    embedding = embedding.withColumnRenamed("transactionId", "TransactionID")
    return tx.join(features, "TransactionID", "left").join(embedding, "TransactionID", "left")


def export_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Selected columns as headered CSV parts, blanks inside values kept."""
    df.select(*columns).write.mode("overwrite").csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def upsert_nodes(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Insert or replace by key; of several rows for one key the highest version wins.

    Existing rows count as older than any incoming row. The aggregate combines map-side,
    so a key that arrives many times costs one row per task.
    """
    props = [c for c in existing.columns if c not in (key, version)]
    order = F.struct("_new", version)
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    merged = both.groupBy(key).agg(
        F.max_by(F.struct(version, *props), order).alias("_row")
    )
    return merged.select(key, "_row.*").select(*existing.columns)


def upsert_edges(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Add edges that do not exist yet; an existing edge keeps its property.

    Of several incoming rows for one edge the first by `order` is created, a null order
    counting as the last; ties go to the smallest properties.
    """
    ends = ["src", "dst", "rel_type"]
    props = [c for c in existing.columns if c not in ends]
    new = incoming.join(existing.select(*ends), ends, "left_anti")
    if not props:
        return existing.unionByName(new.select(*ends).distinct())
    rank = F.struct(F.col(order).isNull().alias("_late"), F.col(order).alias("_order"), *props)
    first = new.groupBy(*ends).agg(F.min_by(F.struct(*props), rank).alias("_row"))
    return existing.unionByName(first.select(*ends, "_row.*"))
