"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.catalog.registry import SPLIT, Given, over, query
from kithgraph.operators import edges as G
from kithgraph.operators import embed as X
from kithgraph.operators import features as Fe
from kithgraph.session import scratch_path
from kithgraph.sources import tables as T

TX_COLUMNS = (
    "TransactionID, TransactionDT, TransactionAmt, isFraud, ProductCD, card1, card4, card6,"
    " addr1, addr2, dist1, P_emaildomain, R_emaildomain, M1"
)


def _csv(g: Given) -> str:
    path = scratch_path(g.spark, "transactions-csv")
    T.export_csv(g.tx, g.tx.columns, path)
    return path


@query("s1_read_csv", over("tx", sql=f"SELECT {TX_COLUMNS} FROM tx"))
def read_csv(g: Given):
    return T.read_table(g.spark, _csv(g), schema=T.pinned_schema(g.tx.columns))


@query("s2_pruned_read", over("tx", sql="SELECT TransactionID, card1, TransactionDT FROM tx"))
def pruned_read(g: Given):
    return T.read_table(
        g.spark,
        _csv(g),
        schema=T.pinned_schema(g.tx.columns),
        columns=["TransactionID", "card1", "TransactionDT"],
    )


@query("s3_limited_load", over("tx", sql=f"SELECT {TX_COLUMNS} FROM tx ORDER BY TransactionID LIMIT 500"))
def limited_load(g: Given):
    return T.first_rows(g.tx, 500)


@query("s4_feature_parquet", over("features", sql="SELECT * FROM features"))
def feature_parquet(g: Given):
    path = scratch_path(g.spark, "features")
    T.write_features(g.features, path)
    return T.read_features(g.spark, path)


@query(
    "s5_build_dataset",
    over(
        "features",
        "vectors",
        sql=f"SELECT {', '.join('t.' + c.strip() for c in TX_COLUMNS.split(','))}, "
        + ", ".join(f"f.{c}" for c in Fe.V2_FEATURES)
        + ", "
        + ", ".join(f"v.embedding[{i + 1}] AS emb_{i}" for i in range(64))
        + " FROM tx t LEFT JOIN features f ON f.transactionId = t.TransactionID"
        " LEFT JOIN vectors v ON v.transactionId = t.TransactionID",
    ),
)
def build_dataset(g: Given):
    path = scratch_path(g.spark, "dataset")
    T.write_features(T.build_dataset(g.tx, g.features, X.expand_embedding(g.vectors, 64)), path)
    return T.read_features(g.spark, path)


CSV_COLUMNS = ["TransactionAmt", "ProductCD", "card1", "card4", "card6", "addr1", "addr2", "dist1"]


@query(
    "s6_export_csv_tabular",
    over(
        "tx",
        sql=f"SELECT {', '.join(CSV_COLUMNS)}, isFraud,"
        f" CASE WHEN TransactionDT <= {SPLIT} THEN 'TRAIN' ELSE 'TEST' END AS data_split FROM tx",
    ),
)
def export_csv_tabular(g: Given):
    return _exported(g, Fe.with_split_label(g.tx, SPLIT), CSV_COLUMNS)


@query(
    "s6_export_csv_enhanced",
    over(
        "features",
        sql=f"SELECT {', '.join('t.' + c for c in CSV_COLUMNS)}, {', '.join('f.' + c for c in Fe.V2_FEATURES)},"
        f" isFraud, CASE WHEN t.TransactionDT <= {SPLIT} THEN 'TRAIN' ELSE 'TEST' END AS data_split"
        " FROM tx t JOIN features f ON f.transactionId = t.TransactionID",
    ),
)
def export_csv_enhanced(g: Given):
    df = Fe.attach_features(g.tx, g.features)
    return _exported(g, Fe.with_split_label(df, SPLIT), [*CSV_COLUMNS, *Fe.V2_FEATURES])


def _exported(g: Given, df, columns):
    path = scratch_path(g.spark, "export")
    columns = [*columns, "isFraud", "data_split"]
    T.export_csv(df, columns, path)
    return T.read_table(g.spark, path, schema=T.pinned_schema(columns))


@query(
    "s7_upsert_nodes",
    over(
        "tx",
        sql=f"""SELECT card1, arg_max(TransactionAmt, TransactionID + CASE WHEN TransactionDT > {SPLIT} THEN 1000000000000 ELSE 0 END) AS last_amount,
  arg_max(ProductCD, TransactionID + CASE WHEN TransactionDT > {SPLIT} THEN 1000000000000 ELSE 0 END) AS last_product,
  coalesce(max(CASE WHEN TransactionDT > {SPLIT} THEN TransactionID END), max(TransactionID)) AS version
FROM tx WHERE card1 IS NOT NULL GROUP BY card1""",
    ),
)
def upsert_nodes(g: Given):
    """Card nodes as left by the later period's load over the earlier one."""
    rows = g.tx.filter("card1 IS NOT NULL").select(
        "card1",
        F.col("TransactionAmt").alias("last_amount"),
        F.col("ProductCD").alias("last_product"),
        F.col("TransactionID").alias("version"),
        "TransactionDT",
    )
    early, late = Fe.temporal_split(rows, SPLIT)
    return T.upsert_nodes(
        early.drop("TransactionDT"), late.drop("TransactionDT"), "card1", "version"
    )


@query(
    "s8_upsert_edges",
    over(
        "chain",
        sql=f"""SELECT 'Card:' || card_key AS src, 'Gap:' || CAST(dt_gap_seconds // 3600 AS VARCHAR) AS dst,
  'SEEN_GAP' AS rel_type,
  coalesce(min(CASE WHEN prev_dt <= {SPLIT} THEN prev_dt END), min(prev_dt)) AS first_dt
FROM chain GROUP BY ALL""",
    ),
)
def upsert_edges(g: Given):
    """Edges keep the property they were created with, whatever a later load brings."""
    rows = g.chain.select(
        G.node_id("Card", F.col("card")).alias("src"),
        G.node_id("Gap", F.floor(F.col("dt_gap_seconds") / 3600).cast("string")).alias("dst"),
        F.lit("SEEN_GAP").alias("rel_type"),
        F.col("prev_dt").alias("first_dt"),
    )
    early, late = Fe.temporal_split(rows, SPLIT, "first_dt")
    nothing = early.limit(0)
    stored = T.upsert_edges(nothing, early, "first_dt")
    return T.upsert_edges(stored, late, "first_dt")
