"""Per-transaction feature frames: null policy, combination and the two published layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.edges import RELS
from kithgraph.operators.stats import scoped_stats

# The feature names of the two published frames.
STATS = ("tx_count", "fraud_count", "fraud_rate")
V1_ENTITIES = ("USED_CARD", "PAYER_EMAIL", "BILLED_TO", "USED_DEVICE")
V2_ENTITIES = (
    "USED_CARD", "PAYER_EMAIL", "RECIPIENT_EMAIL", "BILLED_TO", "USED_DEVICE", "HAS_OS_BROWSER",
)
COMPONENT_FEATURES = (
    "componentId", "component_size", "component_fraud_count", "component_fraud_rate",
)
FLAGS = ("is_proxy", "prev_card_is_fraud")
GAP = "prev_card_dt_gap"


def entity_columns(rel_types: Sequence[str]) -> list[str]:
    return [f"{RELS[r].prefix}_{s}" for r in rel_types for s in STATS]


V1_FEATURES = [*COMPONENT_FEATURES, *entity_columns(V1_ENTITIES)]
V2_FEATURES = [
    *entity_columns(V2_ENTITIES), "is_proxy", "proxy_fraud_rate", "prev_card_is_fraud", GAP,
]


def fill_missing(df: DataFrame) -> DataFrame:
    """Null policy by column name: counts and flags 0, rates, gap and component -1."""
    doubles: dict[str, float] = {}
    for c in df.columns:
        if c.endswith(("_count", "_size")) or c in FLAGS:
            doubles[c] = 0.0
        elif c.endswith("_rate") or c == GAP:
            doubles[c] = -1.0
    df = df.withColumns({c: F.col(c).cast("double") for c in doubles}).fillna(doubles)
    return df.fillna({"componentId": -1}) if "componentId" in df.columns else df


def combine_features(frames: Sequence[DataFrame], ids: DataFrame) -> DataFrame:
    """All ids with the columns of every frame, filled by the null policy."""
    out = ids.select("transactionId")
    for frame in frames:
        out = out.join(frame, "transactionId", "left")
    return fill_missing(out)


def attach_features(df: DataFrame, features: DataFrame, key: str = "transactionId") -> DataFrame:
    """Features joined to raw transactions under the raw key name and type."""
    renamed = features.withColumn("TransactionID", F.col(key).cast("bigint"))
    if key != "TransactionID" and key.lower() != "transactionid":
        renamed = renamed.drop(key)
    return df.join(renamed, "TransactionID", "left")


def _wide(seen: DataFrame, rel_types: Sequence[str], proxy: bool) -> list:
    def pick(rel: str, c: str):
        return F.max(F.when(F.col("rel_type") == rel, F.col(c)))

    cols = [
        pick(r, s).cast("double").alias(f"{RELS[r].prefix}_{s}") for r in rel_types for s in STATS
    ]
    if proxy:
        cols.append(F.max(F.when(F.col("rel_type") == "VIA_PROXY", F.lit(1.0))).alias("is_proxy"))
        cols.append(pick("VIA_PROXY", "fraud_rate").alias("proxy_fraud_rate"))
    return cols


def feature_frame_v2(ids: DataFrame, links: DataFrame, previous: DataFrame, **scope) -> DataFrame:
    """The 22 features of every id in `ids`.

    All entity types are aggregated and attached in one pass over long rows. Ids and
    predecessor rows join the same long table, so one shuffle by transaction builds the
    wide frame, with every column present whatever the input.
    """
    seen = scoped_stats(links.filter(F.col("rel_type").isin(*V2_ENTITIES, "VIA_PROXY")), **scope)
    own = ids.select("transactionId")
    chain = previous.select("transactionId", "prev_card_is_fraud", GAP)
    long = seen.unionByName(own, allowMissingColumns=True).unionByName(
        chain, allowMissingColumns=True
    )
    wide = long.groupBy("transactionId").agg(
        *_wide(seen, V2_ENTITIES, proxy=True),
        F.max("prev_card_is_fraud").alias("prev_card_is_fraud"),
        F.max(GAP).alias(GAP),
    )
    return fill_missing(wide.select("transactionId", *V2_FEATURES))


def feature_frame_v1(ids: DataFrame, links: DataFrame, components: DataFrame, **scope) -> DataFrame:
    """The 16 features of the first layout: component stats and four entity types."""
    seen = scoped_stats(links.filter(F.col("rel_type").isin(*V1_ENTITIES)), **scope)
    long = (
        seen.unionByName(ids.select("transactionId"), allowMissingColumns=True)
        .unionByName(components, allowMissingColumns=True)
    )
    wide = long.groupBy("transactionId").agg(
        *[F.max(c).alias(c) for c in COMPONENT_FEATURES],
        *_wide(seen, V1_ENTITIES, proxy=False),
    )
    return fill_missing(wide.select("transactionId", *V1_FEATURES))


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in `ids`."""
    return df.join(ids.select(key), key, "left_semi")


def complement(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `ids`."""
    return df.join(ids.select(key), key, "left_anti")


def feature_sets(
    columns: Sequence[tuple[str, str]],
    graph: Sequence[str] = tuple(V2_FEATURES),
    emb_prefix: str = "emb_",
    drop: Sequence[str] = ("TransactionID", "TransactionDT", "isFraud", "transactionId"),
) -> dict[str, list[str]]:
    """Numeric model inputs by kind, from (name, type) pairs such as `df.dtypes`.

    Ids, label and leftover text columns are dropped; component columns carry no signal.
    """
    sets: dict[str, list[str]] = {"tabular": [], "graph": [], "embedding": []}
    for name, kind in columns:
        if name in drop or kind in ("string", "boolean") or name.startswith("component"):
            continue
        if name in graph:
            sets["graph"].append(name)
        elif name.startswith(emb_prefix):
            sets["embedding"].append(name)
        else:
            sets["tabular"].append(name)
    return sets


def temporal_split(df: DataFrame, split_dt: int, dt: str = "TransactionDT") -> tuple[DataFrame, DataFrame]:
    """Rows up to the split time, and rows after it."""
    return df.filter(F.col(dt) <= split_dt), df.filter(F.col(dt) > split_dt)


def with_split_label(df: DataFrame, split_dt: int, dt: str = "TransactionDT") -> DataFrame:
    return df.withColumn("data_split", F.when(F.col(dt) <= split_dt, "TRAIN").otherwise("TEST"))


