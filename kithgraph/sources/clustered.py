"""Tables clustered by a key into range blocks with a block index, for reads of single keys.

`write_clustered` deals rows into ranges of the key by Spark's range partitioning and
writes each range as a folder of its own. The index has one row per block with its first
and last key. `read_clustered` looks the wanted keys up in the index and opens the blocks
that may hold them, and no others; inside a block the rows are sorted, so row groups are
skipped, too. A key with more rows than a block goes on over several blocks if `tie`
columns tell its rows apart.

The driver holds the names of the blocks that a read opens, as it does in any scan.

Defined cases: rows with a null in a key column are not stored (no wanted key is null);
repeated rows are kept; an empty table is stored and reads as empty; a key that is not
there, or no key at all, gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000
BLOCK = "_block"


def write_clustered(df: DataFrame, key: Sequence[str], path: str, tie: Sequence[str] = (), rows: int = BLOCK_ROWS) -> None:
    """Write `df` in blocks of about `rows` rows; `df` is read twice, so it should be cheap or stored."""
    spark, key = df.sparkSession, list(key)
    df = df.dropna(subset=key)
    blocks = max(1, -(-df.count() // rows))
    ranged = df.repartitionByRange(blocks, *key, *tie).withColumn(BLOCK, F.spark_partition_id())
    ordered = ranged.sortWithinPartitions(BLOCK, *key, *tie)
    ordered.write.mode("overwrite").partitionBy(BLOCK).parquet(f"{path}/blocks")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/empty")  # keeps the columns of an empty table
    # The borders come from what was written, in one scan of the key columns.
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    stored = spark.read.schema(f"{kinds}, {BLOCK} int").parquet(f"{path}/blocks")
    at = F.struct(*key)
    index = stored.groupBy(BLOCK).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def blocks_of(spark: SparkSession, path: str, key: Sequence[str], wanted: Sequence[tuple]) -> list[int]:
    """The blocks that may hold one of the `wanted` keys."""
    index = spark.read.parquet(f"{path}/index")
    kinds = {f.name: f.dataType for f in index.schema["first"].dataType}
    values = [F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(key, one, strict=True)]) for one in wanted]
    if not values:
        return []
    asked = F.array(*values)
    held = index.filter(F.exists(asked, lambda one: (F.col("first") <= one) & (one <= F.col("last"))))
    return sorted(r[0] for r in held.select(BLOCK).collect())


def read_clustered(spark: SparkSession, path: str, key: Sequence[str], wanted: Sequence[tuple]) -> DataFrame:
    """All rows with one of the `wanted` keys, a few keys given as tuples in the order of `key`."""
    empty = spark.read.parquet(f"{path}/empty")
    blocks = blocks_of(spark, path, key, wanted)
    if not blocks:
        return empty
    stored = spark.read.schema(empty.schema).parquet(*[f"{path}/blocks/{BLOCK}={b}" for b in blocks])
    match = F.lit(False)
    for one in wanted:
        same = F.lit(True)
        for k, v in zip(key, one, strict=True):
            same = same & (F.col(k) == F.lit(v))
        match = match | same
    return stored.filter(match)
