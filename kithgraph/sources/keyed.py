"""Stored tables with a unique key, merged by bucket: a load rewrites only the buckets it touches.

Rows fall into `buckets` buckets by a hash of the key. The manifest names for every bucket
the folder that holds it. A merge reads the touched buckets, combines them with the
incoming rows, writes them into a new folder and then a new manifest; files of all other
buckets stay as they are. The manifest comes last and its file appears whole, so a merge
that breaks off leaves the table as it was. Older versions stay readable. One merge at a
time: writers are not told apart.

`buckets` is fixed when the table is made: choose it so that a bucket fits a task
(buckets = bytes expected / 256 MB). The driver holds one manifest, a row per bucket.

Defined cases: a null is a key like any other; an empty load writes no data and no new
version; a table made from no rows has its columns and reads as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "_bucket"


def _bucketed(df: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    # xxhash64 passes over nulls, so the marks keep (null, x) and (x, null) in their places.
    parts = [p for k in key for p in (F.col(k), F.col(k).isNull())]
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, key: Sequence[str], buckets: int, path: str, version: int, kept: list[tuple]) -> None:
    spark = df.sparkSession
    folder = f"v{version}-{uuid.uuid4().hex[:8]}"  # a broken-off merge may have left files under another name
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _bucketed(df, key, buckets).repartition(min(buckets, parts), BUCKET)
    rows.write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    counts = spark.read.schema(f"{kinds}, {BUCKET} int").parquet(f"{path}/{folder}").groupBy(BUCKET).count()
    new = [(version, r[BUCKET], folder, r["count"]) for r in counts.collect()]  # `buckets` rows at most
    manifest = spark.createDataFrame(
        [*new, *kept, (version, -1, "", buckets)], f"version int, {BUCKET} int, folder string, n long"
    )
    manifest.coalesce(1).write.mode("append").partitionBy("version").parquet(f"{path}/manifest")


def create(df: DataFrame, key: Sequence[str], path: str, buckets: int = BUCKETS) -> None:
    """Make the table from rows with distinct keys."""
    df.limit(0).write.parquet(f"{path}/empty")
    _write(df, key, buckets, path, 1, [])


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, int, dict[int, tuple[str, int]]]:
    """(version, buckets, folder and rows of each filled bucket), the latest if no version is given."""
    every = spark.read.parquet(f"{path}/manifest")
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    rows = every.filter(F.col("version") == version).collect()
    if not rows:
        raise ValueError(f"{path} has no version {version}")
    held = {r[BUCKET]: (r["folder"], r["n"]) for r in rows}
    return version, held.pop(-1)[1], held


def _read(spark: SparkSession, path: str, held: dict[int, tuple[str, int]]) -> DataFrame:
    empty = spark.read.parquet(f"{path}/empty")
    if not held:
        return empty
    paths = [f"{path}/{folder}/{BUCKET}={b}" for b, (folder, _) in sorted(held.items())]
    return spark.read.schema(empty.schema).parquet(*paths)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of `version`, the latest by default."""
    return _read(spark, path, manifest(spark, path, version)[2])


def merge(
    path: str, key: Sequence[str], incoming: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]
) -> list[int]:
    """Store `how(existing, incoming)` for the buckets that `incoming` touches; returns these.

    `incoming` is read twice, so it should be cheap or stored. `how` may change or add rows
    with keys of `incoming` only: rows of other keys are in other files.
    """
    spark = incoming.sparkSession
    version, buckets, held = manifest(spark, path)
    touched = [r[0] for r in _bucketed(incoming, key, buckets).select(BUCKET).distinct().collect()]  # `buckets` at most
    if not touched:
        return []
    old = _read(spark, path, {b: held[b] for b in touched if b in held})
    kept = [(version + 1, b, folder, n) for b, (folder, n) in held.items() if b not in touched]
    _write(how(old, incoming), key, buckets, path, version + 1, kept)
    return sorted(touched)
