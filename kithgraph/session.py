"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.parquet.compression.codec": "snappy",
}
FIXED = ("spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")


def build_session(app: str = "kithgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kithgraph-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends the growth of the plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_placed(df: DataFrame) -> DataFrame:
    """`cut_lineage` of rows partitioned by a key that later joins and groups need not shuffle again.

    An adaptive plan does not state how its result is partitioned and sorted, so a checkpoint
    of it forgets; a plan that is fixed beforehand does. Rows placed by some of the keys of a
    join are not shuffled for it either. `df` must not be planned yet.
    """
    conf = df.sparkSession.conf
    before = {key: conf.get(key) for key in FIXED}
    for key in FIXED:
        conf.set(key, "false")
    try:
        return cut_lineage(df)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def drop_shuffles(df: DataFrame) -> None:
    """Delete the shuffle files of `df`, which was computed and stored: the driver may keep them for long otherwise."""
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a result of `cut_lineage` or `cut_placed` that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        drop_path(df.sparkSession, file.get())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
