"""Line dedup over levelled sorted runs of line hashes, DataFrame functions only.

Documents come in batches of ascending doc_id. The distinct line keys of a batch are
merge-joined against the runs of all earlier batches; keys that no run holds become a run
of their own. When a level has `fanout` runs they are merged into one run of the next
level, so a key is rewritten a logarithmic number of times. A run is a Parquet table in
the shared folder, sorted by the two 64-bit hashes of the key.

A common line is no hot key: a batch is reduced to one row per key before any shuffle
(smallest and largest doc_id), and the join back to the lines splits under adaptive
execution.

Defined cases: a null or empty text is one empty line; a null doc_id ranks after all
others; rows with the same doc_id are one document when it comes to who holds a line;
equal rows are treated alike and both returned; an empty table gives no rows; other
columns are carried along and may have any name.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.session import scratch_path

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 2**63 - 1
MIN_KEY = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(line: Column) -> Column:
    """128 bits of a key as two seeded hashes."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class Runs:
    """The levelled index: sorted tables of (h1, h2), no key in two of them."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.levels: dict[int, list[str]] = defaultdict(list)

    def read(self) -> DataFrame | None:
        paths = [p for level in self.levels.values() for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, keys: DataFrame, level: int = 0) -> None:
        path = scratch_path(self.spark, f"lines-run-{level}")
        write_sorted(keys.select("h1", "h2"), path)
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self.spark.read.parquet(*self.levels.pop(level))
            self.add(merged, level + 1)


def write_sorted(keys: DataFrame, path: str) -> None:
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys.repartition(parts, "h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(path)


def repeated_lines(docs: DataFrame, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(_doc, _text, gone): sorted 1-based positions of the lines each document loses.

    `docs` has `_doc` (doc_id without nulls), `_text` (hash of the text) and `lines`.
    """
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("_doc", shares).alias("c")).first()["c"] or []
    batch = sum((F.when(F.col("_doc") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = (
        docs.select("_doc", "_text", batch.alias("batch"), F.posexplode("lines").alias("pos", "line"))
        .filter(F.char_length(F.btrim("line", F.lit(BLANKS))) >= MIN_KEY)
        .select("batch", "_doc", "_text", (F.col("pos") + 1).alias("pos"), key_hash(F.col("line")).alias("k"))
        .select("batch", "_doc", "_text", "pos", "k.h1", "k.h2")
    )
    runs, found = Runs(spark, fanout), scratch_path(spark, "lines-found")
    for b in range(len(cuts) + 1):
        keys = (
            lines.filter(F.col("batch") == b)
            .groupBy("h1", "h2")
            .agg(F.min("_doc").alias("first"), F.max("_doc").alias("last"))
        )
        known = runs.read()
        if known is None:
            keys = keys.withColumn("old", F.lit(False))
        else:
            known = known.withColumn("old", F.lit(True)).hint("merge")
            keys = keys.join(known, ["h1", "h2"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
        path = f"{found}/batch={b}"
        write_sorted(keys, path)
        if b < len(cuts):
            runs.add(spark.read.parquet(path).filter(~F.col("old")))
    twice = (
        spark.read.parquet(found)
        .filter(F.col("old") | (F.col("first") != F.col("last")))
        .select("batch", "h1", "h2", F.when(~F.col("old"), F.col("first")).alias("keeper"))
    )
    return (
        lines.join(twice, ["batch", "h1", "h2"])
        .filter(~F.col("_doc").eqNullSafe(F.col("keeper")))
        .groupBy("_doc", "_text")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )


def _kept(lines: Column, gone: Column) -> Column:
    """The stretches between the dropped positions."""
    edges = F.concat(F.array(F.lit(0)), gone, F.array(F.size(lines) + 1))
    stretch = F.transform(
        F.sequence(F.lit(1), F.size(gone) + 1),
        lambda i: F.slice(
            lines, F.element_at(edges, i) + 1, F.element_at(edges, i + 1) - F.element_at(edges, i) - 1
        ),
    )
    return F.flatten(stretch)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 2
) -> DataFrame:
    """`docs` as struct `row`, with its `text` after dedup, `n_lines` and `n_dropped`.

    A line goes if its key (blanks stripped, A-Z lowered, 10 code points or more) is also
    in a document with a smaller doc_id.
    """
    marked = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_doc"),
        F.xxhash64(text_col).alias("_text"),
        lines_of(F.col(text_col)).alias("lines"),
    )
    gone = repeated_lines(marked.select("_doc", "_text", "lines"), batches, fanout)
    out = marked.drop("lines").join(gone, ["_doc", "_text"], "left")
    lines = lines_of(F.col(f"row.{text_col}"))
    return out.select(
        "row",
        F.when(F.col("gone").isNull(), F.coalesce(f"row.{text_col}", F.lit("")))
        .otherwise(F.array_join(_kept(lines, F.col("gone")), "\n"))
        .alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
), l AS (
  SELECT r, doc_id, o, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), g AS (
  SELECT key, min(o) AS keeper FROM k WHERE length(key) >= 10
  GROUP BY key HAVING min(o) <> max(o)
), m AS (
  SELECT k.*, g.key IS NOT NULL AND k.o <> g.keeper AS gone FROM k LEFT JOIN g USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
