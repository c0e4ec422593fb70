"""Mixing sources to target weights by Pareto order sampling, DataFrame functions only.

Every source gets a target in words. Its ratio to the source's own words is the number of
copies each document is due: the whole part is certain, the fraction is the inclusion
probability p of one more copy. Documents get a uniform number u from a hash, and are
ranked by their odds over the inclusion odds, (u / (1 - u)) / (p / (1 - p)). Each source
takes the head of its order while the words fit what is left of its target. The document
that would overshoot is passed over, and what is still open is offered to the smaller
documents behind it, in the same order, in `TOP_UPS` more rounds.

Running words are a two-level sum (bins of u, then documents inside a bin), so a source
with a third of all rows is spread over `BINS` groups. The only window without a
partition runs over one row per source.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of
its own, last in the order; equal rows are interchangeable; an empty table gives no rows;
if no text has a word all targets are 0. The draw depends on the row alone, so a rerun
gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS = 4096
TOP_UPS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source with `source_size`.

    All words are shared by weight; no target passes `most` times its source. Sources
    with the smallest limit per unit of weight reach it first, so the ones held at their
    limit are a head of that order.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), place + 1)
    s = sizes.select("source", "source_size", w.cast("long").alias("w"), place.alias("place"))
    s = s.withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    over_all = Window.partitionBy()
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
        F.sum("source_size").over(over_all).alias("total"),
        F.sum("w").over(over_all).alias("w_all"),
    )
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("w_all") - F.col("w_before"))
    s = s.withColumn("held", F.col("cap") <= F.col("w") * level)
    held = {c: F.sum(F.when(F.col("held"), F.col(c)).otherwise(0)).over(over_all) for c in ("cap", "w")}
    s = s.withColumns({"held_cap": held["cap"], "held_w": held["w"]})
    rest = (F.col("total") - F.col("held_cap")).cast("double") / F.nullif(
        F.col("w_all") - F.col("held_w"), F.lit(0)
    )
    target = F.when(F.col("held"), F.col("cap").cast("double")).otherwise(F.col("w") * rest)
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _head(rows: DataFrame, most: str) -> DataFrame:
    """Mark as `fits` the head of each source's order whose words stay within `most`."""
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        F.col("source").alias("_source"),
        F.col("bin").alias("_bin"),
        F.coalesce(F.sum("in_bin").over(up_to), F.lit(0)).alias("before_bin"),
    )
    inside = (
        Window.partitionBy("source", "bin")
        .orderBy("odds", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = rows.withColumn("in_bin", F.sum("size").over(inside))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin"))
    return (
        running.join(bins, same)
        .withColumn("fits", F.col("before_bin") + F.col("in_bin") <= F.col(most))
        .drop("_source", "_bin", "before_bin", "in_bin")
    )


def pareto_copies(rows: DataFrame, targets: DataFrame, top_ups: int = TOP_UPS) -> DataFrame:
    """Add `copies` to (doc_id, source, size, u) given (source, source_size, target)."""
    named = targets.withColumnRenamed("source", "_source")
    due = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    whole = F.coalesce(F.floor(due), F.lit(0))
    p = F.col("due") - F.col("whole")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    rows = (
        rows.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumns({"due": due, "whole": whole})
        .withColumns(
            {
                "odds": F.when(p > 0, odds),
                "open": F.col("target") - F.col("whole") * F.col("source_size"),
                "bin": F.floor(F.col("u") * BINS),
                "extra": F.lit(0),
            }
        )
    )
    done = []
    for _ in range(top_ups + 1):
        asks = (F.col("size") > 0) & F.col("odds").isNotNull() & (F.col("size") <= F.col("open"))
        done.append(rows.filter(~F.coalesce(asks, F.lit(False))))
        tried = cut_lineage(_head(rows.filter(asks), "open"))
        done.append(tried.filter("fits").drop("fits").withColumn("extra", F.lit(1)))
        took = tried.groupBy(F.col("source").alias("_source")).agg(
            F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("took")
        )
        rows = (
            tried.filter(~F.col("fits"))
            .drop("fits")
            .join(took, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("open", F.col("open") - F.col("took"))
            .drop("_source", "took")
        )
    done.append(rows)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))


def _uniform() -> Column:
    """A number between 0 and 1 from a hash of id, source and text."""
    parts = (F.col("doc_id").cast("string"), F.col("source"), F.col("text"))
    seed = F.md5(F.encode(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in parts]), "UTF-8"))
    return (F.conv(F.substring(seed, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def draw(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u): words and the uniform number of each row."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", "source", size.cast("long").alias("size"), _uniform().alias("u"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size, u, source_size, target, copies), one row per row of `docs`."""
    rows = cut_lineage(draw(docs))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return pareto_copies(rows, cut_lineage(source_targets(sizes, weights, most)))


def repeat_to_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Equal rows are one row with the sum of their copies.
    """
    name = "_" + "_".join(docs.columns)  # a name that no column has
    key, other, copies, rank, number = (f"{name}{i}" for i in range(5))
    taken = (
        mix_sources(docs, weights, most)
        .groupBy(F.col("u").alias(other), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias(number))
        .agg(F.sum("copies").alias(copies))
        .filter(F.col(copies) > 0)
    )
    marked = docs.withColumns({key: _uniform(), name: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))})
    same = (F.col(key) == F.col(other)) & (F.col(name) == F.col(number))
    first = Window.partitionBy(key, name).orderBy(F.lit(0))
    one = marked.join(taken, same).withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1)
    return one.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(rank)).drop(rank)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def _round_sql(i: int) -> str:
    return f"""
a{i} AS (
  SELECT *, size > 0 AND odds IS NOT NULL AND size <= open AS asks FROM r{i}
), t{i} AS (
  SELECT *, sum(CASE WHEN asks THEN size END) OVER (
    PARTITION BY source, asks ORDER BY odds, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) <= open AND asks AS fits
  FROM a{i}
), r{i + 1} AS (
  SELECT doc_id, source, size, source_size, target, whole,
         open - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS open,
         extra + CASE WHEN fits THEN 1 ELSE 0 END AS extra,
         CASE WHEN fits THEN NULL ELSE odds END AS odds
  FROM t{i}
)"""


SQL = (
    """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (('0x' || left(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')), 13))::bigint
          + 0.5::double) / 4503599627370496.0::double AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::bigint AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap,
         coalesce(sum(3 * source_size) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before,
         sum(source_size) OVER () AS total, sum(w) OVER () AS w_all
  FROM s WINDOW b AS (ORDER BY 3 * source_size / w::double, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT *, cap <= w * ((total - cap_before)::double / (w_all - w_before)::double) AS held FROM c
), g AS (
  SELECT *, sum(CASE WHEN held THEN cap ELSE 0 END) OVER () AS held_cap, sum(CASE WHEN held THEN w ELSE 0 END) OVER () AS held_w FROM h
), target AS (
  SELECT source, source_size,
         coalesce(CASE WHEN held THEN cap::double ELSE w * ((total - held_cap)::double / nullif(w_all - held_w, 0)::double) END, 0) AS target
  FROM g
), j AS (
  SELECT d.*, source_size, target, target / nullif(source_size, 0)::double AS due
  FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source
), k AS (
  SELECT *, coalesce(floor(due), 0) AS whole, due - coalesce(floor(due), 0) AS p FROM j
), r0 AS (
  SELECT doc_id, source, size, source_size, target, whole, target - whole * source_size AS open, 0 AS extra,
         CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds
  FROM k
),"""
    + ",".join(_round_sql(i) for i in range(TOP_UPS + 1))
    + f"""
SELECT doc_id, size::bigint AS size, source_size, target, ((whole + extra) * size)::bigint AS taken FROM r{TOP_UPS + 1}
"""
)
