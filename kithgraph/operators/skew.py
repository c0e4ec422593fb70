"""Joins, windows and ordered sums that stay balanced when one key holds a large share of the rows.

For a join a key is *hot* when it holds more than 1/HOT_KEYS of all rows, so there are
fewer than HOT_KEYS hot keys whatever the data size. That count is the size bound behind
every broadcast in this module; every other key is small enough for one shuffle task.

For a window what counts is its number of rows: a key with more than SLICE_ROWS of them is
cut into slices of about SLICE_ROWS rows at quantiles of the window's order, however many
rows there are in all, and what crosses a border is carried over by a second window with
one row for each slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.session import cut_lineage

HOT_KEYS = 10_000
SLICE_ROWS = 100_000


def hot_rows(counts: DataFrame, n: str, limit: int = HOT_KEYS, min_rows: int = 0) -> DataFrame | None:
    """The fewer than `limit` rows of `counts` that hold over 1/limit of sum(n) each, as a local table.

    None if no key is hot. This runs a job: it is the size check in front of a broadcast.
    """
    total = counts.agg(F.sum(n)).scalar()
    found = counts.filter((F.col(n) * F.lit(limit) > total) & (F.col(n) >= min_rows))
    rows = found.toArrow()  # fewer than `limit` rows, by the filter above
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows.num_rows else None


def attach(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    n: str,
    how: str = "left",
    limit: int = HOT_KEYS,
    stay: bool = False,
) -> DataFrame:
    """Join `small` (one row per key, `n` = rows that key has in `big`) to `big`.

    `big` is read once and shuffled once. A hot key is salted: it gets as many salts as it
    holds 1/`limit` shares of all rows, fewer than 2 x `limit` over all keys, so no task
    receives more than about one share of it, and its row of `small` is repeated for each.
    The salt comes from the row itself, so a lost task deals the same way. Keys must not be
    null.

    With `stay` rows of hot keys are not shuffled but meet a bounded broadcast, at the
    price of reading `big` twice: right where its rows are wide, as pages are.
    """
    keys = list(keys)
    small = cut_lineage(small)  # it is counted here and joined below: compute it once
    hot = hot_rows(small, n, limit)
    if hot is None:
        return big.join(small, keys, how)
    if stay:
        near = big.join(F.broadcast(hot), keys, "inner")
        rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small, keys, how)
        return near.unionByName(rest)
    total = small.agg(F.sum(n)).scalar()
    salts = small.sparkSession.createDataFrame(
        hot.select(*keys, F.ceil(F.col(n) * limit / total).cast("int").alias("_salts")).toArrow()
    )
    marks = F.broadcast(salts)
    dealt = big.join(marks, keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_salts")), F.lit(0)).cast("int")
    )
    repeated = small.join(marks, keys, "left").select(
        *small.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt")
    )
    return dealt.drop("_salts").join(repeated, [*keys, "_salt"], how).drop("_salt")


def split_big(
    df: DataFrame, keys: Sequence[str], rows: int = SLICE_ROWS, counts: DataFrame | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of keys with at most `rows` rows, rows of larger keys); None where there are none.

    Below HOT_KEYS the larger keys are broadcast. If there are more of them, nothing can be
    told apart without sending a whole key to one task, so all rows count as large.
    `counts` may hold the rows per key as `_n` if there is a cheaper way to count them.
    """
    keys = list(keys)
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(counts.filter(F.col("_n") > rows).select(*keys))
    n = large.count()
    if n == 0:
        return df, None
    if n >= HOT_KEYS:
        return None, df
    known = F.broadcast(large)
    return df.join(known, keys, "left_anti"), df.join(known, keys, "left_semi")


def equi_depth(df: DataFrame, order: Sequence[str], rows: int = SLICE_ROWS) -> tuple[DataFrame, str | None]:
    """(`df` as a stored table, its slice column): slices of about `rows` rows that grow with `order`.

    Borders are quantiles of `order` over all rows, from Spark's range partitioning, so a
    key of any size and any pile-up of values is cut evenly; rows equal in `order` share a
    slice. The slice is stored with the row: a lost task cannot cut another way. No column
    (None) if `rows` rows are all there are.
    """
    stored = cut_lineage(df)
    n = stored.count()
    if n <= rows:
        return stored, None
    ranged = stored.repartitionByRange(-(-n // rows), *order)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id().cast("bigint"))), "_slice"


def slice_big(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS
) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows for a plain window over `keys`, the others with a `_slice` of their key)."""
    plain, big = split_big(df, keys, rows)
    if big is None:
        return plain, None
    sliced, column = equi_depth(big, [*keys, *order], rows)
    return plain, sliced if column else sliced.withColumn("_slice", F.lit(0).cast("bigint"))


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    slice_col: str | None,
    order: str,
    sums: dict[str, str],
    descending: bool = False,
    only: Column | None = None,
) -> DataFrame:
    """Running totals over `order` inside each group, ties included, as a two-level sum.

    Without `slice_col` every group is small enough for one window. With it (it must grow
    with `order`, and rows equal in `order` must share it) one window runs inside each
    (group, slice); the totals of earlier slices come from a second window over one row
    per slice. `only` says which rows lie in groups of several slices, so that the others
    skip the second.
    """
    group = list(group)

    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    inside = (
        Window.partitionBy(*group, *([slice_col] if slice_col else []))
        .orderBy(direction(order))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.withColumns({out: F.sum(c).over(inside) for out, c in sums.items()})
    if slice_col is None:
        return local
    several = df if only is None else df.filter(only)
    totals = several.groupBy(*group, slice_col).agg(
        *[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()]
    )
    before = (
        Window.partitionBy(*group)
        .orderBy(direction(slice_col))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *group, slice_col, *[F.sum(f"_t_{out}").over(before).alias(f"_c_{out}") for out in sums]
    )
    joined = local.join(carried, [*group, slice_col], "left")
    return joined.withColumns(
        {out: F.col(out) + F.coalesce(f"_c_{out}", F.lit(0)) for out in sums}
    ).drop(*[f"_c_{out}" for out in sums])
