"""Per-card order: neighbours in time, chains and rolling lookbacks.

A card (or any entity) with more than SLICE_ROWS rows is cut into slices of that depth at
quantiles of (time, id), so no window sorts more than one slice, at any number of rows in
all or in one second; what crosses a border is carried over by a second, small window with
one row per slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions import normalize as N
from kithgraph.operators.skew import SLICE_ROWS, attach, equi_depth, running_sums, slice_big, split_big
from kithgraph.session import cut_lineage

WINDOW_HOURS = 24
CHAIN_LENGTH = 5
WINDOW_ROWS = 4_000  # a sliding frame is added up again for each row: longer entities go by running sums


def card_times(tx: DataFrame) -> DataFrame:
    """(id, card, dt, is_fraud) of the transactions that have all three keys."""
    return tx.select(
        F.col("TransactionID").cast("bigint").alias("id"),
        N.card_key("card1").alias("card"),
        F.col("TransactionDT").cast("bigint").alias("dt"),
        (F.col("isFraud") if "isFraud" in tx.columns else F.lit(None)).cast("int").alias("is_fraud"),
    ).dropna(subset=["id", "card", "dt"])


def _neighbour(times: DataFrame, step: int, rows: int) -> DataFrame:
    """Add `_near`: the next (step 1) or previous (step -1) row of the card by (dt, id)."""
    row = F.struct("dt", "id", "is_fraud")
    if step < 0:
        order, by_slice, edge = [F.asc("dt"), F.asc("id")], F.asc("_slice"), F.max
    else:
        order, by_slice, edge = [F.desc("dt"), F.desc("id")], F.desc("_slice"), F.min
    plain, sliced = slice_big(times, ["card"], ["dt", "id"], rows)
    parts = []
    if plain is not None:
        parts.append(plain.withColumn("_near", F.lag(row).over(Window.partitionBy("card").orderBy(*order))))
    if sliced is not None:
        inside = sliced.withColumn("_near", F.lag(row).over(Window.partitionBy("card", "_slice").orderBy(*order)))
        border = sliced.groupBy("card", "_slice").agg(edge(row).alias("_edge"))
        before = Window.partitionBy("card").orderBy(by_slice)
        carried = border.select("card", "_slice", F.lag("_edge").over(before).alias("_carry"))
        parts.append(
            inside.join(carried, ["card", "_slice"])
            .withColumn("_near", F.coalesce("_near", "_carry"))
            .drop("_carry", "_slice")
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def next_on_card(tx: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """Each transaction with the id and time of the next one on its card (null at the end)."""
    near = _neighbour(card_times(tx), 1, rows)
    return near.select(
        "id",
        "card",
        "dt",
        F.col("_near.id").alias("next_id"),
        F.col("_near.dt").alias("next_dt"),
    )


def previous_on_card(tx: DataFrame, window_hours: int = WINDOW_HOURS, rows: int = SLICE_ROWS) -> DataFrame:
    """Each transaction whose predecessor on the card lies within the window."""
    near = _neighbour(card_times(tx), -1, rows)
    gap = F.col("dt") - F.col("_near.dt")
    return near.filter((gap >= 0) & (gap <= window_hours * 3600)).select(
        F.col("_near.id").alias("prev_id"),
        F.col("id").alias("curr_id"),
        gap.alias("dt_gap_seconds"),
        F.col("_near.is_fraud").alias("prev_is_fraud"),
        F.col("is_fraud").alias("curr_is_fraud"),
        "card",
        F.col("_near.dt").alias("prev_dt"),
    )


def prev_on_card(
    tx: DataFrame, window_hours: int = WINDOW_HOURS, limit: int | None = None, **slicing: int
) -> DataFrame:
    """Consecutive same-card pairs within the window: (prev_id, curr_id, dt_gap_seconds)."""
    pairs = previous_on_card(tx, window_hours, **slicing)
    if limit is not None:
        pairs = pairs.orderBy(F.col("card").cast("bigint"), "prev_dt", "prev_id").limit(limit)
    return pairs.select("prev_id", "curr_id", "dt_gap_seconds")


def prev_features(chain: DataFrame) -> DataFrame:
    """(transactionId, prev_card_is_fraud, prev_card_dt_gap) for rows with a predecessor."""
    return chain.select(
        F.col("curr_id").alias("transactionId"),
        F.col("prev_is_fraud").cast("double").alias("prev_card_is_fraud"),
        F.col("dt_gap_seconds").cast("double").alias("prev_card_dt_gap"),
    )


def prev_is_fraud(tx: DataFrame, window_hours: int = WINDOW_HOURS, **slicing: int) -> DataFrame:
    """Label of the predecessor within the window, 0 without one."""
    return _filled(tx, window_hours, slicing, "prev_card_is_fraud", 0.0)


def prev_gap(tx: DataFrame, window_hours: int = WINDOW_HOURS, **slicing: int) -> DataFrame:
    """Seconds since the predecessor within the window, -1 without one."""
    return _filled(tx, window_hours, slicing, "prev_card_dt_gap", -1.0)


def _filled(tx: DataFrame, hours: int, slicing: dict, column: str, missing: float) -> DataFrame:
    found = prev_features(previous_on_card(tx, hours, **slicing)).select("transactionId", column)
    ids = tx.select(F.col("TransactionID").cast("bigint").alias("transactionId"))
    return ids.join(found, "transactionId", "left").fillna({column: missing})


def card_chain_rate(tx: DataFrame, n: int = CHAIN_LENGTH, rows: int = SLICE_ROWS) -> DataFrame:
    """Share of fraud among the card's last n earlier transactions, null without any.

    The last n rows before a slice lie in the n slices before it; they join the slice as
    extra rows that feed the window and are dropped afterwards.
    """
    row = F.struct("dt", "id", "is_fraud")
    share = F.avg(N.is_fraud("is_fraud").cast("double"))
    out = (F.col("id").alias("transactionId"), "card_chain_fraud_rate")
    plain, sliced = slice_big(card_times(tx), ["card"], ["dt", "id"], rows)
    parts = []
    if plain is not None:
        last = Window.partitionBy("card").orderBy("dt", "id").rowsBetween(-n, -1)
        parts.append(plain.withColumn("card_chain_fraud_rate", share.over(last)).select(*out))
    if sliced is not None:
        newest = Window.partitionBy("card", "_slice").orderBy(F.desc("dt"), F.desc("id"))
        tails = (
            sliced.withColumn("_rank", F.row_number().over(newest))
            .filter(F.col("_rank") <= n)
            .groupBy("card", "_slice")
            .agg(F.collect_list(row).alias("_tail"))
        )
        earlier = Window.partitionBy("card").orderBy("_slice").rowsBetween(-n, -1)
        extra = (
            tails.select("card", "_slice", F.flatten(F.collect_list("_tail").over(earlier)).alias("_all"))
            .select("card", "_slice", F.inline(F.slice(F.reverse(F.array_sort("_all")), 1, n)))
            .withColumn("_extra", F.lit(True))
        )
        own = sliced.select("card", "_slice", "dt", "id", "is_fraud", F.lit(False).alias("_extra"))
        last = Window.partitionBy("card", "_slice").orderBy("dt", "id").rowsBetween(-n, -1)
        fed = own.unionByName(extra).withColumn("card_chain_fraud_rate", share.over(last))
        parts.append(fed.filter(~F.col("_extra")).select(*out))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def rolling_entity_rate(
    links: DataFrame, lookback_s: int, rows: int = SLICE_ROWS, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Counts and fraud rate of an entity over the `lookback_s` seconds before each row.

    Rows of the same second are not seen. A sliding window does this for entities of up to
    `window_rows` rows. Its work grows with the square of an entity, so longer ones take
    running sums: a transaction enters the lookback one second after its own time and
    leaves it `lookback_s` seconds later, and what a row sees is the sum of all changes so
    far, in one window for entities whose changes are `rows` rows at most. Still longer
    ones are summed by second first, the running sum goes over slices of `rows` rows, and
    rows look their second up: a hub has a few rows for each second, however many
    transactions fall into it.
    """
    entity = ["rel_type", "key"]
    found = links.select(
        *entity,
        "transactionId",
        F.col("transactionDT").alias("t"),
        N.is_fraud("isFraud").cast("bigint").alias("fraud"),
    )
    short, long = split_big(cut_lineage(found), entity, window_rows)  # counted, told apart and looked up
    parts = []
    if short is not None:
        parts.append(_rolling(short, entity, lookback_s))
    if long is not None:
        middle, long = split_big(long, entity, rows // 3)
        if middle is not None:
            parts.append(_rolling_by_sum(middle, entity, lookback_s))
        if long is not None:
            parts.append(_rolling_by_second(long, entity, lookback_s, rows))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(
        "transactionId",
        *entity,
        F.col("n").alias("prior_tx_count"),
        F.coalesce("f", F.lit(0)).cast("bigint").alias("prior_fraud_count"),
        N.rate(F.coalesce("f", F.lit(0)), F.col("n")).alias("prior_fraud_rate"),
    )


def _rolling(found: DataFrame, entity: list[str], lookback_s: int) -> DataFrame:
    before = Window.partitionBy(*entity).orderBy("t").rangeBetween(-lookback_s, -1)
    return found.select(
        "transactionId", *entity, F.count(F.lit(1)).over(before).alias("n"), F.sum("fraud").over(before).alias("f")
    )


def _rolling_by_sum(found: DataFrame, entity: list[str], lookback_s: int) -> DataFrame:
    t, nothing = F.col("t"), F.lit(0).cast("bigint")

    def step(at, row, dn, df):
        return F.struct(at.alias("t"), row.alias("transactionId"), dn.alias("dn"), df.alias("df"))

    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("bigint")
    steps = F.array(
        step(t, F.col("transactionId"), nothing, nothing),
        step(t + 1, none, one, F.col("fraud")),
        step(t + lookback_s + 1, none, -one, -F.col("fraud")),
    )
    upto = Window.partitionBy(*entity).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    state = found.select(*entity, F.inline(steps)).select(
        "transactionId", *entity, F.sum("dn").over(upto).alias("n"), F.sum("df").over(upto).alias("f")
    )
    return state.filter(F.col("transactionId").isNotNull())


def _rolling_by_second(found: DataFrame, entity: list[str], lookback_s: int, rows: int) -> DataFrame:
    own = found.groupBy(*entity, "t").agg(F.count(F.lit(1)).alias("_rows"), F.sum("fraud").alias("_fraud"))
    t, nothing = F.col("t"), F.lit(0).cast("bigint")

    def step(at, dn, df, rows):
        return F.struct(at.alias("t"), dn.alias("dn"), df.alias("df"), rows.alias("_rows"))

    steps = F.array(
        step(t, nothing, nothing, F.col("_rows")),
        step(t + 1, F.col("_rows"), F.col("_fraud"), nothing),
        step(t + lookback_s + 1, -F.col("_rows"), -F.col("_fraud"), nothing),
    )
    changes = own.select(*entity, F.inline(steps)).groupBy(*entity, "t").agg(*[F.sum(c).alias(c) for c in ("dn", "df", "_rows")])
    sliced, column = equi_depth(changes, [*entity, "t"], rows)
    state = running_sums(sliced, entity, column, "t", {"n": "dn", "f": "df"}).filter("_rows > 0")
    # One row a second of an entity; a second with a large share of all rows is broadcast.
    state = state.select(*entity, "t", "_rows", "n", "f")
    return attach(found, state, [*entity, "t"], "_rows", "inner").select("transactionId", *entity, "n", "f")


def order_within(df: DataFrame, card: str, dt: str, key: str) -> DataFrame:
    """Rows in (card, time, key) order: a range-partitioned total sort."""
    return df.orderBy(card, dt, key)


def fraud_follow_rate(chain: DataFrame) -> DataFrame:
    """How often the transaction after a fraud on the same card is fraud too."""
    after = chain.filter(F.col("prev_is_fraud") == 1)
    n, also = F.count(F.lit(1)), F.sum(N.is_fraud("curr_is_fraud")).cast("bigint")
    return after.agg(n.alias("following_fraud_txns"), also.alias("also_fraud")).withColumn(
        "also_fraud_pct", N.pct(F.col("also_fraud"), F.col("following_fraud_txns"), 2)
    )
