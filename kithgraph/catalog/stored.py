"""Point questions over the stored graph and merges by bucket."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.catalog.registry import CATALOG, SPLIT, Given, query
from kithgraph.operators import edges as G
from kithgraph.operators import features as Fe
from kithgraph.plans import stored
from kithgraph.session import cut_lineage, scratch_path
from kithgraph.sources import keyed
from kithgraph.sources import tables as T


def _links(g: Given, *rels: str) -> str:
    path = scratch_path(g.spark, "links")
    stored.write_links(cut_lineage(g.rel(*rels) if rels else g.links), g.tx, path)
    return path


@query("q5_neighbourhood_stored", CATALOG["q5_neighbourhood"].sql)
def neighbourhood(g: Given):
    return stored.neighbourhood(g.spark, _links(g, "USED_CARD", "PAYER_EMAIL", "USED_DEVICE"), 4)


@query("q6_card_cluster_stored", CATALOG["q6_card_cluster"].sql)
def card_cluster(g: Given):
    return stored.card_cluster(g.spark, _links(g, "USED_CARD", "PAYER_EMAIL", "BILLED_TO"), "93")


@query("q12_explain_flag_stored", CATALOG["q12_explain_flag"].sql)
def explain_flag(g: Given):
    return stored.explain_flag(g.spark, _links(g), 4)


@query("s7_upsert_nodes_stored", CATALOG["s7_upsert_nodes"].sql)
def upsert_nodes(g: Given):
    """The earlier period's cards stored, the later period merged into its buckets."""
    rows = g.tx.filter("card1 IS NOT NULL").select(
        "card1",
        F.col("TransactionAmt").alias("last_amount"),
        F.col("ProductCD").alias("last_product"),
        F.col("TransactionID").alias("version"),
        "TransactionDT",
    )
    early, late = (part.drop("TransactionDT") for part in Fe.temporal_split(rows, SPLIT))

    def upsert(old, new):
        return T.upsert_nodes(old, new, "card1", "version")

    path = scratch_path(g.spark, "cards")
    keyed.create(upsert(early.limit(0), early), ["card1"], path)
    keyed.merge(path, ["card1"], late, upsert)
    return keyed.read(g.spark, path)


@query("s8_upsert_edges_stored", CATALOG["s8_upsert_edges"].sql)
def upsert_edges(g: Given):
    """Edges of the earlier period stored, those of the later one added to their buckets."""
    rows = cut_lineage(
        g.chain.select(
            G.node_id("Card", F.col("card")).alias("src"),
            G.node_id("Gap", F.floor(F.col("dt_gap_seconds") / 3600).cast("string")).alias("dst"),
            F.lit("SEEN_GAP").alias("rel_type"),
            F.col("prev_dt").alias("first_dt"),
        )
    )
    early, late = Fe.temporal_split(rows, SPLIT, "first_dt")

    def upsert(old, new):
        return T.upsert_edges(old, new, "first_dt")

    path, ends = scratch_path(g.spark, "gaps"), ["src", "dst", "rel_type"]
    keyed.create(upsert(early.limit(0), early), ends, path)
    keyed.merge(path, ends, late, upsert)
    return keyed.read(g.spark, path)
