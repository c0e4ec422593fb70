"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kithgraph.catalog import CATALOG, Given  # noqa: E402
from kithgraph.plans import workflows  # noqa: E402
from kithgraph.session import build_session, scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "q1_overview", "q2_compromised_cards", "q3_shared_devices", "q4_email_concentration",
    "q5_neighbourhood", "q7_risky_addresses", "q8_card_email_amplification",
    "q9_high_value_devices", "q10_graph_summary", "g8_prev_on_card", "a2_entity_stats",
    "a14_signal_summary", "w4_card_chain_rate", "w5_rolling_entity_rate",
    "j5_feature_frame_v2", "x1_wcc", "x3_fastrp", "m2_encode", "m10_threshold_sweep",
    "m17_metrics_from_saved",
]


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    Given(spark, SF_DIR).tx.count()  # start the executor threads before the clock
    seconds: dict[str, float] = {}
    start = time.perf_counter()
    g = Given(spark, SF_DIR)
    workflows.load_graph(g.tx, g.identity, scratch_path(spark, "graph")).collect()
    seconds["load_graph"] = time.perf_counter() - start
    for name in HEADLINE:
        start = time.perf_counter()
        CATALOG[name].run(Given(spark, SF_DIR)).write.format("noop").mode("overwrite").save()
        seconds[name] = time.perf_counter() - start
    rows = Given(spark, SF_DIR).tx.count()
    print(
        json.dumps(
            {
                "metric": "total wall time of the graph load and the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "transactions": rows,
                "load_rows_per_sec": round(rows / seconds["load_graph"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
