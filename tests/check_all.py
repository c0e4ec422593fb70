"""Run every query against its SQL at one scale: python tests/check_all.py [sf] [name part ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import compare, duck  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from kithgraph.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            note = compare(df, con, sql[name]) if name in sql else f"rows {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        bad = bool(note) and not note.startswith("rows ")
        failed += bad
        print(f"{'BAD ' if bad else 'ok  '} {name:34s} {time.time() - start:6.1f}s {note or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
