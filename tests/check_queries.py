"""Run queries by name (all by default) and compare each with its SQL twin: ``python tests/check_queries.py [names]``."""

from __future__ import annotations

import os
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.compare import connect, difference, duck_rows, spark_rows  # noqa: E402


def main(names: list[str]) -> int:
    from watchtide.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    from watchtide.catalog import ORACLES, QUERIES

    wanted = names
    if os.environ.get("FROM"):
        listed = list(QUERIES)
        wanted = listed[listed.index(os.environ["FROM"]):]
    con = connect(sf_dir)
    failed = 0
    for name in wanted or list(QUERIES):
        start = time.time()
        try:
            left = spark_rows(QUERIES[name](spark, sf_dir))
            took = time.time() - start
            note = difference(left, duck_rows(con, ORACLES[name])) if name in ORACLES else None
            kind = "rows-only" if name not in ORACLES else "ok" if note is None else "DIFF"
            print(f"{name:28s} {kind:10s} {len(left[1]):7d} rows {took:6.2f}s{' ' + note if note else ''}", flush=True)
            failed += note is not None
        except Exception as e:  # noqa: BLE001
            failed += 1
            text = str(e) if os.environ.get("FULL") is None else traceback.format_exc()
            print(f"{name:28s} ERROR {text[:700]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 100))
