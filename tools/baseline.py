"""Time the SQL checks of the headline queries in DuckDB on one machine: the baseline of bench.py.

usage: python tools/baseline.py [DIR] [threads]    prints one line of JSON
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from bench import HEADLINE
from molq.suite import load_all

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    threads = int(sys.argv[2]) if len(sys.argv) > 2 else 8
    con = duckdb.connect()
    con.execute(f"SET threads = {threads}")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if Path(path).is_dir() else ''}'")
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        con.execute(load_all()[name].sql).to_arrow_table()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"engine": f"duckdb {duckdb.__version__}", "threads": threads, "value": round(sum(seconds.values()), 3), "queries": seconds}))


if __name__ == "__main__":
    main()
