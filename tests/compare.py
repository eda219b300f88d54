"""Run registered queries next to their SQL: ``python tests/compare.py sf_dir [name ...]``."""

from __future__ import annotations

import hashlib
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normalised(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(str(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = normalised(df.columns, got), normalised(cols, want)
    took = f"{len(a)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if a == b:
        return True, took
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return False, f"{took}; sql {len(b)} rows; spark only {only_a}; sql only {only_b}"


def main() -> None:
    import __spark_entry__ as entry
    from genoloom.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session(**{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("DRIVER_MEM", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            ok, text = compare(spark, con, sf_dir, name, queries[name], oracles[name])
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print("failed:", bad, "of", len(names or queries), "missing sql:", sorted(set(queries) - set(oracles)),
          hashlib.sha1(sf_dir.encode()).hexdigest()[:4])


if __name__ == "__main__":
    main()
