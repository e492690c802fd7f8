"""Run registered queries next to their SQL twins: ``python tests/oracle_check.py [names…]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, bool) or value is None or isinstance(value, (int, float, str)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, name, fn, sql, folder):
    """(status, detail) for one query."""
    df = fn(spark, folder)
    got_cols, got = sorted_rows(df.columns, df.collect())
    if not sql:
        return "ROWS", f"{len(got)} rows"
    cur = con.execute(sql)
    want_cols, want = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return "FAIL", f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return "FAIL", f"rows {len(got)} != {len(want)}; {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return "FAIL", f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}"
    return "OK", f"{len(got)} rows {df.dtypes}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from sparkrecon import build_session

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.ui.showConsoleProgress": "false",
                                "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(folder), oracle_sql(), 0
    names = sys.argv[1:]
    for name, fn in queries().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            status, detail = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001
            status, detail = "ERROR", str(error)[:1200]
        failed += status in ("FAIL", "ERROR")
        print(f"{status:5} {time.time() - start:6.2f}s {name}: {detail}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
