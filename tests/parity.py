"""Run registered queries next to their SQL equivalents and compare the rows.

``python tests/parity.py <sf_dir> [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_value(r[i]) for i in order] for r in rows), key=str)


KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER",
         "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def compare(df, con, sql):
    """'' when equal, else what differs."""
    got = df.collect()
    rel = con.sql(sql)
    want, columns, types = rel.fetchall(), rel.columns, [str(x) for x in rel.types]
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    kinds = {n: KINDS.get(k, k) for n, k in df.dtypes}
    diff = {n: (kinds[n], k) for n, k in zip(columns, types) if kinds[n] != k and k not in ('"NULL"', "NULL")}
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(columns, want)
    if len(a) != len(b):
        extra = [x for x in a if x not in b][:2] if len(a) < 5000 else []
        lost = [x for x in b if x not in a][:2] if len(a) < 5000 else []
        return f"rows {len(a)} vs {len(b)}; only here {extra}; only there {lost}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"
    return f"types {diff}" if diff else ""


def main():
    from factspark.plans.catalog import ORACLES, QUERIES
    from factspark.session import build_session
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", conf={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem, n = compare(df, con, ORACLES[name]), ""
            else:
                problem, n = "", f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:1200]}", ""
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s {n} {problem[:1500]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
