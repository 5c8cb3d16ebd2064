"""Run registered queries in Spark and their SQL twins in DuckDB and compare rows and types."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_KINDS = {
    "bigint": "int", "string": "str", "double": "float", "boolean": "bool", "timestamp_ntz": "ts",
    "BIGINT": "int", "VARCHAR": "str", "DOUBLE": "float", "BOOLEAN": "bool", "TIMESTAMP": "ts",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return "\0" if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, build, sql, sf_dir):
    """Empty when both engines agree; else a short description."""
    df = build(spark, sf_dir)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    left_types = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    cursor = con.execute(sql)
    right_types = {c[0]: _KINDS.get(str(c[1]), str(c[1])) for c in cursor.description}
    right = _rows(list(right_types), cursor.fetchall())
    if left_types != right_types:
        return f"types {sorted(set(left_types.items()) ^ set(right_types.items()))}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return ""


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from cuentaclara.plans.queries import ORACLES, QUERIES
    from cuentaclara.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}" if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                result = differences(spark, con, QUERIES[name], ORACLES[name], sf_dir)
            else:
                result = f"(no SQL) rows={len(QUERIES[name](spark, sf_dir).collect())}"
        except Exception as problem:  # noqa: BLE001
            result = f"ERROR {type(problem).__name__}: {str(problem)[:700]}"
        if result and not result.startswith("(no SQL)"):
            bad += 1
        print(f"{time.time() - start:6.2f}s {name}: {result or 'ok'}"[:1200], flush=True)
    print(f"{bad} of {len(wanted)} queries disagree")
