"""Compare registered queries with their SQL: ``python tests/oracle_check.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


TIMES: dict[str, float] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    try:
        return float(value) if not isinstance(value, (int, str)) else value
    except (TypeError, ValueError):
        return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short description of the first difference."""
    start = time.time()
    df = query(spark, sf_dir)
    fetched = df.collect()
    TIMES[name] = time.time() - start
    got_cols, got = normal_rows(df.columns, [tuple(r) for r in fetched])
    if sql is None:
        return None if got_cols else "no columns"
    result = con.execute(sql)
    want_cols, want = normal_rows([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        if not extra and not missing:
            return "same rows with other multiplicities"
        return f"{len(extra)} of {len(got)} rows differ, e.g. {min(extra, key=repr)} / {min(missing, key=repr)}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    from epigrain.session import get_session

    sf_dir, names = argv[0], argv[1:]
    spark = get_session(
        "oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                       "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    oracles = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {name:28} {time.time() - start:6.1f}s spark {TIMES.get(name, 0):6.1f}s {problem or ''}",
              flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
