"""Compare registered queries with their SQL on DuckDB: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted("|".join(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None):
    """(status, rows, spark seconds, sql seconds, detail)."""
    start = time.time()
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_seconds = time.time() - start
    if sql is None:
        return "rows-only", len(got[1]), spark_seconds, 0.0, ""
    start = time.time()
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    sql_seconds = time.time() - start
    if got == want:
        return "match", len(got[1]), spark_seconds, sql_seconds, ""
    if got[0] != want[0]:
        return "MISMATCH", len(got[1]), spark_seconds, sql_seconds, f"columns {got[0]} vs {want[0]}"
    only_spark = sorted(set(got[1]) - set(want[1]))[:2]
    only_sql = sorted(set(want[1]) - set(got[1]))[:2]
    detail = f"{len(got[1])} vs {len(want[1])} rows; spark {only_spark}; sql {only_sql}"
    return "MISMATCH", len(got[1]), spark_seconds, sql_seconds, detail[:900]


def main() -> int:
    import __spark_entry__ as entry
    from anamnesis.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in (args or list(queries)):
        try:
            status, n, s, d, detail = compare(spark, con, sf_dir, name, queries[name], oracle.get(name))
        except Exception as error:
            status, n, s, d, detail = "ERROR", 0, 0.0, 0.0, str(error)[:1200]
        bad += status in ("MISMATCH", "ERROR")
        print(f"{status:10s} {name:32s} rows={n:<7d} spark={s:6.2f}s sql={d:6.2f}s {detail}", flush=True)
    print(f"{bad} bad of {len(args or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
