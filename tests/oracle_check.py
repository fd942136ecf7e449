"""Run queries against their DuckDB statements: ``python -m tests.oracle_check [sf_dir] [key ...]``."""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None:
        return ""
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return ""
        return repr(value + 0.0) if value != int(value) or abs(value) > 1e15 else str(int(value))
    text = str(value)
    return "" if text in ("NaT", "nan", "<NA>", "None") else text


def canonical(pdf):
    names = sorted(pdf.columns)
    return names, sorted(tuple(_cell(v) for v in row) for row in pdf[names].astype(object).itertuples(index=False))


def compare(spark, con, key, build, sql, sf_dir) -> tuple[bool, str]:
    started = time.time()
    names, rows = canonical(build(spark, sf_dir).toPandas())
    spark_time = time.time() - started
    want_names, want = canonical(con.execute(sql).df())
    if names != want_names:
        return False, f"columns differ: {sorted(set(names) ^ set(want_names))}"
    if rows != want:
        left, right = set(rows) - set(want), set(want) - set(rows)
        extra, missing = sorted(left)[:3], sorted(right)[:3]
        return False, (f"rows {len(rows)} vs {len(want)}; {len(left)} extra, {len(right)} missing\n"
                       f"  {names}\n  spark {extra}\n  duck  {missing}")
    return True, f"{len(rows)} rows, spark {spark_time:.1f}s"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from linklens.session import local_session

    sf_dir = argv.pop(0) if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, statements = local_session(), duck(sf_dir), oracle_sql()
    failures = 0
    for key, build in queries().items():
        if argv and key not in argv:
            continue
        try:
            if key in statements:
                ok, detail = compare(spark, con, key, build, statements[key], sf_dir)
            else:
                started = time.time()
                ok, detail = True, f"{build(spark, sf_dir).count()} rows, no statement, {time.time() - started:.1f}s"
        except Exception as exc:  # noqa: BLE001 - report and go on with the next key
            ok, detail = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failures += not ok
        print(("ok  " if ok else "FAIL"), key, detail, flush=True)
    print("failures:", failures, "without query:", sorted(set(statements) - set(queries())))
    return failures


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
