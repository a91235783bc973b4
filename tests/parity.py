"""Run a query on Spark and its SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import os
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
DATA = os.environ.get("OPINARA_TESTDATA", "/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return f"decimal:{value}"
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(norm(v) for v in value.values())
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if value is None:
        return "<null>"
    return f"{type(value).__name__}:{value!r}"


def compare(spark, fn, sql: str, sf_dir: str) -> dict:
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted([norm(tuple(r)) for r in df.select(*cols).collect()], key=repr)
    took = time.time() - start
    con = duck(sf_dir)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return {"ok": False, "why": f"columns {cols} vs {sorted(names)}", "sec": took}
    at = [names.index(c) for c in cols]
    want = sorted([norm(tuple(r[i] for i in at)) for r in rel.fetchall()], key=repr)
    if got == want:
        return {"ok": True, "rows": len(got), "sec": took}
    missing = [w for w, g in zip(want, got) if w != g][:2]
    extra = [g for w, g in zip(want, got) if w != g][:2]
    return {"ok": False, "why": f"{cols}\n rows {len(got)} vs {len(want)}\n want {str(missing)[:900]}\n got  {str(extra)[:900]}", "sec": took}


def main() -> None:
    import argparse

    from __spark_entry__ import oracle_sql, queries
    from opinara.session import get_spark

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{args.sf}"
    all_queries, all_sql = queries(), oracle_sql()
    bad = []
    for name in args.names or all_queries:
        try:
            if name in all_sql:
                out = compare(spark, all_queries[name], all_sql[name], sf_dir)
            else:
                start = time.time()
                rows = all_queries[name](spark, sf_dir).count()
                out = {"ok": True, "rows": f"{rows} (rows only)", "sec": time.time() - start}
        except Exception as exc:  # report and go on with the next query
            out = {"ok": False, "why": f"{type(exc).__name__}: {str(exc)[:1500]}", "sec": 0}
        print(f"{'ok ' if out['ok'] else 'BAD'} {name:28} {out['sec']:6.2f}s {out.get('rows', '')} {out.get('why', '')}", flush=True)
        if not out["ok"]:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
