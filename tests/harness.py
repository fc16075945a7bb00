"""Run queries on Spark and DuckDB side by side: python -m tests.harness [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from locusloom.plans.fixtures import TABLES

ROOT = "/root/testdata"


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("locusloom-tests")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v + 0.0 if v != 0 else 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def compare(df, con, sql: str) -> tuple[str, int]:
    """('' when column names, row count and values agree, else what differs; row count)."""
    cols = sorted(df.columns)
    mine = sorted(tuple(_norm(r[c]) for c in cols) for r in (x.asDict(recursive=True) for x in df.collect()))
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(mine)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    idx = [names.index(c) for c in cols]
    other = sorted(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    if len(mine) != len(other):
        return f"rows {len(mine)} vs {len(other)}", len(mine)
    spark_kinds = dict(df.dtypes)
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c in cols:
        want = simple.get(spark_kinds[c])
        if want and want != kinds[c] and not (want == "VARCHAR" and kinds[c] == "STRING"):
            return f"type of {c}: {spark_kinds[c]} vs {kinds[c]}", len(mine)
    bad = [(a, b) for a, b in zip(mine, other) if a != b]
    return (f"{len(bad)} rows differ, first {bad[0]}" if bad else ""), len(mine)


def main(argv: list[str]) -> int:
    import __spark_entry__ as contract

    sf = argv[0] if argv and argv[0].startswith("0.") else "0.01"
    names = [a for a in argv if not a.startswith("0.")]
    sf_dir = f"{ROOT}/sf{sf}"
    spark, con = session(), duck(sf_dir)
    jobs, oracles = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in names or jobs:
        t0 = time.time()
        try:
            df = jobs[name](spark, sf_dir)
            if name in oracles:
                why, n = compare(df, con, oracles[name])
            else:
                n = df.count()
                why = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            why, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        failed += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name:28s} {time.time() - t0:6.1f}s "
              f"{'sql' if name in oracles else 'rows'} n={n} {why}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
