"""Compare registered queries with their SQL: python tests/check.py SF [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return value


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[normal(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def differences(spark, con, run, sql: str, folder: str) -> str | None:
    """None if the query and the SQL agree, else what differs."""
    ours, theirs = run(spark, folder).toArrow(), con.execute(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} / {sorted(theirs.column_names)}"
    types = {
        n: (str(ours.schema.field(n).type), str(theirs.schema.field(n).type))
        for n in ours.column_names
    }
    plain = lambda t: t.replace("large_", "").replace("element", "l").replace("child", "l").replace(" not null", "")
    uneven = {n: t for n, t in types.items() if plain(t[0]) != plain(t[1])}
    a, b = rows(ours), rows(theirs)
    if a != b:
        extra = [r for r in a if r not in set(b)][:3] if len(a) < 20000 else a[:2]
        lacking = [r for r in b if r not in set(a)][:3] if len(a) < 20000 else b[:2]
        return f"{len(a)} / {len(b)} rows; ours only {str(extra)[:600]}; theirs only {str(lacking)[:600]}"
    return f"types {uneven}" if uneven else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = differences(spark, con, run, oracles[name], folder)
                count = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchall()[0][0]
            else:
                count, problem = run(spark, folder).count(), None
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={count} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
