"""Runs registered queries and their SQL side by side. Also a command:

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

import datetime
import decimal
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def sql_engine(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        repr(tuple(_plain(row[i]) for i in order)) for row in rows
    )


def difference(spark, engine, run, sql, folder) -> str | None:
    """What differs between the two results; None if nothing does."""
    df = run(spark, folder)
    got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    relation = engine.sql(sql)
    want = _sorted_rows(list(relation.columns), relation.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    pairs = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(pairs)} rows differ, first {pairs[0]}" if pairs else None


if __name__ == "__main__":
    import __spark_entry__ as contract
    from lagcast.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    engine, oracle = sql_engine(folder), contract.oracle_sql()
    bad = 0
    for name, run in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracle:
                outcome = difference(spark, engine, run, oracle[name], folder) or "equal"
            else:
                outcome = f"{run(spark, folder).count()} rows, no SQL"
        except Exception as problem:
            outcome = f"FAILED {type(problem).__name__}: {str(problem)[:600]}"
        bad += outcome not in ("equal",) and "no SQL" not in outcome
        print(f"{name:28s} {time.time() - start:6.1f}s  {outcome}", flush=True)
    print("problems:", bad)
