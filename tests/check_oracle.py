"""Run registered queries against DuckDB: ``python tests/check_oracle.py [sf] [name…]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in rows), key=repr
    )


def compare(spark, con, name, sf_dir):
    """``None`` when equal, else a short account of the difference."""
    df = contract.queries()[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(contract.oracle_sql()[name])
    want = canonical([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if repr(g) != repr(w)]
    if wrong:
        return f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}"
    return None


if __name__ == "__main__":
    from conftest import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    spark, con = session(), oracle(f"/root/testdata/{sf}")
    chosen = sys.argv[2:] or sorted(contract.queries())
    bad = 0
    for query in chosen:
        began = time.time()
        try:
            problem = compare(spark, con, query, f"/root/testdata/{sf}")
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{query:34s} {time.time() - began:6.1f}s  {problem or 'equal'}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} equal")
