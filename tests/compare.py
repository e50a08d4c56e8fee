"""Run registered queries next to their SQL twins: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def table(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def diff(spark_df, con, sql: str) -> str:
    """'' when both give the same columns, count and values."""
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    theirs = table(cols, cur.fetchall())
    got = spark_df.collect()
    if sorted(cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(cols)}"
    ours = table(spark_df.columns, got)
    here, there = set(ours), set(theirs)
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in there][:3]
        lack = [r for r in theirs if r not in here][:3]
        return f"rows {len(ours)} against {len(theirs)}; only here {extra}; only there {lack}"
    if ours != theirs:
        only = [r for r in ours if r not in there]
        lack = [r for r in theirs if r not in here]
        return f"{len(only)} of {len(ours)} rows differ, e.g. {only[:3]} / {lack[:3]}"
    return "" if ours else "no rows"


if __name__ == "__main__":
    from sigloom.plans.catalog import QUERIES
    from sigloom.plans.oracle_sql import SQL
    from sigloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false",
                                "spark.python.sql.dataFrameDebugging.enabled": "false"})
    con = duck(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            res = diff(df, con, SQL[name]) if name in SQL else f"rows only: {df.count()}"
        except Exception as e:  # report and go on with the next query
            res = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name:20s} {time.time() - t:6.1f}s {res or 'ok'}", flush=True)
