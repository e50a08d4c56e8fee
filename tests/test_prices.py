"""Prices at which a rounded last bit decides a comparison."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pandas as pd

from compare import diff
from sigloom.plans.catalog import QUERIES
from sigloom.plans.oracle_sql import SQL
from sigloom.sources import fixtures as fx



def walk_table(path: str, levels: list[int]) -> None:
    """A symbol for each level: reached on its first day, kept on the second and third."""
    rows, order = [], 0
    for sym, level in enumerate(levels, 1):
        left = level
        steps = []
        while left:
            steps.append(max(-5, min(5, left)))
            left -= steps[-1]
        for day, step in [*[(0, s) for s in steps or [0]], (1, 0), (2, 0)]:
            order += 1
            rows.append((order, 1, sym, 1, 5.0, 0.05 + step / 100.0, 0.02, pd.Timestamp("1995-01-02") + dt.timedelta(days=day)))
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    frame = pd.DataFrame(rows, columns=names).astype({"l_linenumber": "int32"})
    frame["l_shipdate"] = frame["l_shipdate"].astype("datetime64[us]")
    frame.to_parquet(path)


def test_prices_are_those_of_the_c_library(spark, tmp_path):
    walk_table(f"{tmp_path}/lineitem.parquet", list(range(-150, 151)))
    closes = {r["sym"]: r["close"] for r in fx.daily_bars(spark, str(tmp_path)).collect()}
    assert all(closes[s] == 100.0 * math.exp(0.4 * k / 100.0) for s, k in enumerate(range(-150, 151), 1))


def test_equal_closes_at_the_start_equal_their_sql(spark, tmp_path):
    walk_table(f"{tmp_path}/lineitem.parquet", list(range(-500, 501, 1)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert diff(QUERIES["ind_ichimoku"](spark, str(tmp_path)), con, SQL["ind_ichimoku"]) == ""


def test_levels_beyond_the_table_have_a_price(spark, tmp_path):
    walk_table(f"{tmp_path}/lineitem.parquet", [fx.TABLED + 5])
    closes = {r["close"] for r in fx.daily_bars(spark, str(tmp_path)).collect()}
    assert len(closes) == 1 and abs(closes.pop() / (100.0 * math.exp(0.4 * (fx.TABLED + 5) / 100.0)) - 1) < 1e-14
