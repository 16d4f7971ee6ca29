"""Side-by-side check of a registered query against its SQL oracle (DuckDB)."""

from __future__ import annotations

import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import os

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        if v.is_integer():
            return str(int(v))
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for r in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(v) for v in r))
    return cols, sorted(out)


def compare(spark, name: str, sf_dir: str, con=None, run=None, sql: str | None = None) -> dict:
    """Rows of a query against its SQL; ``run`` and ``sql`` default to the registered ones."""
    from tempora.plans.oracle import ORACLE
    from tempora.plans.queries import REGISTRY

    con = con or duck(sf_dir)
    s = (run or REGISTRY[name])(spark, sf_dir).toPandas()
    d = con.execute(sql or ORACLE[name]).df()
    sc, sr = rows_of(s)
    dc, dr = rows_of(d)
    res = {"query": name, "spark_rows": len(sr), "oracle_rows": len(dr), "columns_match": sc == dc,
           "values_match": sc == dc and sr == dr}
    if not res["values_match"]:
        res["spark_cols"], res["oracle_cols"] = sc, dc
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        res["only_spark"], res["only_oracle"] = diff_s, diff_d
    return res
