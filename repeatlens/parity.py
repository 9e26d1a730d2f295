"""Compare a Spark result with a DuckDB oracle result (tests and checks)."""

from __future__ import annotations

import math

import pandas as pd


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(v) for v in rec) for rec in pdf[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return False, f"row count {len(spark_pdf)} vs {len(oracle_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(oracle_pdf)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return False, f"row {i} differs: {x} vs {y}"
    return True, "ok"


def _canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]
    if len(pdf) == 0:
        return pdf
    key = pdf.astype(str).apply(lambda r: "|".join(r), axis=1)
    return pdf.iloc[key.argsort(kind="stable")].reset_index(drop=True)


def same_representation(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    """Stricter than ``compare``: identical pandas dtypes and identical
    ``hash_pandas_object`` values after an order-insensitive sort -- what a
    raw value-hash over both results would see."""
    a, b = _canonical(spark_pdf), _canonical(oracle_pdf)
    da = {c: str(t) for c, t in a.dtypes.items()}
    db = {c: str(t) for c, t in b.dtypes.items()}
    if da != db:
        return False, f"dtypes differ: {[(c, da[c], db.get(c)) for c in da if da[c] != db.get(c)]}"
    ha = pd.util.hash_pandas_object(a, index=False).values
    hb = pd.util.hash_pandas_object(b, index=False).values
    if len(ha) != len(hb) or not (ha == hb).all():
        return False, "value hashes differ"
    return True, "ok"
