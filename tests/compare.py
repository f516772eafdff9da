"""Rows of a DataFrame and of a DuckDB query, in one form."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(cell(x) for x in v)
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6) + 0.0
    return None if pd.isna(v) else (int(v) if isinstance(v, (bool, np.bool_)) else v)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)
