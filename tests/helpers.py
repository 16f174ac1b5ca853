import glob
import math
import os

import numpy as np
import pandas as pd


def rows(df):
    return {tuple(r) for r in df.collect()}


def canon(df: pd.DataFrame):
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, (float, np.floating)):
            return round(float(x), 5) + 0.0
        return int(x) if isinstance(x, (int, np.integer)) else x

    return list(df.columns), sorted((tuple(map(one, r)) for r in df.itertuples(index=False, name=None)), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con
