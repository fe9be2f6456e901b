"""A Spark result against DuckDB's, as the driver compares them: columns by name, rows in any order."""

import os

import duckdb


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.execute(sql).df()


def rows(frame):
    def text(v):
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str(v.tolist())
        if v is None or v != v:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))
