"""Run a registered query and its SQL, and compare rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    out = []
    for row in df[cols].astype(object).itertuples(index=False):
        r = []
        for x in row:
            if x is None or pd.isna(x):
                r.append(None)
            elif isinstance(x, str):
                r.append(x)
            elif isinstance(x, bool) or type(x).__name__ == "bool":
                r.append(bool(x))
            else:
                r.append(float(x) if float(x) != int(x) else int(x))
        out.append(repr(r))
    return sorted(out)


def same(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
