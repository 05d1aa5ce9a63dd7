"""Runs queries beside their SQL twins. As a script: python tests/oracle.py [sf] [name part...]"""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    show = lambda x: "NULL" if x is None or (not isinstance(x, (list, tuple, dict)) and pd.isna(x)) else f"{x:.9g}" if isinstance(x, float) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)
    return sorted(tuple(show(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


def differences(spark, con, name: str, build, sql: str, sf_dir: str) -> str | None:
    got, want = build(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; {odd} types {[(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype]}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind}
    return f"kinds {kinds}" if kinds and len(a) else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir, parts = f"/root/testdata/{sys.argv[1]}", sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    bad = 0
    for name, build in entry.queries().items():
        if parts and not any(p in name for p in parts) or not parts and (name.startswith("op") or name == "pipeline"):
            continue
        try:
            sql = entry.oracle_sql().get(name)
            said = differences(spark, con, name, build, sql, sf_dir) if sql else f"(rows {build(spark, sf_dir).count()})"
        except Exception as e:
            said = f"{type(e).__name__}: {(str(e).split('\n\n\tat')[0][-700:] if 'PythonException' in str(e) else str(e)[:400])}"
        if said and not said.startswith("(rows"):
            bad += 1
        if said:
            print(name, said, flush=True)
    print("bad", bad)
