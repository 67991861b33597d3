"""Run registered queries next to their SQL in DuckDB: ``python -m tests.compare sf0.01 [names]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return v + 0.0 if v == v else "nan"
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    cols, got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if cols != want_cols:
        return f"columns {cols} / {want_cols}"
    if got != want:
        extra, missing = list((got - want).items()), list((want - got).items())
        return (
            f"rows {sum(got.values())} / {sum(want.values())}; only in Spark {len(extra)}: {sorted(extra, key=str)[:3]}; "
            f"only in SQL {len(missing)}: {sorted(missing, key=str)[:3]}"
        )
    types = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    spark_types = {n: types.get(t, t) for n, t in df.dtypes}
    sql_types = {d[0]: str(d[1]) for d in result.description}
    if spark_types != sql_types:
        return f"types {spark_types} / {sql_types}"
    return None


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from revloom.session import local_session

    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    oracle = entry.oracle_sql()
    failures = 0
    for name, f in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = f(spark, sf_dir)
            if name in oracle:
                con = connect(sf_dir)  # a failed query can spoil a connection
                found = compare(df, con, oracle[name])
                outcome = found or f"ok ({len(df.columns)} columns)"
                failures += found is not None
            else:
                outcome = f"rows {df.count()}"
        except Exception as e:  # report and go on to the next query
            failures += 1
            outcome = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {outcome} [{time.time() - start:.1f}s]", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "sf0.01", sys.argv[2:]))
