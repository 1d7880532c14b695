"""Comparison of a query's rows with those of its DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(v[k]) for k in order) for v in values), key=repr)


def by_sql(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = c.execute(sql)
    return rows([d[0] for d in r.description], r.fetchall())


def by_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
