"""Compare a registered query with its SQL on the same tables, as sets of rows."""

from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(normal(row[n]) for n in names) for row in df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in places]
    return names, Counter(tuple(normal(row[i]) for i in places) for row in result.fetchall())
