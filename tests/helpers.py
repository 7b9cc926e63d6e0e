import os


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def compare_sql(spark, folder, name, query, sql):
    """Rows of a query and of its SQL, columns by name, as sorted lists of texts."""
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    text = lambda v: None if v is None else str(v)
    mine = sorted((tuple(text(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols, name
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(text(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    return mine, theirs


TABLES = ["contact_files", "contact_rows", "phones", "match_pairs", "group_members", "raw_lines", "field_aliases", "documents", "benchmark"]
CLASHING = ["key", "root", "v", "value", "n", "_pid", "part", "chunk", "bucket", "fields", "cells", "cluster", "size", "at", "item", "owner", "trust_", "values"]


def altered_tables(spark, folder, out, empty=False):
    """The tables with a row of nulls, repeated rows kept, and extra columns of names used inside; or without rows."""
    from pyspark.sql import functions as F

    for t in TABLES:
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        if empty:
            df.limit(0).write.parquet(f"{out}/{t}.parquet")
            continue
        nulls = spark.range(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes])
        extra = [F.lit("x").alias(c) for c in CLASHING if c not in df.columns]
        df.unionByName(nulls).select("*", *extra).write.parquet(f"{out}/{t}.parquet")
    return str(out)
