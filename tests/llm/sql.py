"""Compare a query on small tables made by a test with its SQL."""

import duckdb

import oracle
from chirpmill.llm.queries import QUERIES, SQL


def write(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    return oracle.compare(spark, con, QUERIES[name], SQL[name], folder)[0]
