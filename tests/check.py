"""Compare registered queries with their SQL: ``python tests/check.py SF [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cores: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(table):
    """Arrow table → sorted list of row tuples in column-name order, with type names."""
    import datetime as dt
    cols = sorted(table.column_names)
    types = []
    for c in cols:
        t = str(table.schema.field(c).type)
        types.append("timestamp" if t.startswith("timestamp") else t)

    def fix(v):
        if isinstance(v, float):
            return "nan" if v != v else (0.0 if v == 0 else v)
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=None)
        if isinstance(v, list):
            return tuple(fix(x) for x in v)
        return v
    data = [[fix(v) for v in table.column(c).to_pylist()] for c in cols]
    rows = list(zip(*data)) if cols else []
    return cols, types, sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark_df, con, sql) -> str:
    a = canon(spark_df.toArrow())
    b = canon(con.sql(sql).to_arrow_table())
    if a[0] != b[0]:
        return f"columns {a[0]} vs {b[0]}"
    if a[1] != b[1]:
        return "types " + str([(c, x, y) for c, x, y in zip(a[0], a[1], b[1]) if x != y])
    if len(a[2]) != len(b[2]):
        return f"rows {len(a[2])} vs {len(b[2])}"
    if a[2] != b[2]:
        bad = [(x, y) for x, y in zip(a[2], b[2]) if x != y]
        x, y = bad[0]
        return f"{len(bad)} rows differ, e.g. " + str([(c, p, q) for c, p, q in zip(a[0], x, y) if p != q]) + f" in {x[:6]}"
    return f"ok {len(a[2])} rows"


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    spark, sf_dir = session(), f"/root/testdata/{sf}"
    con, sqls, fails = duck(sf_dir), entry.oracle_sql(), 0
    qs = entry.queries()
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                res = compare(df, con, sqls[name])
            else:
                res = f"ok {df.toArrow().num_rows} rows (no SQL)"
        except Exception as e:                      # report and go on with the next query
            res = f"ERROR {type(e).__name__}: {str(e)[:300]}"
        fails += not res.startswith("ok")
        print(f"{name:24s} {time.time() - t0:6.1f}s  {res}", flush=True)
    print("failures:", fails)
    return fails


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
