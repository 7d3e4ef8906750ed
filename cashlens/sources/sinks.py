"""Writers: partitioned facts, company-month tables, served tables, prediction files, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cashlens.functions.exprs import month_str
from cashlens.sources.schemas import FACT_DATES


def write_fact(df: DataFrame, name: str, path: str) -> None:
    """ZSTD Parquet, one folder per month of the fact's date. Rows are brought together by month and
    a salt, so a busy month is written by several tasks."""
    d = df.withColumn("year_month", month_str(FACT_DATES[name]))
    salt = F.pmod(F.xxhash64(FACT_DATES[name], "company_id"), F.lit(16))
    (d.repartition(F.col("year_month"), salt).write.mode("overwrite").partitionBy("year_month")
     .option("compression", "zstd").parquet(path))


def write_monthly(df: DataFrame, path: str) -> None:
    """Company-month table, one folder per month. Written again, only the months that ``df`` holds are replaced."""
    (df.repartition(F.col("T"), F.pmod(F.xxhash64("company_id"), F.lit(16))).write.mode("overwrite").partitionBy("T")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path))


def write_served(df: DataFrame, path: str) -> None:
    """Served table: spread by company and sorted inside files, so a keyed read touches few row groups."""
    key = [c for c in ("company_id", "T") if c in df.columns]
    (df.repartition(key[0]).sortWithinPartitions(*key) if key else df).write.mode("overwrite").option(
        "compression", "zstd").parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """The same as a catalog table under ``path``, bucketed and sorted by company: two of them join without a shuffle.
    Rows are dealt to the buckets first, so that each bucket is one file."""
    (df.repartition(buckets, "company_id").write.mode("overwrite").option("path", path).option("compression", "zstd")
     .bucketBy(buckets, "company_id").sortBy("company_id").saveAsTable(table))


def four_decimals(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 4) if t in ("double", "float") else F.col(c)).alias(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    four_decimals(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, *partition: str) -> None:
    """One JSON document per row."""
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    (w.partitionBy(*partition) if partition else w).json(path)


def subset(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables limited to some companies; groups are reached through the companies."""
    groups = tables["companies"].join(ids, "company_id", "left_semi").select("group_id")
    return {n: (df.join(groups, "group_id", "left_semi") if n == "groups" else df.join(ids, "company_id", "left_semi"))
            for n, df in tables.items()}


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash of a table: row count, sum and xor of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h).cast("string").alias("hash_xor"))


def document(**cols: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))
