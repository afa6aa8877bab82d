"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan over ``storyspark.scan.partitions`` tasks, if the session sets that number.

    For tables that are one small file with one row group, which Spark reads in one task. Unset, scans are left alone.
    """
    n = df.sparkSession.conf.get("storyspark.scan.partitions", None)
    return df.repartition(int(n), key) if n else df


def export_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet folder per table, replaced as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def import_tables(spark: SparkSession, folder: str, schemas: Mapping[str, str] = TABLES) -> dict[str, DataFrame]:
    """Reads exported tables with declared schemas; ``schemas`` may name a part of them."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in schemas.items()}


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
