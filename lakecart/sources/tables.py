"""Access to the driver-provided test tables (one Parquet file or folder per table).

Reading is lazy: Catalyst prunes columns and pushes filters into the Parquet scan, so
callers select what they need and never pay for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_policy

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}")
    apply_policy(spark)
    return spark.read.parquet(table_path(sf_dir, name))


class Tables:
    """Attribute access to the tables of one scale-factor folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return load(self.spark, self.sf_dir, name)
        raise AttributeError(name)

