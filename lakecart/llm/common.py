"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import load


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: later
    jobs reuse the rows, and a lost executor costs no recomputation of the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and nothing will read again."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("lakecart-"):  # only our own scratch folders
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = load(spark, sf_dir, "documents")
    return df.select(*columns) if columns else df


def crc_mod(column: str, modulus: int) -> Column:
    """Remainder of the crc32 of an id's decimal text (the contracts' fold rule)."""
    return F.crc32(F.col(column).cast("string")) % modulus


def hash_fraction(*columns: str) -> Column:
    """A fixed pseudo-random number in [0, 1) from the columns' values."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)
