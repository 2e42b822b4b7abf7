"""IO1 table_scan and IO12 safe_scan over the Parquet test tables (or any catalog)."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """IO1: read one named table. Column pruning / filter pushdown happen in the scan.

    A Parquet file of one row group is read by one task. Where the caller knows a table to be written like that,
    the session setting ``millrun.scanPartitions`` ("lineitem=8,events=8") deals its rows to as many
    tasks; there is no such shuffle by default, and none that depends on a table's size.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    chosen = dict(x.split("=") for x in spark.conf.get("millrun.scanPartitions", "").split(",") if x)
    return df.repartition(int(chosen[name])) if name in chosen else df


def safe_table(spark: SparkSession, name: str, schema: StructType, sf_dir: str | None = None) -> DataFrame:
    """IO12: a missing table yields a typed empty frame instead of an error."""
    if sf_dir is not None:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            return spark.read.parquet(path)
    elif spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` reads the Parquet file once per plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            df = read_table(self.spark, self.sf_dir, name)
            self.__dict__[name] = df
            return df
        raise AttributeError(name)

    @cached_property
    def names(self) -> tuple[str, ...]:
        return TABLE_NAMES
