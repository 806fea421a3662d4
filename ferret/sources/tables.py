"""A1/A2: typed readers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAGE_SCHEMA, RESOURCE_SCHEMA


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A1: pages to analyse, (page_id, url, html); a stream when ``stream``."""
    if stream:
        return spark.readStream.schema(PAGE_SCHEMA).parquet(path)
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def conform_resources(df: DataFrame, keep=()) -> DataFrame:
    """A2: fill missing resource columns with typed NULLs and fix column types/order.
    Columns named in ``keep`` are carried along after the resource columns."""
    present = set(df.columns)
    cols = []
    for f in RESOURCE_SCHEMA.fields:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols, *keep)


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """A2: typed read of a stored resource table; older files with fewer columns still load."""
    return conform_resources(spark.read.option("mergeSchema", "true").parquet(path))
