"""Helpers shared by the operators: scratch tables, id/text projection, token files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

SCRATCH = "ferret-llm"
#: Bytes of rows that Spark hands to a Python worker at once, unless the session says otherwise. By rows alone (10,000) a
#: batch of long texts takes hundreds of MB in the JVM and as much again in the worker.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """What operators with Python stages need: the package on the executors, and batches bounded by bytes."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    """A folder of this application's own, so that no other one's tables are touched when it is deleted."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{SCRATCH}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage: what follows sees one fixed set of rows, also when executors are lost
    and tasks run again. The files stay until ``drop_scratch``, because results are lazy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables below ``spark.checkpoint.dir``. Call it once the results
    that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def integer_id(docs: DataFrame, id_col: str):
    """The id column as bigint. Ids of another kind are refused here, before any job runs."""
    kind = docs.select(id_col).dtypes[0][1]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"column {id_col} is {kind}; ids have to be integers")
    return F.col(id_col).cast("bigint")


def id_text(docs: DataFrame, id_col: str, text_col: str, binary: bool = False) -> DataFrame:
    """(id bigint, text) of a document table; null text is empty. binary: UTF-8 bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(integer_id(docs, id_col).alias("id"),
                       (text.cast("binary") if binary else text).alias("text"))


def token_file(path: str) -> str:
    """A tokenizer file: a path, or the name of a file of the installed public vocabularies.
    Called where the file is read (on executors), so names need no shared folder."""
    if os.path.exists(path):
        return path
    import public_tokenizers
    return public_tokenizers.path(path)
