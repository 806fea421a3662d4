"""Driver queries: name -> (spark builder, oracle SQL or None).

Every builder reads whole driver tables (or what Spark derives from them) and
returns a DataFrame; nothing is collected. Names carry the inventory id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


_NARROW_INTS = {"int", "smallint", "tinyint"}


def present(df: DataFrame) -> DataFrame:
    """Result presentation shared by all driver queries: integer columns as 64-bit."""
    if not any(t in _NARROW_INTS for _, t in df.dtypes):
        return df
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in _NARROW_INTS else F.col(c)
                       for c, t in df.dtypes])


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        def built(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))
        built.__name__ = fn.__name__
        built.__doc__ = fn.__doc__
        REGISTRY[name] = (built, sql)
        return fn
    return deco




def _load_all() -> None:
    from . import q_pages, q_search, q_stream, q_tables  # noqa: F401  (modules register on import)


_load_all()
