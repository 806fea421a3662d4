"""Resource table maintenance.

The resource table is keyed by ``resource_id = md5(url)``. Batches are merged
copy-on-write into a new table version, by one outer join on the key. The last row per key of a batch is
found by a ranking that Spark limits before its shuffle, so a key holding a large share of a
batch never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.classify import primary_language
from ..schema import RESOURCE_COLUMNS, RESOURCE_SCHEMA
from .tables import conform_resources


def newest_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The row with the largest ``order_col`` per ``key`` (last write wins)."""
    cols = [c for c in df.columns if c != key]
    packed = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_row"))
    return packed.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols])


def row_order(df: DataFrame) -> Column:
    """Order for batches without a load sequence: a hash of the whole row. Arbitrary but
    deterministic, so a task recomputed after an executor loss picks the same winner
    (an id based on partition position could change with shuffle order)."""
    return F.xxhash64(*[F.col(c) for c in df.columns])


def upsert_resources(existing: DataFrame, incoming: DataFrame, seq_col: str = "load_seq") -> DataFrame:
    """A3: merge a batch of (possibly partial) items into the resource table.

    Columns present in ``incoming`` overwrite the stored value, NULLs included;
    columns absent from it keep the stored value. Returns the full new table with
    ``is_new`` (key absent before) and ``touched`` (row written by this batch).
    Both sides are read once and meet in one outer join by key; of the batch's rows per key the winner is found
    by (key, sequence) alone, and Spark chooses the join by the sides' sizes.
    """
    inc = newest_rows(incoming, seq_col)
    present = set(inc.columns)

    def pick(c: str) -> Column:
        if c == "resource_id":
            return F.coalesce(F.col("i.resource_id"), F.col("e.resource_id"))
        if c in present:
            return F.when(F.col("i.resource_id").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"e.{c}"))
        return F.col(f"e.{c}")

    cols = [pick(c).alias(c) for c in RESOURCE_COLUMNS] + \
        [F.col("e.resource_id").isNull().alias("is_new"),
         F.col("i.resource_id").isNotNull().alias("touched")]
    j = conform_resources(existing).alias("e").join(inc.alias("i"), F.col("e.resource_id") == F.col("i.resource_id"), "full_outer")
    return j.select(*cols)


def newest_rows(incoming: DataFrame, seq_col: str) -> DataFrame:
    """The batch's last row per key, with resource_id: rows are ranked per key; Spark keeps one row per key of a task before
    it shuffles (WindowGroupLimit), so a key that holds a third of the batch is no single task's work."""
    inc = incoming.withColumn("resource_id", F.md5("url"))
    order = F.col(seq_col) if seq_col in inc.columns else row_order(incoming)
    w = Window.partitionBy("resource_id").orderBy(order.desc(), row_order(incoming))
    return inc.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", seq_col)


def replace_resources(existing: DataFrame, incoming: DataFrame, seq_col: str = "load_seq") -> DataFrame:
    """A4: whole-row overwrite by id; the newest incoming row per id replaces the stored row. One join, as in A3."""
    inc = conform_resources(newest_rows(incoming, seq_col))
    j = conform_resources(existing).alias("e").join(inc.alias("i"), F.col("e.resource_id") == F.col("i.resource_id"), "full_outer")
    return j.select(*[F.when(F.col("i.resource_id").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in RESOURCE_COLUMNS])


def dedupe_resources(resources: DataFrame, seq_col: str = "doc_id") -> DataFrame:
    """A4 on a single load: one row per resource_id, the last loaded one."""
    r = conform_resources(resources).withColumn("_seq", F.col(seq_col))
    return newest_per_key(r, "resource_id", "_seq").drop("_seq").select(*RESOURCE_COLUMNS)


def change_feed(upserted: DataFrame, query: str | None = None, at: str | None = None) -> DataFrame:
    """Rows to publish: new rows, or every row of the batch when the job has a query.

    Payload (id, url, title, description, type, domain, timestamp, language) where
    language is the first of ``languages``.
    """
    rows = upserted.where("touched") if query else upserted.where("is_new")
    ts = F.to_timestamp(F.lit(at)) if at else F.current_timestamp()
    return rows.select(
        F.col("resource_id").alias("id"), "url", "title", "description", "type", "domain",
        ts.alias("timestamp"),
        F.try_element_at(F.col("languages"), F.lit(1)).alias("language"),
        F.lit(query).cast("string").alias("query"))


def export_sample(resources: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` documents (index order)."""
    return resources.orderBy("doc_id").limit(n)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per line, NULL fields included, so every line has all fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def reindex(src: DataFrame, target_schema) -> DataFrame:
    """Copy to a new table version with ``target_schema`` (cast, fill missing)."""
    present = set(src.columns)
    return src.select(*[(F.col(f.name) if f.name in present else F.lit(None))
                        .cast(f.dataType).alias(f.name) for f in target_schema.fields])


__all__ = ["upsert_resources", "replace_resources", "dedupe_resources", "change_feed",
           "export_sample", "reindex", "primary_language"]


# ---------------------------------------------------------------------------
# A5: a log of items. Streams append their micro-batches to a Parquet folder with Spark's own sink,
# which commits every micro-batch once; the resource table is what A3 makes of the whole log.
# ---------------------------------------------------------------------------


def log_stream(items: DataFrame, log: str, checkpoint: str):
    """A writer that appends a stream of items (url, load_seq, some record fields) to ``log``."""
    return items.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)


def logged_table(spark, log: str, existing: DataFrame | None = None, seq_col: str = "load_seq") -> DataFrame:
    """The resource table after all items of ``log``: the newest item per URL, merged into ``existing`` (A3)."""
    items = spark.read.parquet(log)
    if existing is None:
        existing = spark.createDataFrame([], RESOURCE_SCHEMA)
    return upsert_resources(existing, items, seq_col)
