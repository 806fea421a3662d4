"""Explicit schemas (no inference anywhere)."""

from pyspark.sql import types as T

RESOURCE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("resource_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("code_snippets", T.ArrayType(T.StringType())),
    T.StructField("tags", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("language", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("indexed_date", T.TimestampType()),
    T.StructField("quality_score", T.DoubleType()),
])

RESOURCE_COLUMNS = [f.name for f in RESOURCE_SCHEMA.fields]

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

QUERY_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("q", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
])
