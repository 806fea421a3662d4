"""Edge cases the generated data does not reach."""

from pyspark.sql import functions as F

from ferret.operators import frontier as G
from ferret.operators import reports as R
from ferret.operators.common import spread
from ferret.schema import RESOURCE_SCHEMA


def test_index_status_empty_table_is_zero(spark):
    empty = spark.createDataFrame([], RESOURCE_SCHEMA)
    r = R.index_status(empty).first()
    assert (r.indexed_resources, r.index_size) == (0, 0)


def test_cap_per_domain_with_a_hot_domain(spark):
    rows = [(i, f"https://hot.example.com/{i}") for i in range(300)] + \
           [(1000 + i, f"https://cold{i}.org/x") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = G.cap_per_domain(pages, 50).groupBy("domain").count().collect()
    counts = {r["domain"]: r["count"] for r in got}
    assert counts["hot.example.com"] == 50 and all(counts[f"cold{i}.org"] == 1 for i in range(5))
    firsts = [r.page_id for r in G.cap_per_domain(pages, 3).where("domain = 'hot.example.com'").collect()]
    assert sorted(firsts) == [0, 1, 2]


def test_spread_leaves_wide_inputs_alone(spark):
    wide = spark.range(0, 1000, numPartitions=64)
    assert spread(wide) is wide
    narrow = spark.range(0, 1000, numPartitions=1)
    assert spread(narrow).rdd.getNumPartitions() > 1
