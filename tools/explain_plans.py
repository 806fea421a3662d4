"""Print the formatted physical plans of the headline jobs (evidence for PLANS.md).

Usage: python tools/explain_plans.py [sf_dir]
"""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from ferret.operators import extract as X  # noqa: E402
from ferret.operators import frontier as G  # noqa: E402
from ferret.operators import stored_index as I  # noqa: E402
from ferret.session import build_session  # noqa: E402
from ferret.sources import adapters as A  # noqa: E402
from ferret.sources import sinks as K  # noqa: E402
from ferret.sources.tables import read_table  # noqa: E402
from ferret.streaming.percolate import percolate  # noqa: E402


def show(title, df):
    print(f"\n===== {title} =====")
    df.explain("formatted")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    pages = read_table(spark, sf, "pages")
    res = A.read_doc_resources(spark, sf)
    qry = A.read_queries(spark, sf)
    show("B13 extract_resources (broad)", X.extract_resources(pages, query="the"))
    out = I.search(I.write_index(res, tempfile.mkdtemp()), qry)
    show("E18 search_batch hits over the stored index", out["hits"])
    show("E9 type facet", out["type_facet"])
    labels = A.label_updates(read_table(spark, sf, "labels"))
    show("A3 upsert_resources", K.upsert_resources(K.dedupe_resources(res), labels))
    recs = res.select(F.col("doc_id").alias("record_id"),
                      F.lower(F.concat_ws(" ", "title", "description")).alias("text"))
    show("H3 percolate", percolate(recs, A.read_queries(spark, sf)))
    pend = X.links(A.widen_pages(pages), resolve=True).select(
        F.col("link").alias("url"), F.col("page_id").alias("src_seq"), "pos", F.lit(1).alias("batch"))
    show("G5 take_batch", G.take_batch(G.assign_worker(pend, ["w0", "w1", "w2"])))
    spark.stop()


if __name__ == "__main__":
    main()
