"""Counted documents: texts are tokenised once for weights and scores, and a task holds little of them at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferret.operators import score
from ferret.operators import search as S
from ferret.sources.tables import conform_resources

QUERY = "query_id long, q string, type string, language string, page int, size int"
ASKED = [(1, "w1 w2 w1 w9 zz", None, None, 0, 3), (2, "w3 zz", "video", None, 1, 4), (3, "w4 w5 w6", None, "fr", 0, 50)]


def documents(n: int = 60):
    r = random.Random(5)
    text = lambda: [f"w{r.randrange(20)}" for _ in range(r.choice([0, 1, 7, 30]))]
    each = [[{"field": f, "dl": len(t), "tokens": t} for f in range(3) if (t := text())] for _ in range(n)]
    return pa.array(each, pa.list_(pa.struct([("field", pa.int32()), ("dl", pa.int32()), ("tokens", pa.list_(pa.string()))])))


def weights(seed: int = 2):
    r = np.random.default_rng(seed)
    terms = sorted(f"w{i}" for i in range(12))
    uses = sorted((t, q, 1 + (t + q) % 2) for t in range(12) for q in range(4) if (t + q) % 3)
    many = np.bincount([u[0] for u in uses], minlength=12)
    return {"terms": terms, "ids": [7, 8, 9, 10], "idf": r.random((3, 12)), "avgdl": np.array([5.0, 9.0, 7.0]), "many": many, "start": np.cumsum(many) - many,
            "query": np.array([u[1] for u in uses]), "qtf": np.array([float(u[2]) for u in uses]), "boosts": np.array([3.0, 2.0, 1.0])}


def test_counts_of_documents():
    parts, terms = documents(), [f"w{i}" for i in range(12)]
    for d, got in zip(parts.to_pylist(), score.counts_of(terms, parts).to_pylist(), strict=True):
        want = [(p["field"], p["dl"], c, n) for p in d for c, n in [(-1, 1), *((terms.index(t), p["tokens"].count(t)) for t in terms if t in p["tokens"])]]
        assert [(g["field"], g["dl"], g["code"], g["tf"]) for g in got] == want


@pytest.mark.parametrize("counted", [False, True])
def test_hits_do_not_depend_on_the_slices(monkeypatch, counted):
    parts, w = documents(), weights()
    want = score.hits_of(w, 1.2, 0.75, pa.int64(), parts).to_pylist()
    assert sum(map(len, want)) > 50
    sizes = []
    sums = score.sums_of
    monkeypatch.setattr(score, "sums_of", lambda w, doc, *x: sizes.append(w["many"][x[1]].sum()) or sums(w, doc, *x))
    monkeypatch.setattr(score, "TOKENS", 9)
    monkeypatch.setattr(score, "POSTINGS", 40)
    monkeypatch.setattr(score, "USES", 30)
    monkeypatch.setattr(score, "CELLS", 12 * 7)
    assert score.hits_of(w, 1.2, 0.75, pa.int64(), score.counts_of(w["terms"], parts) if counted else parts).to_pylist() == want
    assert len(sizes) > 15 and max(sizes) <= 90  # a document alone, at most


def test_texts_are_tokenised_once_for_a_page(spark, monkeypatch):
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(0, 12)))
    rows = [(i if i else None, f"u{r.randrange(40)}", text(), None if i % 5 == 0 else text(), text(), r.choice(["video", "article"]), r.choice(["en", "fr"])) for i in range(90)]
    res = conform_resources(spark.createDataFrame(rows, "doc_id long, url string, title string, description string, content string, type string, lang string")
                            .withColumn("languages", F.array("lang")))
    q = spark.createDataFrame(ASKED, QUERY)
    t = S.build_search_tables(res)
    batch = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert t.unique
    made = []
    own = S.document_fields
    monkeypatch.setattr(S, "document_fields", lambda *a: made.append(a) or own(*a))
    monkeypatch.setattr(S, "held_weights", None)  # no pass of its own for the weights
    out = S.search_batch(t, res, q)
    plans = [out[k]._jdf.queryExecution().executedPlan().toString() for k in ("page", "totals", "type_facet", "language_facet")]
    assert len(made) == 1 and not any("regexp_extract_all(lower(content" in p for p in plans)
    monkeypatch.undo()
    fields = list(S.rules.SEARCH_FIELDS)
    rows = lambda df: sorted((x.query_id, x.field, x.term, x.qtf, x.idf, x.avgdl) for x in df.collect())
    codes = ["w1", "w2", "w3", "w4", "w5", "w6", "w9", "zz"]
    found = S.document_fields(t, fields, 3).withColumn("parts", score.counts_column(spark, codes, F.col("parts")))
    got, want = (rows(w) for w in (S.counted_weights(found, S.query_terms(q), codes, fields), S.held_weights(t, S.query_terms(q), fields)))
    assert [g[:4] for g in got] == [w[:4] for w in want] and [g[4:] for g in got] == [pytest.approx(w[4:], rel=1e-12) for w in want]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == batch
