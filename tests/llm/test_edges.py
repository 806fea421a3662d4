"""Nulls, empty tables, extra and uncomparable columns, ids of another kind, repeated rows and long texts; the pipeline against its stages in plain Python."""

import math
import random
import time
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ferret.llm import decontaminate, exact_dedup, line_dedup, line_quality, minhash, packing, ranked_search, secret_scan, sharding, token_counts, toxicity, url_filter

LONG = " ".join(f"tok{i % 977}" for i in range(60_000))
ROWS = [(1, "same text here, with words enough for shingles and more"), (2, "same text here, with words enough for shingles and more"), (2, "same text here, with words enough for shingles and more"),
        (None, None), (None, "only nulls have me"), (3, ""), (4, LONG), (5, LONG + " tail")]


@pytest.fixture(scope="module")
def odd(spark):
    """Column names that operators use inside, and a map, which has no order."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({"row": F.create_map(F.lit("k"), F.lit(1)), "id": F.lit("x"), "rid": F.lit(2.5), "sha": F.lit(None).cast("string"), "v": F.lit(1), "h": F.lit(7),
                           "label": F.lit(3), "th": F.lit(0), "score": F.lit(1), "item_id": F.lit(9), "list": F.lit("z"), "seq": F.lit(1), "words": F.lit(1), "lines": F.lit("u")})


def test_drops_keep_uncomparable_columns(odd):
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter((r.doc_id, r.text, r.row["k"]) for r in kept.collect()) == Counter(
        (i, t, 1) for i, t in [(1, ROWS[0][1]), (None, "only nulls have me"), (3, ""), (4, LONG), (5, LONG + " tail")])
    near = minhash.drop_near_duplicates(odd)
    assert near.columns == odd.columns
    assert Counter(r.doc_id for r in near.collect()) == Counter([1, None, None, 3, 4])
    clean = decontaminate.drop_contaminated(odd, odd.sparkSession.createDataFrame([(1, "only nulls have me")], "item_id long, text string"))
    assert clean.columns == odd.columns and Counter(r.doc_id for r in clean.collect()) == Counter([1, 2, 2, None, 3, 4, 5])


def test_drop_toxic_keeps_columns_and_handles_empty_tables(odd, spark):
    labels = spark.createDataFrame([(1, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    assert toxicity.drop_toxic(odd, labels).count() == len(ROWS)
    assert toxicity.score_documents(odd.limit(0), labels).count() == 0
    rows = toxicity.score_documents(odd, labels.limit(0)).collect()
    assert len(rows) == len(ROWS) and len({r.score for r in rows}) == 1
    again = toxicity.score_documents(odd, labels).where("doc_id = 2").collect()
    assert len(again) == 2 and again[0] == again[1]


def test_columns_of_other_names_do_not_disturb(odd, spark):
    plain = odd.select("doc_id", "text")
    for f in (line_quality.clean_lines, secret_scan.scan_secrets, token_counts.token_counts, line_dedup.mark_repeated_lines, exact_dedup.mark_duplicates,
              lambda d: sharding.assign_shards(d, [1.0] * 4), lambda d: minhash.mark_near_duplicates(d), lambda d: packing.pieces_digest(packing.pack_documents(d, size=64)).drop("sequence_id", "offset")):
        assert Counter(map(str, f(odd).collect())) == Counter(map(str, f(plain).collect()))
    asked = spark.createDataFrame([(1, "tok5 tail")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert [r.doc_id for r in ranked_search.ranked_search(odd, asked).orderBy("rank").collect()][0] == 5


def test_empty_tables(odd, spark):
    none = odd.limit(0)
    entries = spark.createDataFrame([("l", "b.com", "add", 1)], "list string, target string, action string, at long")
    pages = spark.createDataFrame([], "page_id long, url string, fetched long")
    assert url_filter.filter_captures(pages, entries).count() == 0
    assert secret_scan.scan_secrets(none).count() == 0
    items = spark.createDataFrame([(1, "some words of an item which is long enough")], "item_id long, text string")
    assert decontaminate.find_contaminated(none, items).count() == 0
    assert decontaminate.find_contaminated(odd, items.limit(0)).count() == 0
    assert minhash.drop_near_duplicates(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


@pytest.mark.parametrize("f", [exact_dedup.mark_duplicates, minhash.mark_near_duplicates, packing.pack_documents, token_counts.token_counts, line_dedup.mark_repeated_lines])
def test_ids_of_another_kind_are_refused_before_any_job(spark, f):
    with pytest.raises(TypeError, match="ids have to be integers"):
        f(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_null_and_repeated_ids_cost_no_more_than_others(spark):
    rnd = random.Random(1)
    base = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(80)) for _ in range(150)]
    texts = base + [t + " more" for t in base]

    def took(ids):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        start = time.time()
        rows = minhash.mark_near_duplicates(df).collect()
        return rows, time.time() - start
    apart, seconds = took(range(300))
    assert Counter(Counter(r.component_id for r in apart).values()) == {2: 150}
    for ids in ([None] * 300, [7] * 300):
        rows, more = took(ids)
        assert len(rows) == 300 and more < 4 * seconds + 5


def test_verbatim_window_counts_beside_a_changed_name(spark):
    item = "When the ship left Boston on 3 May it carried 40 barrels of salted fish to the harbour of Lisbon for trade"
    docs = [(i, f"Intro words. {item.replace(a, b)} and the rest.") for i, (a, b) in enumerate([("Boston", "Dover"), ("40", "41"), ("Lisbon", "Porto"), ("ship", "boat")])]
    docs += [(10, "A ship carried barrels of fish, and Boston was far away from Lisbon in 40 days.")]
    got = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3}


def brute_windows(docs, items, size=8):
    """Documents that share ``size`` successive words (case and punctuation aside) with an item."""
    def words(t):
        return [w for w in (x.strip("\"'`()[]{}<>.,;:!?…").lower() for x in (t or "").split()) if w]

    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - size + 1):
            grams.setdefault(tuple(w[k:k + size]), set()).add(i)
    return {(d, i) for d, t in docs for k in range(len(words(t)) - size + 1) for i in grams.get(tuple(words(t)[k:k + size]), ())}


def test_decontamination_finds_every_shared_window(spark):
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(30)) * (rnd.random() < 0.1) for _ in range(25))) for i in range(20)]
    docs = []
    for d in range(120):
        w = [f"x{rnd.randrange(50)}" for _ in range(40)]
        if d % 3 == 0:
            i, t = rnd.choice(items)
            at, n = rnd.randrange(17), rnd.choice([6, 7, 8, 12])
            w[10:10] = t.split()[at:at + n]
        docs.append((d, " ".join(w)))
    got = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert brute_windows(docs, items) <= {(r.doc_id, r.item_id) for r in got}
    assert all(len([1 for d, i in brute_windows(docs, items) if d == r.doc_id]) or r.kind == "re-parameterised" for r in got)


def entropy(w):
    return -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())


def test_entropy_of_random_strings_of_every_length(spark):
    rnd = random.Random(3)
    kinds = {"hex": "0123456789abcdefABCDEF", "mixed": secret_scan.ALPHABET, "few": "aB3", "letters": "abcdefghijklmnopqrstuvwxyz"}
    texts = ["".join(rnd.choice(kinds[k]) for _ in range(n)) for k in kinds for n in [*range(20, 60), 150, 400] for _ in range(2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", secret_scan.dense_stretch(F.col("t")).alias("d"))
    for r in df.collect():
        t = texts[r.i]
        limit = secret_scan.LIMITS["hex" if set(t) <= set(kinds["hex"]) else "mixed"]
        hits = [s for s in range(len(t) - 19) if entropy(t[s:s + 20]) >= limit - 1e-9]
        assert (None if r.d is None else (r.d.first, r.d.last)) == ((hits[0], hits[-1] + 20) if hits else None), t


def test_pipeline_stages_take_effect(spark, tmp_path):
    """Toxic, copied, nearly copied and contaminated documents go, all others are packed; columns of documents stay between stages."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeinorst") for _ in range(6))
    clean = [(i, " ".join(word() for _ in range(60))) for i in range(300)]
    toxic = [(1000 + i, " ".join(word() for _ in range(50)) + " vilestuff horridword") for i in range(100)]
    item = "the quick survey of nine remarkable gardens ended before the long rain arrived in town"
    more = [(2000, clean[5][1]), (2001, clean[6][1] + " x"), (2002, clean[7][1] + ". " + item + ". " + word()), (2003, None), (2004, ""), (2004, ""), (None, "null id " + clean[9][1][:90])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), {"a": 1}) for i, t in clean + toxic + more], "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i, _ in clean] + [(i, 0, 1) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed = Counter(r.doc_id for r in rows if r.start == 0)
    assert packed == Counter([i for i, _ in clean] + [2003, None])
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    for seq in {r.sequence_id for r in rows}:
        assert sum(r.length for r in rows if r.sequence_id == seq) <= packing.SEQUENCE


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
