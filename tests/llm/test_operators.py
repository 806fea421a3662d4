"""The operators against plain Python on small tables with nulls, empty, long, equal and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ferret.llm import decontaminate, exact_dedup, line_dedup, minhash, packing, secret_scan, sharding, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, id long, sha string, v long, label string"
BASE = " ".join(f"word{i} Über-{i}" for i in range(120))
TEXTS = [
    (1, BASE), (2, BASE.replace("word7 ", "other ")), (3, "A  b\tc"), (4, "A b c"), (5, None), (6, ""), (7, "  \n "),
    (8, "naïve <|endoftext|>x 北京 it's 12.5km\x1f²"), (9, "q " * 9000), (None, "null id text"), (3, "A  b\tc"), (10, "tail " + BASE.upper()),
    (11, "one\ntwo\nthree\nfour"), (12, "zero\none\n\ntwo \nthree\nlast"), (13, "one\ntwo\nthree\nfour"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0, "x", 1, "y") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_packing_round_trip(docs, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, size=64).collect()
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in TEXTS)
    by_seq = defaultdict(dict)
    for r in rows:
        by_seq[r.sequence_id][r.offset] = r
    assert sorted(by_seq) == list(range(len(by_seq)))
    stream = []
    for s in range(len(by_seq)):
        at = 0
        for o in sorted(by_seq[s]):
            assert o == at
            at += by_seq[s][o].length
            stream.append(by_seq[s][o])
        assert at == 64 or s == len(by_seq) - 1
    got, ids = Counter(), []
    for r in stream:
        assert r.start == len(ids)
        ids += np.frombuffer(r.ids, "<u4").tolist()
        assert len(r.ids) == 4 * r.length
        if len(ids) == r.doc_tokens:
            got[(r.doc_id, tuple(ids))] += 1
            ids = []
    assert got == want and not ids
    assert packing.pack_documents(empty).count() == 0


def test_token_counts(docs, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in TEXTS), key=key)
    assert sorted(map(tuple, token_counts.token_counts(docs).collect()), key=key) == want
    assert token_counts.token_counts(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.assign_shards(docs, [1.0, 2.0, 1.0, 4.0]).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=key) == sorted(
        ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS), key=key)
    slots, shard = defaultdict(list), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        assert shard.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty, [1.0, 1.0]).count() == 0


def test_shares_follow_weights(spark):
    rows = sharding.assign_shards(spark.range(4000).selectExpr("id AS doc_id", "'' AS text"), [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r["shard"]: r["count"] for r in rows}[1] / 4000 - 0.75) < 0.03


def test_exact_dedup(docs, empty):
    def sha(t):
        return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[sha(t)].append(i)
    for support in (0.5, 0.05):  # no heavy digest, and some
        rows = exact_dedup.mark_duplicates(docs, support=support).collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            g = groups[r.text_sha256]
            assert r.group_size == len(g) and r.keep_id == min((x for x in g if x is not None), default=None)
            assert not r.kept or r.doc_id == r.keep_id
        assert all(sum(r.kept for r in rows if r.text_sha256 == s) == 1 for s in groups)
        kept = exact_dedup.drop_duplicates(docs, support=support)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark_duplicates(empty).count() == 0


def brute_components(texts, percent):
    sets = {}
    for n, (_, t) in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[n] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {n: n for n in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for n, (i, _) in enumerate(texts):
        ids[find(n)].append(i)
    return sorted(((i, len(sets[n]), min((x for x in ids[find(n)] if x is not None), default=None)) for n, (i, _) in enumerate(texts)), key=key)


def test_minhash(docs, empty):
    rows = minhash.mark_near_duplicates(docs, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=key) == brute_components(TEXTS, 85)
    assert minhash.mark_near_duplicates(empty).count() == 0


def test_minhash_chains_and_blocks(spark, monkeypatch):
    """A group whose members differ by growing edits: links only between some, found in cells of several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for n in range(60):
        w = list(base)
        for k in rng.choice(200, n % 12, replace=False):
            w[k] = f"x{n}_{k}"
        texts.append((n, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = minhash.mark_near_duplicates(df, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=key) == brute_components(texts, 80)
    kept = minhash.drop_near_duplicates(df, percent=80)
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute_components(texts, 80)}


def test_minhash_first_common_band_by_whole_keys():
    """Coordinates of an earlier band that agree in their kept 16 bits only do not hide a pair."""
    one = np.arange(minhash.COORDINATES, dtype=np.uint32)
    two = one.copy()
    two[3] += 1 << 16
    assert minhash.band_keys(one)[0] != minhash.band_keys(two)[0] and (minhash.band_keys(one)[1:] == minhash.band_keys(two)[1:]).all()
    for band, found in ((1, [10, 11]), (2, [])):  # their first common band is 1
        cell = pa.RecordBatch.from_pydict({
            "cell": [5, 5], "band": pa.array([band] * 2, pa.int32()), "v": [10, 11], "comp": [10, 11], "r": [1, 1], "n": [100, 100],
            "sig": [s.astype("<u2").tobytes() for s in (one, two)], "bands": [minhash.band_keys(s).tolist() for s in (one, two)]})
        assert [v for b in minhash._agreeing(85)([cell]) for v in b.column("v").to_pylist()] == found


BASE_PATTERNS = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
                 ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))


def test_secret_scan(spark):
    texts = [(1, "é password: 'abcDEF123456' x"), (2, "password=token: abcdefghijklmnop"), (3, None), (4, ""), (5, "AKIA12345678901234 AKIA1 deadbeefdeadbeef00"),
             (6, "key 8fJ2kQ9zLm4Xw7RtB1vN6cPdS3hY end"), (7, "id 123e4567-e89b-12d3-a456-426614174000 ok"), (8, "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1 thisisaverylongplainlowercaseword"),
             (9, "API_KEY=abcdefabcdef0123 " * 50), (None, "secret = short")]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        spans = sorted(((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE_PATTERNS) for m in re.finditer(p, t or "") if len(m[g]) >= n))
        base = ",".join(f"{BASE_PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert got[6].spans == "entropy:4:32" and not got[7].spans.count("entropy") and got[8].spans == ""


def test_secrets_beside_allowed_strings(spark):
    secret = "8fJ2kQ9zLm4Xw7RtB1vN6cPdS3hY"
    letters = "aKdJwPqLzXmNbVcRtYuIoH"
    by_chance = "8fJ2kQ9zLm4Xw7RtB1vNxxXx6cPdS3hY8fJ2kQ9zLm4XwT5g"
    want = {f"/samples/{secret}": secret, f"see {secret}/example": secret, by_chance: by_chance[:20], f"key {letters} end": letters, f"docs/of/the/module/{letters}": letters,
            "EXAMPLE8fJ2kQ9zLm4XwDUMMY": None, "getHTTPResponseCodeFromServer": None, "GitHub-Desktop-release-macOS/YouTube": None, "a_" * 6000: None, f"/samples/{'a_' * 6000}": None}
    texts = list(enumerate(want))
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        spans = [tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x]
        if want[t] is None:
            assert not spans, t[:40]
        else:
            at = t.index(want[t])
            assert any(a <= at and at + len(want[t]) <= b for a, b in spans), (t, got[i])


def test_entropy_counts_are_incremental(spark):
    text = "8fJ2kQ9zLm4Xw7RtB1vN6cPdS3hY8fffffffffffffffffff"

    def entropy(w):
        return -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
    hits = [s for s in range(len(text) - 19) if entropy(text[s:s + 20]) >= secret_scan.LIMITS["mixed"] - 1e-9]
    from pyspark.sql import functions as F
    d = spark.createDataFrame([(text,)], "t string").select(secret_scan.dense_stretch(F.col("t")).alias("d")).first().d
    assert (d.first, d.last) == (hits[0], hits[-1] + 20)


def test_line_dedup(docs, empty):
    rows = {r.doc_id: r for r in line_dedup.mark_repeated_lines(docs).collect()}
    assert rows[11].removed == [] and rows[13].kept_text == "" and rows[13].removed == [0, 1, 2, 3]
    assert rows[12].removed == [1, 2, 3, 4] and rows[12].kept_text == "zero\nlast"
    assert rows[5].kept_text == "" and rows[3].removed == []
    assert line_dedup.mark_repeated_lines(empty).count() == 0


def test_line_dedup_by_content(spark):
    """With words: a long line alone is a window; without: as before."""
    rng = np.random.default_rng(7)
    lines = [" ".join(f"w{k}_{j}" for j in range(n)) for k, n in enumerate((1, 2, 3, 5, 6, 9, 12, 1, 4, 7))]
    texts = [(i, "\n".join(["", "  ", *lines][k] for k in rng.integers(0, 12, rng.integers(1, 7)))) for i in range(60)] + [(60, None), (61, lines[6]), (62, f"x\n\n{lines[6]} ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for words in (6, None):
        seen, want = set(), {}
        for i, t in texts:
            seq = [(at, " ".join(x.split())) for at, x in enumerate((t or "").split("\n")) if x.strip()]
            want[i] = set()
            for s in range(len(seq)):
                short = [n for n in (1, 2) if words and s + n <= len(seq) and sum(len(x.split()) for _, x in seq[s:s + n]) >= words][:1]
                for n in short + [3] * (s + 3 <= len(seq)):
                    w = tuple(x for _, x in seq[s:s + n])
                    if w in seen:
                        want[i] |= set(range(seq[s][0], seq[s + n - 1][0] + 1))
                    seen.add(w)
        rows = line_dedup.mark_repeated_lines(df, words=words).collect()
        assert {r.doc_id: r.removed for r in rows} == {i: sorted(x) for i, x in want.items()}
        assert ({61, 62} <= {i for i, x in want.items() if x}) == bool(words)


def test_decontamination(spark, empty):
    item = "If Anna buys 12 red apples and Anna sells 5 of them at 30 km from home how many apples remain in the green basket"
    bench = spark.createDataFrame([(1, item), (2, "tiny one"), (3, None)], "item_id long, text string")
    other = item.replace("Anna", "Maria").replace("12", "40")
    mixed = item.replace("Anna buys", "Maria buys").replace("30 km", "30 mi")  # one name becomes two
    texts = [(1, "before " + item + " after"), (2, "x " + other), (3, "unrelated words here and there"), (4, None), (5, ""), (6, mixed), (1, "before " + item + " after")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = decontaminate.find_contaminated(df, bench).collect()
    # Document 6 holds eight words in a row as they are: that counts, though its other windows contradict each other.
    assert Counter((r.doc_id, r.item_id, r.kind) for r in rows) == {(1, 1, "verbatim"): 2, (2, 1, "re-parameterised"): 1, (6, 1, "verbatim"): 1}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()) == [3, 4, 5]
    assert decontaminate.find_contaminated(empty, bench).count() == 0


def test_decontamination_of_items_dense_in_slots(spark):
    dense = "Sort 3 9 4 1 then 8 2 7 and 5 6 0 last 11 12 13 done"
    items = [(1, "What is 12 + 7 - 3 * 4 / 2 + 9 ?"), (2, "Add 12 and 30 together"), (3, "Anna Bob Carl Dora Emil Fritz Gina Hans Ida Jon"), (4, dense), (5, "tiny one"), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    other = "Sort 30 90 40 10 then 80 20 70 and 50 60 100 last 21 22 23 done"
    texts = [(i, f"some words before it. {t} and more after it") for i, t in items[:4]] + [
        (11, "What is 13 + 7 - 3 * 4 / 2 + 9 ?"), (12, "Add 12 and 31 together"), (14, "x. " + other), (15, "x. " + other.replace("done", "gone"))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = decontaminate.find_contaminated(df, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in rows) == [(i, i, "verbatim") for i in (1, 2, 3, 4)] + [(14, 4, "re-parameterised")]
    assert sorted(map(tuple, decontaminate.limited_items(bench).collect())) == [
        (1, 8, "verbatim only"), (2, 5, "verbatim only"), (3, 10, "verbatim only"), (5, 2, "never"), (6, 0, "never")]


def test_decontamination_of_items_inside_a_text(spark):
    """An item's first word follows what makes it look like a name or a unit."""
    long = "Given that 1 2 3 4 5 6 7 8 are numbers say which of them is odd"
    items = [(1, "What is the capital of France"), (2, "In which year did the long war end"), (3, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [("Some text. Question: What is the capital of France", 1, "verbatim"), ("(A) What is the capital of France?", 1, "verbatim"),
             ("A heading\nWhat is the capital of France", 1, "verbatim"), ("Question: What is the capital of Spain", 1, "re-parameterised"),
             ("Question 12. In which year did the long war end", 2, "verbatim"), ("Question: " + long, 3, "verbatim")]
    texts = [(i, t) for i, (t, _, _) in enumerate(found)] + [(90, "Question: Where is the capital of France"), (91, "Question: What was the capital of France")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = decontaminate.find_contaminated(df, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in rows) == [(i, item, kind) for i, (_, item, kind) in enumerate(found)]
    assert {r.windows for r in rows if r.item_id == 3} == {decontaminate.find_contaminated(df.selectExpr("doc_id", f"'{long}' AS text").limit(1), bench).first().windows}


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeinorst"), 5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 60).tolist() + (["vilestuff"] if i % 5 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame(rows + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    assert got[9001].score == got[9002].score and got[9001].predicted == 0
    none = toxicity.score_documents(docs, labels.where("toxic = 0")).collect()
    assert len(none) == len(got) and len({r.score for r in none}) == 1


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://a.b.com/x", 5), (2, "http://a.b.com/x", 15), (3, None, 5), (4, "https://u@B.com:8080/", 25), (5, "http://b.com", None), (1, "http://a.b.com/x", 5)],
                                  "page_id long, url string, fetched long")
    entries = spark.createDataFrame([("l", "b.com", "add", 1), ("l", "b.com", "add", 3), ("l", "b.com", "remove", 10), ("l", "b.com", "add", 20), ("m", "a.b.com", "add", 5),
                                     ("m", "a.b.com", "remove", 5), (None, "b.com", "add", 1)], "list string, target string, action string, at long")
    got = Counter((r.page_id, r.lists, r.blocked) for r in url_filter.filter_captures(pages, entries).collect())
    assert got == {(1, "l", True): 2, (2, "", False): 1, (3, "", False): 1, (4, "l", True): 1, (5, "", False): 1}
    assert not any(r.blocked for r in url_filter.filter_captures(pages, entries.where("1 = 0")).collect())
