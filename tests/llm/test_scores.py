"""Quality (op2), pseudonyms (op4), top-k (op8), language model (op9), pipeline."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tillroll.llm import lm, pseudonyms, quality, vector_search


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_SMALL}/labels.parquet")


# quality

def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, marks)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(scores[r["doc_id"]], r["quality"]) for r in marks.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.9


def test_held_out_labels_are_not_learned(spark, documents, labels):
    from pyspark.sql import functions as F
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(documents, labels), quality.train(documents, turned)
    assert a.key() == b.key() and np.array_equal(a.weights, b.weights)


def test_quality_of_odd_rows(spark, documents, labels, odd_docs, odd_rows, no_docs):
    model = quality.train(documents, labels)
    got = quality.score(odd_docs, model).collect()
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(d) for d, _ in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2)} == {model.prior}
    assert quality.keep(odd_docs, model).columns == odd_docs.columns
    assert quality.score(no_docs, model).collect() == []


def test_quality_without_labels(spark, documents, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(3, 1), (4, None), (None, 0), (6, 5)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(odd_docs, quality.train(documents, none)).collect()} == {0.5}
    assert {r["score"] for r in quality.score(odd_docs, quality.train(documents, one)).collect()} <= {0.5, 1.0}


# pseudonyms

def luhn(s):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(s)))) % 10 == 0


def pseudonymised(spark, texts, key="k1"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pseudonyms.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_formats_stay_valid(spark):
    cards = ["4111111111111111", "5500005555555559", "4000 0012 3456 7899", "378282246310005"]
    texts = [f"x {c} y" for c in cards] + ["a 97.51.17.173.", "d 1984-02-29", "IBAN GB82 WEST 1234 5698 7654 32", "+1 (706) 555-3138",
                                          'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "die.55@mail4.example.com,", "123-45-6789"]
    out = pseudonymised(spark, texts)
    for a, b in zip(texts, out, strict=True):
        assert a != b
        if not a.startswith("a "):
            assert re.sub("[0-9]", "0", re.sub("[a-zA-Z]", "a", a)) == re.sub("[0-9]", "0", re.sub("[a-zA-Z]", "a", b)) or "token" in a
    assert all(luhn(re.sub("[^0-9]", "", b)) for b in out[:4])
    assert all(int(x) < 256 for x in out[4][2:-1].split("."))
    iban = re.sub("[^0-9A-Z]", "", out[6][5:])
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[8]) and out[9].endswith(".com,") and out[7].startswith("+1 (")


def test_neighbours_do_not_hide_each_other(spark):
    parts = ["+1 (826) 555-4081", "190.137.223.204", "4111111111111111", "bob.7@mail.example.com", "10.1.2.3", "+1 (826) 555-4082"]
    (out,) = pseudonymised(spark, [" ".join(parts)])
    assert len(out.split(" ")) == len(" ".join(parts).split(" "))
    assert not any(p in out for p in parts)


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112", "300.1.2.3", "1984-02-30", "1.2.3.4.5", "000-12-3456", "GB00WEST12345698765432", "version 12", "plain", "", None,
             "abc4111111111111111", "0000000000000000"]
    assert pseudonymised(spark, texts) == texts


def test_pseudonyms_link_and_differ(spark):
    cards = [f"4{n:014d}" for n in range(300)]
    cards = [c + str(next(d for d in range(10) if luhn(c + str(d)))) for c in cards]
    days = [f"{1900 + n // 12}-{n % 12 + 1:02d}-11" for n in range(300)]
    ips = [f"10.0.{n // 250}.{n % 250}" for n in range(300)]
    for values in (cards, days, ips):
        out = pseudonymised(spark, [f"see {v} and {v}, again" for v in values])
        assert all(re.fullmatch(r"see (\S+) and \1, again", t) for t in out)  # equal values stay linked
        assert len(set(out)) == len(values)  # different ones stay apart
    assert pseudonymised(spark, cards[:5], "k1") != pseudonymised(spark, cards[:5], "k2")


def slow_feistel(key, what, left, right, size_l, size_r):
    import hashlib
    f = lambda i, other, n: int(hashlib.sha256(f"{key}|{what}|{i}|{other}".encode()).hexdigest()[:15], 16) % n
    for i in range(1, 9):
        if i % 2:
            left = (left + f(i, right, size_l)) % size_l
        else:
            right = (right + f(i, left, size_r)) % size_r
    return left, right


def test_feistel_matches_a_plain_one(spark):
    import datetime
    day = (datetime.date(1984, 2, 29) - datetime.date(1800, 1, 1)).days
    a, b = slow_feistel("k1", "date", day // 5411, day % 5411, 27, 5411)
    l, r = slow_feistel("k1", "ip", 10 * 256 + 1, 2 * 256 + 3, 65536, 65536)
    c, d = slow_feistel("k1", "card15", 4111111, 11111111, 10 ** 7, 10 ** 8)
    card = f"{c:07d}{d:08d}"
    card += next(str(x) for x in range(10) if luhn(card + str(x)))
    assert pseudonymised(spark, ["1984-02-29", "10.1.2.3", "4111111111111111"]) == [
        str(datetime.date(1800, 1, 1) + datetime.timedelta(a * 5411 + b)), f"{l // 256}.{l % 256}.{r // 256}.{r % 256}", card]


def test_other_dates_telephones_and_secrets(spark):
    texts = ["at 1984-02-29T10:00:00Z.", "1984/02/29", "02/29/1984", "29/02/1984", "29.02.1984", "29 Feb 1984", "February 29, 1984", "2-9-1984",
             "706 555 3138", "(706) 555 3138", "secret=abcdefabcdefabcdef", "API_KEY: 'abcdefabcdefabcdef'"]
    out = pseudonymised(spark, texts)
    assert all(a != b for a, b in zip(texts, out, strict=True))
    iso = re.fullmatch(r"at (\d{4}-\d\d-\d\d)T10:00:00Z\.", out[0]).group(1)
    y, m, d = iso.split("-")
    names = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
    assert out[1:3] == [f"{y}/{m}/{d}", f"{m}/{d}/{y}"] and out[4] == f"{d}.{m}.{y}"
    assert out[5:7] == [f"{d} {names[int(m) - 1][:3]} {y}", f"{names[int(m) - 1]} {d}, {y}"]
    assert re.fullmatch(r"\d{1,2}-\d{1,2}-\d{4}", out[7]) and re.fullmatch(r"\d{3} \d{3} \d{4}", out[8]) and re.fullmatch(r"\(\d{3}\) \d{3} \d{4}", out[9])
    assert pseudonymised(spark, ["13/32/1984", "30 Feb 1984", "31.04.1984", "1984-02-29Tx"]) == ["13/32/1984", "30 Feb 1984", "31.04.1984", "1984-02-29Tx"]
    many = [f"{d}/{m:02d}/{y}" for y in (1990, 1991) for m in range(1, 13) for d in range(1, 29)]
    got = pseudonymised(spark, many)
    assert len(set(got)) == len(many)
    assert all((int(a.split("/")[0]) > 12) == (int(b.split("/")[0]) > 12) for a, b in zip(many, got, strict=True))


def test_pseudonyms_of_odd_rows(odd_docs, no_docs):
    out = pseudonyms.pseudonymise(odd_docs, "k1")
    assert out.columns == odd_docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))  # nothing personal in them
    assert pseudonyms.pseudonymise(no_docs, "k1").collect() == []


def test_pseudonyms_run_without_python(odd_docs):
    plan = pseudonyms.pseudonymise(odd_docs, "k1")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# top-k

def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = {i: (rng.normal(0, 0.3, 8) * (rng.random(8) < 0.6)).astype(np.float32).tolist() for i in range(0, 300)}
    for i in range(100, 140):
        vecs[i] = vecs[100]  # ties
    vecs |= {1000: None, 1001: [0.1, None] + [0.0] * 6, 1002: [float("nan")] * 8, 1003: [float("inf")] + [0.0] * 7, 1020: [0.5, -0.5], 1040: []}
    df = spark.createDataFrame([(i, v, 9) for i, v in vecs.items()] + [(None, [0.1] * 8, 9)], "vec_id long, embedding array<float>, block int")
    fine = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in vecs.items()
            if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in fine if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(fine[q], fine[c], strict=False)), c) for c in fine if c != q)[:20]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in vector_search.top_k(df).collect()) == sorted(want)
    assert vector_search.top_k(df.limit(0)).collect() == []


@pytest.mark.parametrize("density", [0.1, 1.0])
def test_score_block(density):
    rng = np.random.default_rng(2)
    q, c = ((rng.integers(-90, 90, (n, 16)) * (rng.random((n, 16)) < density)) for n in (7, 50))
    assert np.array_equal(vector_search.score_block(q, c), q @ c.T)
    assert np.array_equal(vector_search.score_block(q * 10 ** 8, c), (q * 10 ** 8) @ c.T)


# language model

def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + ["\n"]


def check_lm(rows, got):
    train = [w for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10 for w in words(t)]
    c, n = collections.Counter(train), len(train)
    want = []
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w)
        want.append((d, None if d is None else zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, round(base, 5)))
    assert sorted((tuple(r)[:5] + (round(r["base_score"], 5),) for r in got), key=str) == sorted(want, key=str)
    assert all(r["score"] < 0 for r in got)


def test_lm_of_documents(documents, small_docs):
    got = lm.score(documents).collect()
    check_lm(small_docs, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_of_odd_rows(odd_docs, odd_rows, no_docs):
    check_lm(odd_rows, lm.score(odd_docs).collect())
    assert lm.score(no_docs).collect() == []


def test_every_previous_word_is_a_context(spark):
    """No word is frequent, yet each tells the next one."""
    rng = np.random.default_rng(5)
    after = rng.permutation(1000)
    rows = []
    for d in range(400):
        w = [int(rng.integers(1000))]
        while len(w) < 60:
            w.append(int(after[w[-1]]))
        rows.append((d, " ".join(f"w{x}" for x in w)))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_lm(rows, got)
    held = [r for r in got if r["held_out"]]
    # the end and the first word cannot be told; all others can
    assert sum(r["score"] for r in held) > 0.25 * sum(r["base_score"] for r in held)


def test_seating_probabilities_sum_to_one(spark):
    """Every context's predictive probabilities over the V + 1 types."""
    rng = np.random.default_rng(0)
    n_words, n_contexts = 30, 4
    context, word = np.divmod(np.arange(n_words * n_contexts), n_words)
    count = rng.poisson(3, n_words * n_contexts) * (rng.random(n_words * n_contexts) < 0.6)
    totals = lm.Totals(np.bincount(context, weights=count), n_words, 0.6, 0.4)
    for tables, root, _ in lm.sweeps(word, context, count, n_words, totals, 3, [1]):
        assert ((tables >= np.minimum(count, 1)) & (tables <= count)).all()
    totals.tables = np.bincount(context, weights=tables)
    totals.root_customers, totals.root_tables = totals.tables.sum(), root.sum()
    base = (lm.THETA + totals.d0 * totals.root_tables) / (totals.types + 1)
    p0 = (np.bincount(word, weights=tables) - totals.d0 * root + base) / (lm.THETA + totals.root_customers)
    assert p0.sum() + totals.unknown() == pytest.approx(1)
    back = (lm.THETA + totals.d1 * totals.tables)[context]
    p = (count - totals.d1 * tables + back * p0[word]) / (lm.THETA + totals.customers)[context]
    miss = (lm.THETA + totals.d1 * totals.tables) * totals.unknown() / (lm.THETA + totals.customers)
    assert np.bincount(context, weights=p) + miss == pytest.approx(np.ones(n_contexts))


def test_exact_seating_matches_its_distribution():
    d, mass, c = 0.5, 0.8, 6
    got = lm.seat(np.full(40_000, c), np.full(40_000, mass), d, np.random.default_rng(1))
    s = lm._stirling(d)[c, 1:c + 1] + np.arange(1, c + 1) * math.log(mass)
    p = np.exp(s - s.max())
    assert np.bincount(got, minlength=c + 1)[1:] / 40_000 == pytest.approx(p / p.sum(), abs=0.01)


# pipeline

def test_pipeline(spark, documents):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    ids = {r["doc_id"] for r in rows}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 0").collect()}
    assert ids <= {r["doc_id"] for r in documents.collect()} and len(ids & bad) <= len(bad) / 3
    assert len(ids) > 100


def test_stages_keep_columns_and_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_SMALL)
            assert docs.columns == odd_docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
