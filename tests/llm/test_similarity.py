"""Near-duplicate join (op1), components and fingerprints (op7)."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from tillroll.llm import fingerprints, ngram_join, shingles
from tillroll.llm.components import components


def word_sets(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    """Smallest reachable id per row, from all pairs."""
    sets = [(d, word_sets(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def test_shingles_match_words(small_docs, odd_rows):
    texts = [t for _, t in small_docs + odd_rows]
    sizes = []
    for _, hashes, counts in shingles.words(pa.array(texts, pa.string())):
        sizes += shingles.shingle_sets(hashes, counts)[1].tolist()
    assert sizes == [len(word_sets(t)) for t in texts]


def test_components_of_odd_rows(odd_docs, odd_rows):
    got = sorted((tuple(r) for r in ngram_join.ngram_components(odd_docs).collect()), key=str)
    assert got == brute_components(odd_rows)


def test_components_of_near_copies(spark):
    """Chains of edits, a large group of near copies, a shared passage."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows = []
    for base in range(6):
        text = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        for k in range(12):
            changed = list(text)
            for _ in range(rnd.randint(0, 4)):
                changed[rnd.randrange(len(changed))] = f"e{rnd.randrange(10 ** 6)}"
            rows.append((1000 * base + 7 * k, " ".join(changed)))
            if k % 4 == 3:
                text = changed
    text = [rnd.choice(words) for _ in range(150)]  # many copies, most of them edited beyond the threshold
    for i in range(150):
        changed = list(text)
        for _ in range(rnd.randint(2, 7)):
            changed[rnd.randrange(len(changed))] = f"e{rnd.randrange(10 ** 6)}"
        rows.append((20_000 + i, " ".join(changed)))
    rows += [(9000 + i, " ".join(passage + [rnd.choice(words) for _ in range(rnd.choice([5, 40, 90]))])) for i in range(25)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) < len(rows) - 20


def test_join_of_no_documents(no_docs):
    assert ngram_join.ngram_components(no_docs).collect() == []


def test_one_of_each(odd_docs, odd_rows):
    left = ngram_join.one_of_each(odd_docs)
    assert left.columns == odd_docs.columns
    smallest = {d for d, _, c in brute_components(odd_rows) if d is not None and d == c}
    got = [r["doc_id"] for r in left.collect()]
    assert sorted(d for d in got if d is not None) == sorted(smallest)
    assert got.count(None) == 2


def test_bitmaps_never_overrate():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 500, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(rng.integers(0, 500, rng.integers(1, 300)).astype(np.uint64))
        c = b[:len(b) // 3 + 1]
        low = ngram_join.least_differences(ngram_join.parity(a), [ngram_join.parity(b), ngram_join.parity(c), ngram_join.parity(a)])
        assert low[0] <= len(np.setxor1d(a, b)) and low[1] <= len(np.setxor1d(a, c)) and low[2] == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = dict((r["id"], r["component"]) for r in components(links, "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# fingerprints

def slow_fingerprint(text):
    """The walks of one text, step by step."""
    import numpy as np
    cps, out = np.array([ord(c) for c in text], np.uint64), []
    for walk in range(fingerprints.WALKS):
        stays, step, at = fingerprints._stays(walk), 0, []
        for i, c in enumerate(fingerprints._classes(cps, walk)):
            for _ in range(1 + int(stays[(c << 13) | (step & 8191)])):
                at.append(i)
                step += 1
        level = max(0, (len(at) - 1).bit_length())
        last, symbols = len(text) - 1, b""
        for p in fingerprints.positions(level):
            if p < len(at):
                i = at[p]
                three = (int(cps[i]) * 0x100000001B3 + int(cps[min(i + 1, last)]) * 0x10001 + int(cps[min(i + 2, last)])) % 2 ** 64
                symbols += bytes([int(fingerprints._mix(np.array([three], np.uint64) * fingerprints.MIX)[0] >> np.uint64(56))])
        out.append(f"{level}:{symbols.hex()}")
    return "-".join(out)


def test_walks_match_the_slow_one(small_docs):
    texts = [t[:1500] for _, t in small_docs[:60]] + ["", "a", "ab", "日本語"]
    assert fingerprints.fingerprint(texts) == [slow_fingerprint(t) for t in texts]


def check_fingerprints(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        changed = fingerprints.edited(t, nxt)
        a, b, c = fingerprints.fingerprint([t, changed, nxt])
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_fingerprints_of_odd_rows(odd_docs, odd_rows):
    check_fingerprints(odd_rows, fingerprints.fingerprints(odd_docs).collect())


def test_fingerprints_of_documents(spark, small_docs):
    got = fingerprints.fingerprints(spark.createDataFrame(small_docs, "doc_id long, text string")).collect()
    check_fingerprints(small_docs, got)
    near = sorted(r["near_edited"] for r in got if r["n_chars"] > 200)
    far = sorted(r["near_next"] for r in got if r["n_chars"] > 200)
    assert near[len(near) // 20] > 0.5 > 0.1 > far[-len(far) // 20]


def test_fingerprints_of_one_and_none(spark, no_docs):
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    check_fingerprints([(1, "abcdef")], one)
    assert fingerprints.fingerprints(no_docs).collect() == []


def test_similar_finds_near_copies(spark, small_docs):
    text = max((t for _, t in small_docs), key=len)[:3000]
    rnd = random.Random(5)
    rows = [(i, text if i < 3 else "".join("#" if rnd.random() < 0.001 else c for c in text)) for i in range(8)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(small_docs[:30])]
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = fingerprints.similar(prints, at_least=0.5).collect()
    assert {r["right_id"] for r in pairs if r["left_id"] == 0} >= set(range(1, 8))
    assert all(r["left_id"] < 8 or dict(rows)[r["left_id"]][:40] == dict(rows)[r["right_id"]][:40] for r in pairs)


def test_similar_across_lengths(spark):
    """Near texts whose walks end on either side of a power of two."""
    rnd = random.Random(8)
    text = "".join(chr(rnd.randrange(97, 123)) for _ in range(640))
    rows = [(1, text[:470]), (2, text[:560])]
    levels = [{x.split(":")[0] for x in fp.split("-")} for fp in fingerprints.fingerprint([t for _, t in rows])]
    assert not levels[0] & levels[1]
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r["left_id"], r["right_id"]) for r in fingerprints.similar(prints).collect()] == [(1, 2)]


def test_classes_follow_chains(spark, small_docs, odd_docs, odd_rows):
    """Each text is near the next; the first and the last are unlike."""
    rnd = random.Random(8)
    text = list((max((t for _, t in small_docs), key=len) * 2)[:3000])
    rows = []
    for i in range(12):
        rows.append((i, "".join(text)))
        a = 3000 - 250 * (i + 1)
        text[a:a + 250] = [chr(rnd.randrange(97, 123)) for _ in range(250)]
    rows += [(100 + i, "%03d" % i) for i in range(200)]  # short texts
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.classed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(12)] == [0] * 12 and min(got[i] for i in range(100, 300)) == 100
    odd = fingerprints.classed(odd_docs).collect()
    assert len(odd) == len(odd_rows)
    of = {r["doc_id"]: r["class_id"] for r in odd if r["doc_id"] is not None}
    assert of[1] == of[2] == 1 and of[7] == of[8] == 7 and of[4] == of[5] == of[-7] == -7


def test_all_likeness(small_docs):
    texts = [t or "" for _, t in small_docs[:25]] + ["", "abc", "abd", "the quick brown"]
    prints = fingerprints.fingerprint(texts + [t[:len(t) * 3 // 4] for t in texts])
    got = fingerprints._all_likeness(prints, prints)
    assert all(got[i, j] == pytest.approx(fingerprints.likeness(x, y)) for i, x in enumerate(prints) for j, y in enumerate(prints) if x != y)


@pytest.mark.parametrize("a,b,low,high", [("", "", 1, 1), ("", "abc", 0, 0), ("abc" * 50, "abc" * 50, 1, 1)])
def test_likeness_of_edges(a, b, low, high):
    x, y = fingerprints.fingerprint([a, b])
    assert low <= fingerprints.likeness(x, y) <= high


def test_edited_prints_go_on_from_the_cut(small_docs):
    texts = [t or "" for _, t in small_docs[:50]] + ["", "a", "ab", "abc", "", "x" * 9000, "日本語 é"] + [t or "" for _, t in small_docs[50:60]]
    own, changed = fingerprints.both_prints(texts)
    assert own == fingerprints.fingerprint(texts)
    assert changed == fingerprints.fingerprint([fingerprints.edited(t, f) for t, f in zip(texts, texts[1:], strict=False)])


def prints_of(spark, rows):
    return fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))


def all_pairs_classes(got, at_least):
    root = {d: d for d, _ in got}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d
    for i, (a, x) in enumerate(got):
        for b, y in got[:i]:
            if x == y or fingerprints.likeness(x, y) >= at_least:
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: top(d) for d in root}


@pytest.mark.parametrize("block", [3, fingerprints.BLOCK])
def test_classes_against_all_pairs(spark, small_docs, monkeypatch, block):
    """Recall of the banding: of the pairs that are alike by all pairs at
    least nine in ten share a class; buckets over BLOCK meet in blocks."""
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rnd = random.Random(2)
    rows = [(i, t) for i, (_, t) in enumerate(small_docs[:90])]
    for k in range(12):  # edits of a text each
        base = rows[5 * k][1] or "empty"
        rows += [(1000 + 10 * k + j, "".join(rnd.choice("etaoin ") if rnd.random() < 0.004 * j else c for c in base)) for j in range(1, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["fingerprint"]) for r in fingerprints.classed(df).collect()}
    want = all_pairs_classes([(d, fp) for d, (_, fp) in found.items()], 0.6)
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    together = sum(found[a][0] == found[b][0] for a, b in pairs)
    assert len(pairs) > 30 and together >= 0.9 * len(pairs)
    assert all(want[a] == want[b] for a in found for b in found if found[a][0] == found[b][0])


def test_recall_against_edit_distance(spark):
    """Texts within one edit in fifty characters of each other, by the true
    edit distance, fall into one class nine times in ten."""
    rnd = random.Random(6)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    rows, near = [], []
    for k in range(25):
        text = "".join(chr(rnd.randrange(97, 123)) if rnd.random() < 0.8 else " " for _ in range(400))
        other = list(text)
        for _ in range(rnd.randint(1, 4)):
            at = rnd.randrange(len(other))
            kind = rnd.randrange(3)
            other[at:at + (kind != 0)] = [] if kind == 1 else [chr(rnd.randrange(97, 123))]
        rows += [(2 * k, text), (2 * k + 1, "".join(other))]
        if distance(text, "".join(other)) <= 8:
            near.append(k)
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.classed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) == 25 and sum(got[2 * k] == got[2 * k + 1] for k in near) >= 0.9 * len(near)
    assert all(got[a] // 2 == a // 2 for a in got)


def test_two_texts_under_one_id_keep_both_links(spark):
    words = [f"w{i}" for i in range(400)]
    a, b, c = words[:60], words[100:160], words[200:260]
    rows = [(4, " ".join(a)), (4, " ".join(b)), (4, " ".join(b)), (10, " ".join([*b[:58], "x"])), (11, " ".join([*a[:58], "y"])),
            (12, " ".join(b)), (3, " ".join(c)), (4, " ".join(c)), (20, " ".join(words[300:350]))]
    for shuffled in (rows, rows[::-1]):
        df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(3)
        got = sorted((tuple(r) for r in ngram_join.ngram_components(df).collect()), key=str)
        assert {(d, k) for d, _, k in got} == {(4, 3), (10, 3), (11, 3), (12, 3), (3, 3), (20, 20)}


def test_sizes_as_spark_spells_them(spark, odd_docs):
    from tillroll.llm import common
    assert [common.byte_size(x) for x in ("8388608", "64MB", "8m", " 2 k", "1g", "7b", "3KiB")] == [8388608, 64 << 20, 8 << 20, 2048, 1 << 30, 7, 3072]
    with common.setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "64MB"):
        common.with_package(odd_docs)


def test_classes_join_each_near_copy_once(spark, monkeypatch):
    """Near copies meet several leaders; the classes need one link of each."""
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(words[:9 * i] + [f"other{i}"] + words[9 * i + 1:])) for i in range(40)] + [(99, "something else")]
    given, real = [], fingerprints.components

    def counted(links, left, right):
        given.append((links.select(left, right).distinct().count(), links.select(left).union(links.select(right)).distinct().count()))
        return real(links, left, right)

    monkeypatch.setattr(fingerprints, "components", counted)
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.classed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(40)} | {99: 99}
    assert given[0][0] > given[0][1]  # the leaders' links: several a copy
    assert given[-1][0] <= given[-1][1]


def test_open_buckets_meet_their_leader_in_one_join(spark):
    members = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 1), (3, 1, 1), (3, 2, 2), (3, 3, 3), (4, 3, 3), (4, 4, 4)],
                                    "key long, k long, c long")
    got = fingerprints._open(members, 1)
    rows = got.collect()
    assert {(r.key, r.n) for r in rows} == {(1, 3), (4, 2)} and len(rows) == 5  # 2 holds one class, 3 the members of 1
    assert all(len({r.a for r in rows if r.key == key}) == 1 for key in (1, 4)) and all(r.a == r.ca for r in rows)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_open_buckets_are_read_out_once(spark, monkeypatch):
    """Later rounds meet only members of other classes than their leader's."""
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(words[:9 * i] + [f"other{i}"] + words[9 * i + 1:])) for i in range(40)] + [(99, "something else")]
    turns, real = [], fingerprints._open

    def counted(members, turn):
        turns.append(turn)
        return real(members, turn)

    monkeypatch.setattr(fingerprints, "_open", counted)
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.classed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert turns == [1] and got == {i: 0 for i in range(40)} | {99: 99}
    held = spark.createDataFrame([(1, 1, 1, (7, 1), 3), (1, 2, 2, (5, 2), 3), (2, 1, 1, (7, 1), 2), (2, 4, 1, (3, 4), 2)],
                                 "key long, c long, now long, l struct<h long, k long>, n long")
    got = fingerprints._next_leaders(held).collect()  # 2 holds one class by now
    assert sorted((r["key"], r["c"], r["a"], r["ca"]) for r in got) == [(1, 1, 2, 2), (1, 2, 2, 2)]


def test_join_leaves_no_sets_behind(spark):
    """Shingle sets are the join's largest tables; they go once compared."""
    from pathlib import Path

    from tillroll import session
    folder = Path(session.ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("join-*"))
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:200] + [f"x{i}"])) for i in range(4)] + [(9, " ".join(words[100:]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    left = [f for f in set(folder.glob("join-*")) - before if f.name.startswith(("join-sets", "join-tried", "join-met", "join-offers"))]
    assert not [f for f in left if any(f.iterdir())]


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Stars are told by their ends; each round writes its links."""
    from tillroll.llm import components as module
    tables, real = [], module.written
    monkeypatch.setattr(module, "written", lambda df, what: tables.append(what) or real(df, what))
    links = spark.createDataFrame([(5, i) for i in range(6, 30)] + [(40, 41), (40, 41), (5, 6)], "a long, b long")
    got = sorted((r["id"], r["component"]) for r in components(links, "a", "b").collect())
    assert got == [(i, 5) for i in range(5, 30)] + [(40, 40), (41, 40)]
    assert len(tables) == 1
    for links in ([(1, 3), (2, 3)], [(1, 2), (2, 3)], [(i, i + 1) for i in range(20)] + [(30, i) for i in range(31, 300)]):  # not stars
        low = min(a for a, _ in links if a < 30)
        got = dict((r["id"], r["component"]) for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
        assert got == {x: low if x < 30 else 30 for link in links for x in link}


def meeting(rows):
    names = ["key", "i", "j", "k", "id", "c", "block", "fp"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    table = pa.Table.from_arrays([pa.array(v, k) for v, k in zip(zip(*sorted(rows, key=lambda r: r[:3]), strict=True), kinds, strict=True)], names)
    return [r for b in fingerprints._blocks_meet(0.6)(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]


def test_rows_of_one_class_never_meet(small_docs, monkeypatch):
    """A bucket of one large class and a few others costs as many comparisons
    as there are pairs of different classes."""
    compared, real = [], fingerprints.Prints.likeness
    monkeypatch.setattr(fingerprints.Prints, "likeness", lambda self, x, y: compared.append(len(x)) or real(self, x, y))
    base = max((t for _, t in small_docs if t), key=len)[:2000]
    prints = fingerprints.fingerprint([base[:900 + i] + chr(97 + i % 26) + base[901 + i:] for i in range(40)])
    rows = [(7, 0, 0, 100 + i, i or None, 1 if i < 37 else i, 0, p) for i, p in enumerate(prints)]
    got = meeting(rows)
    assert sum(compared) == 37 * 3 + 3
    want = {(min(x, y), max(x, y)) for x in range(40) for y in range(37, 40) if x != y and fingerprints.likeness(prints[x], prints[y]) >= 0.6}
    assert want and {tuple(sorted((r["a"] - 100, r["b"] - 100))) for r in got} == want and len(got) == len(want)
    assert all(r["likeness"] == fingerprints.likeness(prints[r["a"] - 100], prints[r["b"] - 100]) and r["ca"] != r["cb"] for r in got)
    assert all(r["b"] == 100 for r in got if 100 in (r["a"], r["b"]))  # no id comes last
    # two blocks, each with itself and with the other
    two = [(7, min(m, o), max(m, o), *r[3:6], m, r[7]) for r in rows for m in [r[3] % 2] for o in (0, 1)]
    compared.clear()
    key = lambda r: (r["a"], r["b"])
    assert sorted(meeting(two), key=key) == sorted(got, key=key) and sum(compared) == 37 * 3 + 3


def test_few_pairs_meet_without_further_leaders(spark, small_docs, monkeypatch):
    """Rounds of leaders are run where they spare comparisons; either way
    the classes are the same."""
    rnd = random.Random(8)
    text, rows = list((max((t for _, t in small_docs), key=len) * 2)[:3000]), []
    for i in range(12):  # each is near the next, the first and the last are unlike
        rows.append((i, "".join(text)))
        a = 3000 - 250 * (i + 1)
        text[a:a + 250] = [chr(rnd.randrange(97, 123)) for _ in range(250)]
    docs, runs, real = spark.createDataFrame(rows, "doc_id long, text string"), [], fingerprints.components
    monkeypatch.setattr(fingerprints, "components", lambda *a: runs.append(1) or real(*a))
    got = []
    for pairs in (fingerprints.PAIRS, -1):
        monkeypatch.setattr(fingerprints, "PAIRS", pairs)
        runs.clear()
        got.append(({r["doc_id"]: r["class_id"] for r in fingerprints.classed(docs, at_least=0.95).collect()}, len(runs)))
    assert got[0][0] == got[1][0] and len(got[0][0]) == 12
    assert [n for _, n in got] == [2, 1 + fingerprints.LEADERS]


def test_shared_keys_name_their_first_row():
    rows = [(1, 5), (3, 5), (9, 5), (2, 6), (4, 7), (8, 7), (1, 8), (2, 9), (7, 9)]
    for size in (1, 2, 3, 20):
        table = pa.table({"k": pa.array([k for k, _ in rows], pa.int64()), "key": pa.array([key for _, key in rows], pa.int64())})
        got = [tuple(r.values()) for b in fingerprints._shared(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert got == [(1, 5, 1), (3, 5, 1), (9, 5, 1), (4, 7, 4), (8, 7, 4), (2, 9, 2), (7, 9, 2)]
