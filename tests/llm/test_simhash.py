import random
import re

import pytest
import xxhash

from tillroll.llm import simhash


def bits_of(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, distance=4):
    """All pairs: doc_id -> smallest doc_id reachable."""
    known = [(d, bits_of(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in known}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if a == b or (x ^ y).bit_count() <= distance:
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return sorted(((d, f"{bits_of(t):016x}", None if d is None else top(d)) for d, t in rows), key=repr)


def found(docs, **kw):
    return sorted((tuple(r) for r in simhash.near_duplicates(docs, **kw).select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_equals_all_pairs_on_a_table(spark, small_docs):
    docs = spark.createDataFrame(small_docs, "doc_id long, text string").repartition(5)
    want = classes(small_docs)
    assert found(docs) == want
    assert len({c for _, _, c in want}) < len(want)


def test_odd_rows_and_empty_table(spark, odd_docs, odd_rows, no_docs):
    assert found(odd_docs) == classes(odd_rows)
    assert found(no_docs) == []


@pytest.mark.parametrize("part", [1, 3])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, part):
    """Chains, stars and unlike neighbours; keys met in several parts."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(part)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.choice([1, 2, 4, 5, 6])):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    pairs = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    star, more = simhash.links(spark.createDataFrame([(signed[f],) for f in fps], "fp long"))
    got = {(r.a, r.b) for r in star.union(more).collect()}
    assert got <= {p for a, b in pairs for p in ((signed[a], signed[b]), (signed[b], signed[a]))}

    def parts(edges, nodes):
        root = {n: n for n in nodes}

        def top(n):
            while root[n] != n:
                n = root[n]
            return n
        for a, b in edges:
            root[top(a)] = top(b)
        return sorted(sorted(n for n in nodes if top(n) == t) for t in nodes if top(t) == t)
    assert parts(got, signed.values()) == parts([(signed[a], signed[b]) for a, b in pairs], signed.values())


def test_masks_share_a_choice_of_blocks():
    masks = simhash.block_masks(7, 4)
    assert len(masks) == 35
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any((x ^ y) & m == 0 for m in (m % (1 << 64) for m in masks))
    with pytest.raises(ValueError):
        simhash.links(None, distance=4, blocks=4)


def test_several_texts_under_one_id(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(4, a), (4, b), (9, a), (10, b), (11, b.upper()), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == classes(rows)
    assert {c for d, _, c in found(docs) if d != 12} == {4}
