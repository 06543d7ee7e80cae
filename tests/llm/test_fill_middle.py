import hashlib
import random
import re

import pytest
import zstandard

from tillroll.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_way(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) straight from the rules."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexes = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def filled(docs, frame_bytes):
    stored = fm.store(docs, frame_bytes=frame_bytes)
    return fm.fill_middle(fm.plan(stored), tuple(fm.OUTPUTS), frame_bytes).collect()


@pytest.mark.parametrize("frame_bytes", [7, 300, fm.FRAME_BYTES])
def test_matches_the_rules_at_any_frame_size(spark, small_docs, odd_docs, odd_rows, frame_bytes):
    docs = spark.createDataFrame(small_docs[:120], "doc_id long, text string")
    for got, want in ((filled(docs, frame_bytes), small_docs[:120]), (filled(odd_docs, frame_bytes), odd_rows)):
        expected = []
        for doc_id, text in want:
            n, form, p, m, out = plain_way(doc_id, text)
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in (out, text or "")]
            expected.append((doc_id, n, form, p, m, out, text or "", *sha))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert {r.form for r in filled(docs, frame_bytes)} == {"plain", "psm", "spm"}


def test_marks_in_texts_and_halves_of_marks(spark):
    rows = [(i, t) for i in range(40) for t in ("a <P> b", "x<S>y z", "<M>", "< P> <", "a <P", "S> b <", "<P <S <M b", "><P<S<M")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in filled(docs, 3):
        assert any(m in r.restored for m in ("<P>", "<S>", "<M>")) <= (r.form == "plain")
    assert sorted((r.doc_id, r.restored) for r in filled(docs, 3)) == sorted(rows)


def test_frames_seek_by_counts():
    rng = random.Random(5)
    pack = zstandard.ZstdCompressor(level=1)
    for _ in range(150):
        text = "".join(rng.choice(["a", "é", "日本", " ", "\n", "  ", "word", "𝄞"]) for _ in range(rng.randrange(60)))
        data = text.encode()
        cut = rng.randrange(len(data) + 1)
        f = fm.Frames.of([data[:cut], data[cut:]], rng.choice([4, 5, 9, 64]), pack)
        units = UNIT.findall(text)
        assert f.units[-1] == len(units) and f.chars[-1] == len(text) and f.text() == text
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert f.place(k) == (len(head.encode()), len(head))
        a, e = sorted((rng.randrange(len(data) + 1), rng.randrange(len(data) + 1)))
        assert b"".join(f.stream(a, e)) == data[a:e]


def test_only_frames_of_a_cut_are_opened():
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    f = fm.Frames.of([text], 256, zstandard.ZstdCompressor(level=1))
    opened = []
    inner = f.frame
    f.frame = lambda j: opened.append(j) or inner(j)
    f.place(2500)
    assert len(f.blobs) > 80 and len(set(opened)) == 1


def test_empty_table_and_unknown_output(spark, no_docs):
    assert filled(no_docs, 64) == []
    with pytest.raises(ValueError):
        fm.fill_middle(fm.plan(fm.store(no_docs)), ("texts",))
