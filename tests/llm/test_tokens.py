"""Packing (op3), SentencePiece (op5), record files (op6), token counts (op10)."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillroll.llm import packing, piece_bpe, records, token_counts, word_bpe
from tillroll.llm.common import tokenizer_path

WORD, PIECE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def piece_library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def odd_texts(n, seed):
    rnd = random.Random(seed)
    bits = list("ab S'tslld’ 09_-<|>\x00\x1c\x85\xa0 　éÉéſŉİıΣςσßẞ½²①日本्あ‍😀\t\n\r\x0b\x0c▁.,") + [
        "<|endoftext|>", "<s>", "the ", "ing", "    ", "'S", "aaaa", "..", ",."]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_word_ids_are_the_librarys(word_library, small_docs):
    vocab = word_bpe.load(WORD)
    for t in odd_texts(4000, 1) + [t for _, t in small_docs]:
        assert np.frombuffer(vocab.ids(t), "<u4").tolist() == word_library.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(word_bpe, "GENERATION", 50)
    vocab = word_bpe.WordBpe(WORD)
    texts = [f"word{i} and word{i % 7}" for i in range(300)]
    assert [vocab.ids(t) for t in texts] == [word_bpe.load(WORD).ids(t) for t in texts]
    assert len(vocab) <= 50 and len(vocab.old) <= 50


def test_piece_ids_are_the_librarys(piece_library, small_docs):
    model = piece_bpe.load(PIECE)
    texts = odd_texts(4000, 2) + [t for _, t in small_docs] + [" " * 700 + "a" * 900, "ab" * 3000, "日本" * 300, " " * 31 + "aaaaaaaa   "]
    for t, raw in zip(texts, model.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == piece_library.encode(t), repr(t)
        assert model.decode([*ids, model.eos]) == piece_library.decode([*ids, model.eos]), repr(t)


def test_encode_and_decode_rows(spark, odd_docs, odd_rows, piece_library, no_docs):
    out = piece_bpe.encode(odd_docs, PIECE, outputs=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = []
    for d, t in odd_rows:
        ids = [*piece_library.encode(t or ""), piece_library.eos_id()]
        text = piece_library.decode(ids)
        want.append((d, ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = piece_bpe.decode(out, PIECE).collect()
    assert sorted((r["text"] for r in back)) == sorted(w[4] for w in want)
    assert piece_bpe.encode(no_docs, PIECE).collect() == []


def check_packing(rows, texts, library, max_len):
    want = []
    for d, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, a // max_len, a, len(ids[a:a + max_len]), zlib.crc32(ids[a:a + max_len].tobytes())) for a in range(0, len(ids), max_len)]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    return len(by), sum(w[3] for w in want)


def test_packing_of_odd_rows(odd_docs, odd_rows, word_library, no_docs):
    check_packing(packing.pack(odd_docs, WORD).collect(), odd_rows, word_library, 4096)
    assert packing.pack(no_docs, WORD).collect() == []


def test_packing_is_tight(spark, small_docs, word_library):
    df = spark.createDataFrame(small_docs, "doc_id long, text string").repartition(6)
    rows = packing.pack(df, WORD, max_len=512, with_ids=True)
    made, tokens = check_packing(rows.drop("ids").collect(), small_docs, word_library, 512)
    assert made <= 1.02 * tokens / 512 + 1
    whole = packing.sequences(rows).collect()
    assert len(whole) == made and all(len(s["ids"]) == s["n_tokens"] <= 512 for s in whole)


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_open_bins(limit):
    rnd, bins, used = random.Random(limit), packing.OpenBins(100, limit), defaultdict(int)
    for _ in range(2000):
        size = rnd.randint(1, 100)
        number, at = bins.put(size)
        assert at == used[number]
        used[number] += size
        assert used[number] <= 100 and bins.open <= limit
    assert bins.still_open() == {n for n in used if used[n] < 100} & bins.still_open()


def check_records(rows, texts, library):
    want, start = [], 0
    for d, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r)[:4] for r in rows), key=str) == sorted(want, key=str)


def test_records_round_trip(spark, odd_docs, odd_rows, word_library, tmp_path, no_docs):
    folder = str(tmp_path / "rec")
    manifest = records.write_records(odd_docs, folder, WORD)
    check_records(records.read_records(spark, folder, manifest).collect(), odd_rows, word_library)
    shuffled = records.read_records(spark, folder, manifest, seed=3)
    check_records(shuffled.drop("ids").collect(), odd_rows, word_library)
    ids = {r["doc_id"]: r["ids"] for r in shuffled.collect()}
    assert ids[5] == word_library.encode(dict(odd_rows)[5], add_special_tokens=False).ids + [2]
    empty = records.write_records(no_docs, str(tmp_path / "none"), WORD)
    assert records.read_records(spark, str(tmp_path / "none"), empty).collect() == []


def test_damaged_records_are_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words here"), (2, "more of them")], "doc_id long, text string").coalesce(1)
    manifest = records.write_records(df, str(tmp_path), WORD)
    name = next(n for n in sorted(os.listdir(tmp_path)) if n.endswith(".rec"))
    blob = bytearray((tmp_path / name).read_bytes())
    blob[20] ^= 1
    (tmp_path / name).write_bytes(blob)
    with pytest.raises(Exception, match="damaged record"):
        records.read_records(spark, str(tmp_path), manifest).collect()


def test_wide_ids_take_four_bytes():
    ids = np.array([1, 70_000, 5], "<u4")
    doc, back = records.parse(records.payload(None, ids.tobytes()))
    assert doc is None and back.tolist() == ids.tolist()


def test_token_counts(spark, odd_docs, odd_rows, piece_library, tmp_path, no_docs):
    cache = str(tmp_path / "cache")
    want = sorted(((d, len((t or "").encode()), n := len(piece_library.encode(t or "")), n > 4096) for d, t in odd_rows), key=str)
    assert sorted((tuple(r) for r in token_counts.token_counts(odd_docs, PIECE, cache).collect()), key=str) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in odd_rows})
    # the second run finds everything; new texts are appended
    assert sorted((tuple(r) for r in token_counts.token_counts(odd_docs, PIECE, cache).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == stored.count()
    more = odd_docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" more")).alias("text"))
    token_counts.token_counts(more, PIECE, cache).collect()
    assert spark.read.parquet(cache).count() == 2 * stored.count()
    assert token_counts.token_counts(no_docs, PIECE, cache).collect() == []


def test_counts_of_words_add_up(piece_library, small_docs):
    words = token_counts.load(PIECE)
    assert words.by_words
    for t in odd_texts(3000, 4) + [t for _, t in small_docs]:
        assert words.count(t) == len(piece_library.encode(t)), repr(t)


def test_remembered_words_stay_few(monkeypatch):
    """A worker keeps its words from task to task, beside the JVM's heap."""
    monkeypatch.setattr(word_bpe.WordBpe, "_word", lambda self, word: b"1234")
    vocab = word_bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    for i in range(500_000):
        vocab[str(i)]
    assert len(vocab) + len(vocab.old) <= 300_000
