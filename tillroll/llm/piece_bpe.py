"""Encoding and decoding with a SentencePiece BPE model in vectorised merge
rounds.

The words of a batch (a run of blanks with what follows it; no piece of the
vocabulary goes on past a blank) are laid out as one flat array of symbols
with a segment per distinct word. A round looks up the rank of every
adjacent pair, takes the minimum per segment, merges all leftmost,
non-overlapping pairs of that rank at once, and compacts the arrays; words
without a pair left leave the arrays. The library merges one pair at a time,
best score first, leftmost among equals. Merging several at once is the same
unless a merge makes a pair of better rank; a word in which that happens
after more than one merge, and any very long word, is redone one pair at a
time with a heap. Characters outside the vocabulary become byte pieces.

Scale: no shuffle; a task holds one slice of a batch and a bounded number of
remembered words. Texts of any length are taken whole.

Defined results: NULL text is empty and gives the end id alone; NULL ids and
repeated rows are kept; an empty table gives no rows; other input columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import renamed, with_package

NONE = np.int32(2 ** 31 - 1)  # rank of a pair that is no piece
LONG_WORD = 400               # symbols from which a word takes the heap
SLICE = 1_500_000             # characters encoded together
REMEMBERED = 300_000          # words in each of two generations
_WORD = re.compile("▁+[^▁]*")


class PieceModel:
    """Vocabulary of a SentencePiece BPE model: pair ranks in an open hash table."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.size, self.eos, self.unk = n, sp.eos_id(), sp.unk_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        pieces = {sp.id_to_piece(i): i for i in range(n) if not special[i] and not sp.is_unused(i)}
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on past a blank: words cannot be encoded apart")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        _, order = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)  # best score: rank 0
        self.tied = np.bincount(order[list(pieces.values())], minlength=n) > 1
        # symbols: piece ids; characters that are no piece get n + code point
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        left, right, rank, made = [], [], [], []
        known = lambda s: pieces.get(s, n + ord(s) if len(s) == 1 else -1)
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = known(p[:k]), known(p[k:])
                if a >= 0 and b >= 0:
                    left.append(a), right.append(b), rank.append(order[i]), made.append(i)
        self._hash(np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(rank, np.int32), np.array(made, np.int32))
        self.pairs = {(a, b): (int(r), i) for a, b, r, i in zip(left, right, rank, made, strict=True)}
        # decoding: bytes of each id
        self.out = [b"" if sp.is_control(i) else bytes([self.byte_ids.index(i)]) if sp.is_byte(i)
                    else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.blank_first = [not special[i] and sp.id_to_piece(i).startswith("▁") for i in range(n)]
        self.digits = [str(i) for i in range(n)]
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # pair table -------------------------------------------------------
    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.made = np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        todo, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)  # one key a slot
            won = np.flatnonzero(free)[one]
            self.keys[at[won]], self.rank[at[won]], self.made[at[won]] = keys[todo[won]], rank[todo[won]], made[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & (size - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; NONE where it is no piece."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        rank, made = self.rank[at], self.made[at]
        wrong = np.flatnonzero((found != keys) & (found >= 0))
        rank[found != keys] = NONE
        for _ in range(self.probes):
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            found = self.keys[at[wrong]]
            same = found == keys[wrong]
            rank[wrong[same]], made[wrong[same]] = self.rank[at[wrong[same]]], self.made[at[wrong[same]]]
            wrong = wrong[~same & (found >= 0)]
        return rank, made

    # encoding ---------------------------------------------------------
    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """Merges in the library's order: best rank first, then leftmost."""
        sym, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def push(i, j):
            if i >= 0 and j >= 0 and (m := self.pairs.get((sym[i], sym[j]))):
                heapq.heappush(heap, (m[0], i, j, sym[i], sym[j], m[1]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return [s for s in sym if s >= 0]

    def _rounds(self, words: list[str]) -> list[bytes]:
        """Ids of each word after all merges, 4 bytes each."""
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        start = np.concatenate(([0], np.cumsum(lengths)))
        apart = np.flatnonzero(lengths > LONG_WORD)
        for w in apart:
            out[w] = self._ids(self._one_by_one(symbols[start[w]:start[w + 1]].tolist()))
        number = np.flatnonzero((lengths <= LONG_WORD) & (lengths > 0))  # words in the arrays
        keep = np.repeat((lengths <= LONG_WORD), lengths)
        sym, lengths = symbols[keep], lengths[number]
        redo: list[int] = []
        rank = np.full(len(sym), NONE, np.int32)
        made = np.empty(len(sym), np.int32)
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        inner = np.ones(len(sym), bool)  # not the last symbol of its word
        inner[first + lengths - 1] = False
        at = np.flatnonzero(inner)
        if len(at):
            rank[at], made[at] = self.lookup(sym[at], sym[at + 1])
        while len(number):
            best = np.minimum.reduceat(rank, first)
            done = best == NONE
            if done.any():
                live = ~done
                mask = np.repeat(live, lengths)
                ended, raw, ends = sym[~mask], sym[~mask].tobytes(), np.cumsum(lengths[done])
                odd = np.maximum.reduceat(ended, ends - lengths[done]) >= self.size
                a = 0
                for w, e in zip(number[done].tolist(), (ends * 4).tolist(), strict=True):
                    out[w] = raw[a:e]
                    a = e
                for w in number[done][odd].tolist():
                    out[w] = self._ids(np.frombuffer(out[w], "<i4").tolist())
                sym, rank, made = sym[mask], rank[mask], made[mask]
                number, lengths, best = number[live], lengths[live], best[live]
                if not len(number):
                    break
                first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            word = np.repeat(np.arange(len(number)), lengths)
            hit = rank == best[word]
            index = np.flatnonzero(hit)
            fresh = np.ones(len(index), bool)  # starts a run of overlapping pairs
            fresh[1:] = index[1:] != index[:-1] + 1
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(index)), 0))
            take = index[(np.arange(len(index)) - run_start) % 2 == 0]
            merges = np.bincount(word[take], minlength=len(number))
            sym[take] = made[take]
            gone = np.zeros(len(sym), bool)
            gone[take + 1] = True
            place = np.cumsum(~gone) - 1
            rank[take] = NONE
            # a merged symbol stands last in its word when the symbol it swallowed did
            lengths = lengths - merges
            sym, rank, made, word = sym[~gone], rank[~gone], made[~gone], word[~gone]
            first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            left = place[take]
            mark = np.zeros(len(sym), bool)
            mark[left] = True
            mark[np.maximum(left - 1, 0)] = True
            touched = np.flatnonzero(mark)
            has_next = touched + 1 < len(sym)
            same = np.zeros(len(touched), bool)
            same[has_next] = word[touched[has_next]] == word[touched[has_next] + 1]
            rank[touched] = NONE
            pair = touched[same]
            if len(pair):
                rank[pair], made[pair] = self.lookup(sym[pair], sym[pair + 1])
                # a better pair than this round's, after several merges at once: order matters
                risky = pair[(rank[pair] < best[word[pair]]) & (merges[word[pair]] > 1)]
                redo += number[np.unique(word[risky])].tolist()
            # pieces of equal score: strictly from left to right
            redo += number[(merges > 1) & self.tied[best]].tolist()
        for w in dict.fromkeys(redo):
            out[w] = self._ids(self._one_by_one(symbols[start[w]:start[w + 1]].tolist()))
        return out

    def _ids(self, symbols: list[int]) -> bytes:
        """Characters outside the vocabulary become the ids of their bytes."""
        ids = []
        for s in symbols:
            ids += [s] if s < self.size else [self.byte_ids[b] for b in chr(s - self.size).encode()]
        return np.array(ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, 4 bytes each, without begin or end."""
        segments = [_WORD.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.old, self.words = self.words, {}
        new = []
        for w in set().union(*segments):
            if w not in self.words:
                if w in self.old:
                    self.words[w] = self.old[w]
                else:
                    new.append(w)
        self.words.update(zip(new, self._rounds(new), strict=True))
        get = self.words.__getitem__
        return [b"".join(map(get, s)) for s in segments]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, byte pieces join to characters
        (U+FFFD where they make none), the blank before the first piece goes."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if self.out[i]), None)
        return text[1:] if first is not None and self.blank_first[first] else text


_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def _slices(batch: pa.RecordBatch):
    """(ids, texts) of at most SLICE characters together, or one text."""
    docs, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        t = text.as_py() or ""
        if texts and size + len(t) > SLICE:
            yield docs, texts
            docs, texts, size = [], [], 0
        docs.append(doc)
        texts.append(t)
        size += len(t)
    if texts:
        yield docs, texts


COLUMNS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
_ARROW = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(),
          "decoded_sha256": pa.string()}


def _encode(path: str, outputs: list[str]):
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        model = load(path)
        for b in batches:
            for docs, texts in _slices(b):
                got = {k: [] for k in outputs}
                for raw in model.encode(texts):
                    ids = [*np.frombuffer(raw, "<i4").tolist(), model.eos]
                    back = model.decode(ids) if "decoded" in got or "decoded_sha256" in got else None
                    for k in outputs:
                        got[k].append(ids if k == "ids" else len(ids) if k == "n_tokens" else back if k == "decoded"
                                      else sha(" ".join(map(model.digits.__getitem__, ids))) if k == "ids_sha256" else sha(back))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *[pa.array(got[k], _ARROW[k]) for k in outputs]],
                                                 ["doc_id", *outputs])
    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
           outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """Encode whole texts with an end id and decode them again. ``outputs``:
    any of ids, n_tokens, ids_sha256 (of the decimal ids joined by a blank),
    decoded, decoded_sha256."""
    schema = ", ".join(["doc_id long", *[f"{k} {COLUMNS[k]}" for k in outputs]])
    source = with_package(renamed(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(_encode(model, list(outputs)), schema)


def _decode(path: str):
    def run(batches):
        model = load(path)
        for b in batches:
            texts = [None if v is None else model.decode(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id arrays; NULL stays NULL."""
    source = with_package(renamed(rows, doc_id=id_col, ids=ids_col)).select(F.col("doc_id").cast("long"), "ids")
    return source.mapInArrow(_decode(model), "doc_id long, text string")
