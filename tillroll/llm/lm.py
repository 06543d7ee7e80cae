"""Hierarchical Pitman-Yor language model over words, and perplexity scores.

Tokens are words and one end per text. A token's context is the word before
it, whatever that is, and one context of its own for a text's first token.
Every context is a Pitman-Yor restaurant; all share one parent restaurant,
whose base is uniform over the V training types and one unknown type:

    P(w | x) = (c_xw - d1 t_xw + (theta + d1 t_x) P0(w)) / (theta + c_x)
    P0(w)    = (c0_w - d0 t0_w + (theta + d0 t0) / (V + 1)) / (theta + c0)

c: customers, t: tables; a table of a context is a customer of the parent.
A word before it that training has not seen is an empty restaurant: P0.
Seatings are sampled by Gibbs sweeps: given P0 and the restaurants' totals a
cell's tables have probability proportional to S_d(c, t) (A P0(w))^t, with
generalised Stirling numbers S and A = theta + d t_x; counts over
``EXACT`` are seated customer by customer, later ones in blocks. After the
burn-in the predictive probabilities of ``samples`` sweeps are averaged;
their log10 is summed over the text. P0 and the totals of the frequent
contexts come from the round of sweeps before, over the whole corpus; the
totals of all others follow each sweep.

Scale: cells (context, word) lie in parts by their context's hash, as many
as the corpus needs, and so do their tokens: a text's tokens go there once,
as packed blocks, and come back as one sum per text and part. A part adds up
its tables per word and sends these to the parent's parts, by the word's
hash, which answer with the parent's customers and tables. The cells of
frequent contexts (words of at least 1/``share`` of the training tokens, and
the texts' beginnings), which would make hot parts, are dealt by the hash of
context and word; only their totals, at most share + 1 numbers, go over the
driver, as do the cells of two frequent words, at most share x (share + 1),
which are counted by Spark. A part holds about ``PART_TOKENS`` tokens.

Defined results: NULL text is empty and has its end only; NULL ids are held
out (never learned) with held_out NULL; repeated rows count and are scored
each; without training tokens every probability is the uniform base; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import shingles
from tillroll.llm.common import dropped, fresh_folder, remainder, renamed, with_package, written

END = int(shingles.mix(np.array([0xE0D], np.uint64))[0])
FIRST = shingles.mix(np.array([0xF125], np.uint64))[0]  # the context of a text's first token
PART_TOKENS = 3_000_000
EXACT = 48
THETA = 1.0
ROWS = 4096  # texts of a block: their places fit 2 bytes


def _tokens(texts: pa.Array):
    """Per slice: first row, tokens with an end per text, tokens per text."""
    for first, hashes, counts in shingles.words(texts):
        ends = np.cumsum(counts)
        tokens = np.insert(hashes, ends, np.uint64(END))
        yield first, tokens, counts + 1


def _batches(batches):
    """Slices of at most ROWS rows."""
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            yield b.slice(a, ROWS)


def _word_counts(batches):
    for b in batches:
        parts = [t for _, t, _ in _tokens(b.column(0))]
        if parts:
            w, c = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])


class Frequent:
    """Frequent words and their places; the frequent contexts are the texts'
    beginnings (place 0) and these words (from 1)."""

    def __init__(self, hashes: list[int]):
        self.words = np.sort(np.array(hashes, np.int64).view(np.uint64))

    @property
    def contexts(self) -> int:
        return len(self.words) + 1

    def place(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token among the frequent words, or -1."""
        if not len(self.words):
            return np.full(len(tokens), -1, np.int32)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1).astype(np.int32)
        return np.where(self.words[at] == tokens, at, np.int32(-1))

    def context(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each context among the frequent ones, or -1."""
        place = self.place(hashes)
        return np.where(hashes == FIRST, np.int32(0), np.where(place >= 0, place + np.int32(1), np.int32(-1)))

    def encode(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, its place, place) of every token."""
        place = self.place(tokens)
        context, at = np.empty(len(tokens), np.uint64), np.empty(len(tokens), np.int32)
        context[1:], at[1:] = tokens[:-1], np.where(place[:-1] >= 0, place[:-1] + 1, -1)
        first = np.cumsum(counts) - counts
        context[first], at[first] = FIRST, 0
        return context, at, place


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays by byte planes, compressed."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    if not n:
        return [np.zeros(0, k) for k in kinds]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at:at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


DOCS = "rid long, doc_id long, held_out boolean, n_tokens long, cells binary, code array<int>, cnt array<long>"
_DOCS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                   ("cells", pa.binary()), ("code", pa.list_(pa.int32())), ("cnt", pa.list_(pa.int64()))])


def _numbered(batches):
    """(number of the first row, batch): rows are numbered by task and place,
    the same in every pass over the same files."""
    from pyspark import TaskContext
    at = TaskContext.get().partitionId() << 36
    for b in _batches(batches):
        yield at, b
        at += b.num_rows


def _documents(frequent: Frequent):
    """A row per text with its frequent cells; counts of those in training."""
    n_words = max(1, len(frequent.words))

    def run(batches):
        for at, b in _numbered(batches):
            ids, held = b.column(0), b.column(2).to_pylist()
            codes, sizes, lengths = [], [], []
            for first, tokens, counts in _tokens(b.column(1)):
                _, context, place = frequent.encode(tokens, counts)
                hit = (place >= 0) & (context >= 0)
                codes.append((context[hit] * n_words + place[hit]).astype(np.int32))
                row = np.repeat(np.arange(len(counts)), counts)
                sizes.append(np.bincount(row[hit], minlength=len(counts)))
                lengths.append(counts)
            codes, sizes, lengths = np.concatenate(codes), np.concatenate(sizes), np.concatenate(lengths)
            ends = np.cumsum(sizes)
            learned = np.repeat(np.array([h is False for h in held]), sizes)
            code, cnt = np.unique(codes[learned], return_counts=True)
            n = b.num_rows
            lists = [code.astype(np.int32)] + [None] * (n - 1), [cnt.astype(np.int64)] + [None] * (n - 1)
            blobs = [codes[e - k:e].tobytes() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + n)), ids, pa.array(held, pa.bool_()), pa.array(lengths.astype(np.int64)),
                 pa.array(blobs, pa.binary()), pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.int64()))], schema=_DOCS)
    return run


BLOCK = "part int, base long, n long, n_learned long, n_contexts long, n_words long, contexts binary, words binary, blob binary"
_BLOCK = pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in ("base", "n", "n_learned", "n_contexts", "n_words")),
                    *((c, pa.binary()) for c in ("contexts", "words", "blob"))])


def _ascending(hashes: np.ndarray) -> bytes:
    return _pack(np.diff(hashes, prepend=np.uint64(0)))


def _part(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _events(frequent: Frequent, bits: int):
    """Tokens but those of two frequent words, as a packed block per part:
    its contexts and words, and per token context, word, row."""
    def run(batches):
        for at, b in _numbered(batches):
            held = np.array([h is False for h in b.column(2).to_pylist()])
            words, contexts, rows, parts = [], [], [], []
            for first, tokens, counts in _tokens(b.column(1)):
                context, often, place = frequent.encode(tokens, counts)
                rare = (place < 0) | (often < 0)
                w, x = tokens[rare], context[rare]
                words.append(w)
                contexts.append(x)
                rows.append((first + np.repeat(np.arange(len(counts)), counts)[rare]).astype(np.uint16))
                parts.append(_part(np.where(often[rare] >= 0, shingles.mix(x * np.uint64(shingles.BASE) + w), x), bits))
            if not words:
                continue
            w, x, r, part = (np.concatenate(v) for v in (words, contexts, rows, parts))
            order = np.argsort(part, kind="stable")
            w, x, r = w[order], x[order], r[order]
            cut = np.searchsorted(part[order], np.arange((1 << bits) + 1)).tolist()
            out = []
            for k, (a, e) in enumerate(zip(cut, cut[1:], strict=False)):
                if e > a:
                    (xs, xi), (ws, wi) = np.unique(x[a:e], return_inverse=True), np.unique(w[a:e], return_inverse=True)
                    # learned rows first, so that a flag needs no room
                    s = np.lexsort((xi, ~held[r[a:e]]))
                    out.append({"part": k, "base": at, "n": e - a, "n_learned": int(held[r[a:e]].sum()), "n_contexts": len(xs), "n_words": len(ws),
                                "contexts": _ascending(xs), "words": _ascending(ws),
                                "blob": _pack(np.diff(xi[s].astype(np.int32), prepend=np.int32(0)), wi[s].astype(np.uint32), r[a:e][s])})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)
    return run


PART = "part int, n_words long, n_cells long, n_events long, words binary, cells binary, events binary"


def _gather(frequent: Frequent):
    """All blocks of a part -> its words, its cells (context, word, training
    count) and its events (text, cell). Contexts are numbered, the frequent
    ones by place, the others, which are whole here, behind them."""
    def run(key, rows):
        words, contexts, docs, learned = [], [], [], []
        for r in rows.select(_BLOCK.names[1:]).to_pylist():
            xi, wi, place = _unpack(r["blob"], r["n"], "<i4", "<u4", "<u2")
            contexts.append(np.cumsum(_unpack(r["contexts"], r["n_contexts"], "<u8")[0])[np.cumsum(xi, dtype=np.int32)])
            words.append(np.cumsum(_unpack(r["words"], r["n_words"], "<u8")[0])[wi])
            docs.append(place.astype(np.int64) + r["base"])
            learned.append(np.arange(r["n"]) < r["n_learned"])
        words, word = np.unique(np.concatenate(words), return_inverse=True)
        contexts, context = np.unique(np.concatenate(contexts), return_inverse=True)
        doc, learned = np.concatenate(docs), np.concatenate(learned)
        del docs
        code, cell = np.unique(context * len(words) + word, return_inverse=True)
        del context, word
        count = np.bincount(cell[learned], minlength=len(code)).astype(np.uint32)
        place = frequent.context(contexts)
        place = np.where(place >= 0, place, frequent.contexts - 1 + np.cumsum(place < 0)).astype(np.int32)
        context, word = np.divmod(code, len(words))
        by_doc = np.argsort(doc, kind="stable")  # a text's events side by side
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n_words": pa.array([len(words)]),
                         "n_cells": pa.array([len(count)]), "n_events": pa.array([len(doc)]), "words": pa.array([_ascending(words)], pa.binary()),
                         "cells": pa.array([_pack(np.diff(place[context], prepend=np.int32(0)), word.astype(np.uint32), count)], pa.binary()),
                         "events": pa.array([_pack(np.diff(doc[by_doc], prepend=np.int64(0)), cell[by_doc].astype(np.uint32))], pa.binary())})
    return run


def _bucketed(df: DataFrame, bits: int) -> DataFrame:
    """``df`` written by part, so that later joins by part leave it where it is."""
    spark, name = df.sparkSession, f"lm_parts_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(1 << min(bits, 13), "part").option("path", fresh_folder(spark, "lm-parts")).saveAsTable(name))
    back = spark.table(name)
    back.schema  # noqa: B018 - resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return back


# seating

@functools.lru_cache(8)
def _stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 2)
        stay = np.where(c - t * d > 0, np.log(np.maximum(c - t * d, 1e-300)), -np.inf) + s[c, 1:c + 2]
        s[c + 1, 1:c + 2] = np.logaddexp(stay, s[c, 0:c + 1])
    return s


def seat(count: np.ndarray, mass: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of each cell: ``count`` customers of one dish, ``mass`` the
    weight of a new table."""
    tables = np.minimum(count, 1).astype(np.int64)
    log_s = _stirling(d)
    mass = np.maximum(mass, 1e-300)
    for c in np.unique(count[(count > 1) & (count <= EXACT)]).tolist():
        at = np.flatnonzero(count == c)
        for a in range(0, len(at), 200_000):
            i = at[a:a + 200_000]
            t = np.arange(1, c + 1)
            logp = log_s[c, 1:c + 1] + np.log(mass[i])[:, None] * t
            p = np.exp(logp - logp.max(axis=1, keepdims=True))
            total = np.cumsum(p, axis=1)
            tables[i] = 1 + (total < (rng.random(len(i)) * total[:, -1])[:, None]).sum(axis=1)
    i = np.flatnonzero(count > EXACT)
    if len(i):
        seated, t, m, c = np.ones(len(i)), np.ones(len(i)), mass[i], count[i].astype(float)
        while (todo := seated < c).any():
            step = np.minimum(np.where(seated < EXACT, 1, np.ceil(seated / 8)), c - seated)
            p = m / (m + np.maximum(seated - d * t, 1e-9))
            t = np.where(todo, t + rng.binomial(step.astype(np.int64), np.clip(p, 0, 1)), t)
            seated = np.minimum(seated + step, c)
        tables[i] = np.minimum(t, c).astype(np.int64)
    return tables


class Totals:
    """What restaurants know of each other: customers and tables per
    context, customers and tables of the parent, types, discounts."""

    def __init__(self, customers: np.ndarray, types: int, d1: float, d0: float):
        self.customers, self.types, self.d1, self.d0 = customers.astype(float), types, d1, d0
        self.tables = self.customers * 0.5
        self.root_customers, self.root_tables = self.tables.sum(), float(types)

    def unknown(self) -> float:
        return (THETA + self.d0 * self.root_tables) / (self.types + 1) / (THETA + self.root_customers)


def sweeps(word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, totals: Totals, n: int, seed: list[int], p0: np.ndarray | None = None):
    """``n`` Gibbs sweeps over the cells of some words; yields after each
    the tables of the cells, the words' parent tables and P0 of each word.
    Contexts behind those of ``totals`` are whole here and their tables are
    counted anew by each sweep. With ``p0`` the parent is seated elsewhere
    (parent tables None)."""
    rng = np.random.default_rng(seed)
    known = len(totals.tables)
    tables, fixed, root_tables = np.minimum(count, 1).astype(np.int64), p0 is not None, None
    if not fixed:
        root_customers = np.bincount(word, weights=tables, minlength=n_words)
        root_tables = np.minimum(root_customers, 1)
    base = (THETA + totals.d0 * totals.root_tables) / (totals.types + 1)
    for _ in range(n):
        if not fixed:
            p0 = (np.maximum(root_customers - totals.d0 * root_tables, 0) + base) / (THETA + totals.root_customers)
        mine = np.bincount(context, weights=tables, minlength=known)[known:]
        weight = (THETA + totals.d1 * np.concatenate((totals.tables, mine)))[context]
        tables = seat(count, weight * p0[word], totals.d1, rng)
        if not fixed:
            root_customers = np.bincount(word, weights=tables, minlength=n_words)
            root_tables = seat(root_customers.astype(np.int64), np.full(n_words, base), totals.d0, rng)
            p0 = (np.maximum(root_customers - totals.d0 * root_tables, 0) + base) / (THETA + totals.root_customers)
        yield tables, root_tables, p0


def _cells(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, word, count = _unpack(r["cells"], r["n_cells"], "<i4", "<u4", "<u4")
    return word.astype(np.int64), np.cumsum(step, dtype=np.int64), count.astype(np.int64)


def predictive(word, context, count, n_words, totals: Totals, burn: int, samples: int, seed: list[int], p0: np.ndarray) -> np.ndarray:
    """Probability of each cell's word in its context, averaged over samples."""
    mean, known = np.zeros(len(count)), len(totals.tables)
    room = (THETA + np.concatenate((totals.customers, np.bincount(context, weights=count, minlength=known)[known:])))[context]
    for k, (tables, _, _) in enumerate(sweeps(word, context, count, n_words, totals, burn + samples, seed, p0)):
        if k >= burn:
            mine = np.bincount(context, weights=tables, minlength=known)[known:]
            back = (THETA + totals.d1 * np.concatenate((totals.tables, mine)))[context]
            mean += (np.maximum(count - totals.d1 * tables, 0) + back * p0[word]) / room / samples
    return mean


# the parent: offers of tables per word go to its parts, answers with its customers and tables come back

DRIVER, INDEX = -2, -1  # "parts" of an exchange: the frequent cells, and what a part of the parent keeps for itself
MAIL = "at int, part int, n long, blob binary, index binary, parts array<int>, sizes array<long>, stats array<long>"
_MAIL = pa.schema([("at", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("blob", pa.binary()), ("index", pa.binary()),
                   ("parts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("stats", pa.list_(pa.int64()))])


def _offers(part: int, words: np.ndarray, bits: int, columns: list[np.ndarray], stats: np.ndarray | None, named: bool) -> list[dict]:
    """Rows to the parts of the parent: of each word, ascending by hash, the
    ``columns`` (and with ``named`` its hash). ``stats`` goes to one of them."""
    cut = np.searchsorted(_part(words, bits), np.arange((1 << bits) + 1)).tolist()
    out = []
    for k, (a, e) in enumerate(zip(cut, cut[1:], strict=False)):
        if e > a or k == part:
            names = [np.diff(words[a:e], prepend=np.uint64(0))] if named else []
            out.append({"at": k, "part": part, "n": e - a, "blob": _pack(*names, *(c[a:e].astype(np.uint64) for c in columns)),
                        "stats": stats.astype(np.int64).tolist() if k == part and stats is not None else None})
    return out


def _first_offers(bits: int, n_contexts: int):
    """Offers of the first seating, a table a cell, with the training counts;
    how many cells have one or two, and customers per frequent context."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                word, context, count = _cells(r)
                words = np.cumsum(_unpack(r["words"], r["n_words"], "<u8")[0])
                per = [np.bincount(word, weights=c, minlength=len(words)) for c in (np.minimum(count, 1), count)]
                stats = np.concatenate(([(count == 1).sum(), (count == 2).sum()], np.bincount(context, weights=count, minlength=n_contexts)[:n_contexts]))
                yield pa.RecordBatch.from_pylist(_offers(r["part"], words, bits, per, stats, True), schema=_MAIL)
    return run


def _added(rows: list[dict], marks: list[int]) -> list[int]:
    """A part's own marks, then the stats that came with its offers."""
    return [int(m) for m in marks] + [sum(v) for v in zip(*(r["stats"] for r in rows if r["stats"]), strict=True)]


def _answers(at: int, parts, sizes, index: np.ndarray, columns: list[np.ndarray]) -> list[dict]:
    ends = np.cumsum(sizes).tolist()
    return [{"at": at, "part": p, "n": n, "blob": _pack(*(c[index[e - n:e]].astype(np.uint64) for c in columns))}
            for p, n, e in zip(parts, sizes, ends, strict=True) if n]


def _meet(last: bool):
    """The first offers to one part of the parent -> what it keeps (training
    counts, the words of each offer) and answers: customers and tables; the
    last answers also tell the training counts."""
    def run(key, rows):
        at, rows = key[0].as_py(), sorted(rows.to_pylist(), key=lambda r: r["part"])
        got = [_unpack(r["blob"], r["n"], "<u8", "<u8", "<u8") for r in rows]
        words, index = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_inverse=True)
        customers, seen = (np.bincount(index, weights=np.concatenate([g[k] for g in got]), minlength=len(words)).astype(np.int64) for k in (1, 2))
        parts, sizes = [r["part"] for r in rows], [r["n"] for r in rows]
        tables = np.minimum(customers, 1)
        marks = [customers.sum(), tables.sum(), (seen == 1).sum(), (seen == 2).sum(), (seen > 0).sum()]
        kept = {"at": at, "part": INDEX, "n": len(words), "blob": _pack(seen.astype(np.uint64)),
                "index": _pack(np.diff(index.astype(np.int32), prepend=np.int32(0))), "parts": parts, "sizes": sizes, "stats": _added(rows, marks)}
        return pa.Table.from_pylist([kept, *_answers(at, parts, sizes, index, [customers, tables, *([seen] if last else [])])], schema=_MAIL)
    return run


def _reseat(totals, number: int, last: bool):
    """Later offers to one part of the parent -> its new seating."""
    def run(key, rows):
        at, rows = key[0].as_py(), rows.to_pylist()
        kept = next(r for r in rows if r["part"] == INDEX)
        offers = {r["part"]: r for r in rows if r["part"] != INDEX}
        index = np.cumsum(_unpack(kept["index"], sum(kept["sizes"]), "<i4")[0], dtype=np.int64)
        offered = np.concatenate([_unpack(offers[p]["blob"], n, "<u8")[0] if n else np.zeros(0, np.uint64)
                                  for p, n in zip(kept["parts"], kept["sizes"], strict=True)])
        customers = np.bincount(index, weights=offered, minlength=kept["n"]).astype(np.int64)
        base = (THETA + totals.value.d0 * totals.value.root_tables) / (totals.value.types + 1)
        tables = seat(customers, np.full(len(customers), base), totals.value.d0, np.random.default_rng([at, number, 3]))
        seen = [_unpack(kept["blob"], kept["n"], "<u8")[0]] if last else []
        sums = {"at": at, "part": INDEX, "n": 0, "stats": _added(list(offers.values()), [customers.sum(), tables.sum()])}
        return pa.Table.from_pylist([sums, *_answers(at, kept["parts"], kept["sizes"], index, [customers, tables, *seen])], schema=_MAIL)
    return run


def _heard(mail: list[dict], n_columns: int) -> list[np.ndarray]:
    """The answers to one part, in order of its words."""
    got = [_unpack(m["blob"], m["n"], *["<u8"] * n_columns) for m in sorted(mail, key=lambda m: m["at"])]
    return [np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(n_columns)]


def _p0(customers: np.ndarray, tables: np.ndarray, totals: Totals) -> np.ndarray:
    base = (THETA + totals.d0 * totals.root_tables) / (totals.types + 1)
    return (np.maximum(customers - totals.d0 * tables, 0) + base) / (THETA + totals.root_customers)


def _seat_part(totals, bits: int, n: int, number: int):
    """``n`` sweeps over the cells of a part -> offers of its tables, and the
    tables of the frequent contexts."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                word, context, count = _cells(r)
                words = np.cumsum(_unpack(r["words"], r["n_words"], "<u8")[0])
                p0 = _p0(*_heard(r["mail"], 2), totals.value)
                for tables, _, _ in sweeps(word, context, count, len(words), totals.value, n, [r["part"], number, 1], p0):
                    pass
                known = len(totals.value.tables)
                yield pa.RecordBatch.from_pylist(
                    _offers(r["part"], words, bits, [np.bincount(word, weights=tables, minlength=len(words))],
                            np.bincount(context, weights=tables, minlength=known)[:known], False), schema=_MAIL)
    return run


def _score_part(totals, n_train: int, burn: int, samples: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                word, context, count = _cells(r)
                customers, tables, seen = _heard(r["mail"], 3)
                p0 = _p0(customers, tables, totals.value)
                logp = np.log10(predictive(word, context, count, len(seen), totals.value, burn, samples, [r["part"], 2], p0))
                base = np.log10((seen + 0.1) / (n_train + 0.1 * (totals.value.types + 1)))
                step, cell = _unpack(r["events"], r["n_events"], "<i8", "<u4")
                doc = np.cumsum(step)
                start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                w, rid = word[cell], doc[start]
                sums = [np.add.reduceat(logp[cell], start), np.add.reduceat(base[w], start),
                        np.add.reduceat((seen[w] > 0).astype(np.uint32), start)]
                # the sums of a run of texts travel together
                run_of = rid // ROWS
                cut = np.concatenate((np.flatnonzero(np.concatenate(([True], run_of[1:] != run_of[:-1]))), [len(rid)]))
                out = [(int(run_of[a]), int(e - a), _pack((rid[a:e] % ROWS).astype(np.uint16), *[x[a:e] for x in sums]))
                       for a, e in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([o[2] for o in out], pa.binary())], ["run", "n", "blob"])
    return run


def _add_runs(key, rows):
    """The parts' sums of one run of ROWS texts, added up."""
    logp, base, known = np.zeros(ROWS), np.zeros(ROWS), np.zeros(ROWS, np.int64)
    for n, blob in zip(rows.column("n").to_pylist(), rows.column("blob"), strict=True):
        at, x, y, z = _unpack(blob.as_py(), n, "<u2", "<f8", "<f8", "<u4")
        logp[at] += x
        base[at] += y
        known[at] += z
    at = np.flatnonzero(logp)
    return pa.table({"rid": pa.array(key[0].as_py() * ROWS + at), "logp": pa.array(logp[at]), "base": pa.array(base[at]), "known": pa.array(known[at])})


def _score_frequent(tables, n_words: int):
    def run(batches):
        logp, base = tables.value
        for b in batches:
            sums, bases, known = [], [], []
            for blob in b.column("cells").to_pylist():
                codes = np.frombuffer(blob, np.int32)
                sums.append(float(logp[codes].sum()))
                bases.append(float(base[codes % n_words].sum()))
                known.append(len(codes))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens")]
                                             + [pa.array(sums, pa.float64()), pa.array(bases, pa.float64()), pa.array(known, pa.int64())],
                                             ["rid", "doc_id", "held_out", "n_tokens", "f_logp", "f_base", "f_known"])
    return run


def _discount(one: int, two: int) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, share: int = 400,
          burn: int = 2, samples: int = 3, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    source = with_package(renamed(docs, id=id_col, text=text_col)).select(
        F.col("id").cast("long"), "text", (remainder("id", folds) == 0).alias("held"))
    words = source.filter("NOT held").select("text").mapInArrow(_word_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    words = written(words, "lm-words")
    n_train = words.agg(F.sum("c")).first()[0] or 0
    frequent = Frequent([r["w"] for r in words.filter(F.col("c") * share >= F.lit(n_train)).select("w").collect()])  # at most ``share``
    n_words, n_contexts = max(1, len(frequent.words)), frequent.contexts
    bits = max(0, math.ceil(math.log2(max(1, n_train) / PART_TOKENS)))

    dropped(words)
    rows = written(source.mapInArrow(_documents(frequent), DOCS), "lm-documents")
    parts = _bucketed(source.mapInArrow(_events(frequent, bits), BLOCK).groupBy("part").applyInArrow(_gather(frequent), PART), bits)

    # training counts of the cells of two frequent words: at most share x (share + 1)
    known = (rows.filter("code IS NOT NULL").select(F.explode(F.arrays_zip("code", "cnt")).alias("z"))
             .groupBy(F.col("z.code").alias("code")).agg(F.sum("z.cnt").alias("c")).collect())
    f_count = np.zeros(n_contexts * n_words, np.int64)
    for r in known:
        f_count[r["code"]] = r["c"]
    f_context, f_word = np.divmod(np.arange(len(f_count)), n_words)
    per_word = lambda v: np.bincount(f_word, weights=v, minlength=n_words)[:len(frequent.words)]

    def offered(columns: list[np.ndarray], named: bool) -> DataFrame:
        mine = _offers(DRIVER, frequent.words, bits, columns, None, named)
        return spark.createDataFrame([tuple(r.get(c) for c in _MAIL.names) for r in mine], MAIL)

    def answered(mail: DataFrame) -> tuple[DataFrame, list[int], list[dict]]:
        """The answers, their stats added up, and those to the driver."""
        mail = written(mail, "lm-mail")
        sums = dict(mail.filter(F.col("part") == INDEX).select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col")).collect())
        return mail, [sums.get(k, 0) for k in range(max(sums, default=-1) + 1)], [r.asDict() for r in mail.filter(F.col("part") == DRIVER).collect()]

    def heard(mail: DataFrame, *columns: str) -> DataFrame:
        """The parts with the answers to them."""
        by_part = mail.filter("part >= 0").groupBy("part").agg(F.collect_list(F.struct("at", "n", "blob")).alias("mail"))
        return parts.select("part", *columns).join(by_part, "part")

    def p0_of(mine: list[dict], n_columns: int, totals: Totals) -> np.ndarray:
        return _p0(*_heard(mine, n_columns)[:2], totals) if mine else np.ones(n_words)

    first = parts.select("part", "n_words", "n_cells", "words", "cells").mapInArrow(_first_offers(bits, n_contexts), MAIL)
    mail, stats, mine = answered(first.unionByName(offered([per_word(np.minimum(f_count, 1)), per_word(f_count)], True)).groupBy("at").applyInArrow(_meet(not rounds), MAIL))
    index = mail.filter(F.col("part") == INDEX)
    root_customers, root_tables, once, twice, types, c_once, c_twice = (stats + [0] * 7)[:7]
    customers = np.bincount(f_context, weights=f_count, minlength=n_contexts) + (stats[7:] or np.zeros(n_contexts))
    totals = Totals(customers, types, _discount(c_once + int((f_count == 1).sum()), c_twice + int((f_count == 2).sum())), _discount(once, twice))
    totals.root_customers, totals.root_tables = float(root_customers), float(root_tables)
    for k in range(rounds):
        sent, p0, last = spark.sparkContext.broadcast(totals), p0_of(mine, 2, totals), k == rounds - 1
        for f_tables, _, _ in sweeps(f_word, f_context, f_count, n_words, totals, burn, [1 << 20, k, 1], p0):
            pass
        offers = heard(mail, "n_words", "n_cells", "words", "cells").mapInArrow(_seat_part(sent, bits, burn, k), MAIL)
        mail, stats, mine = answered(index.unionByName(offers).unionByName(offered([per_word(f_tables)], False))
                                     .groupBy("at").applyInArrow(_reseat(sent, k, last), MAIL))
        after = Totals(customers, types, totals.d1, totals.d0)
        after.tables = np.bincount(f_context, weights=f_tables, minlength=n_contexts) + (stats[2:] or np.zeros(n_contexts))
        after.root_customers, after.root_tables = (float(v) for v in (stats + [0, 0])[:2])
        totals = after
    sent = spark.sparkContext.broadcast(totals)
    f_seen = np.bincount(f_word, weights=f_count, minlength=n_words)
    if mine:
        f_seen = _heard(mine, 3)[2]
    f_tables = (np.log10(np.maximum(predictive(f_word, f_context, f_count, n_words, totals, burn, samples, [1 << 20, 2], p0_of(mine, 3, totals)), 1e-300)),
                np.log10((f_seen + 0.1) / (n_train + 0.1 * (types + 1))))
    of_frequent = rows.mapInArrow(_score_frequent(spark.sparkContext.broadcast(f_tables), n_words),
                                  "rid long, doc_id long, held_out boolean, n_tokens long, f_logp double, f_base double, f_known long")
    of_parts = (heard(mail, "n_cells", "n_events", "cells", "events").mapInArrow(_score_part(sent, n_train, burn, samples), "run long, n long, blob binary")
                .groupBy("run").applyInArrow(_add_runs, "rid long, logp double, base double, known long"))
    zero = F.lit(0.0)
    return of_frequent.join(of_parts, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("f_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("f_base") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("f_logp") + F.coalesce("logp", zero)).alias("score"))


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of the held-out and the learned texts."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
