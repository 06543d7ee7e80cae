"""Document fingerprints by a randomised edit embedding.

Every text takes the same random walk: at step j on character c the walk
emits c and then moves on one character if the shared random bit r(j, c) is
1, else it stays. Two texts a few edits apart fall back into step soon after
each edit, so edit distance becomes Hamming distance between the emitted
strings (about twice as long as the text). The fingerprint keeps the
emissions at shared sample positions: a position belongs to level l when its
hash is below ``SAMPLES`` / 2^l, and a text whose walk has at most 2^l steps
keeps those of level l, so between half of ``SAMPLES`` and all of them, over
its whole length; higher levels are subsets of lower ones, so texts of
different lengths compare at the higher level. An emission is one byte, a
hash of three characters, which makes chance agreement rare. Two walks that
an edit put out of step may stay so for long, if seldom; a fingerprint
therefore has ``WALKS`` independent walks, and the best pair counts.

``similar`` finds near documents from fingerprints: bands of sampled symbols
make buckets, and no place past a text's end takes part in one. Each row of a
bucket is first verified (by the sampled Hamming likeness) against the
bucket's first one, then, while its members are not all connected, those
of other classes against another leader, ``LEADERS`` times in all; where few
pairs are left (``PAIRS``) further leaders are left out. In buckets
that are open even then every two members of different classes are verified
too, in blocks of ``BLOCK`` rows that meet block by block. So any two near documents that share a bucket
are linked, directly or over other links, and ``classed`` derives a class id.

Scale: one range-partitioned shuffle of the texts in descending id order, in
as many ranges as shuffle partitions; the first document of each range also
goes to the range before it, so each document meets its successor in a
stream, a slice of texts in memory at a time. Walks
are vectorised over the texts of a slice, and an edited text's walks go on
where its own reached the edit. Only range bounds reach the driver. Bands travel as two
numbers each; fingerprints only join those that share a bucket. A bucket of n
unlike texts costs n^2 / 2 comparisons, dealt by block.

Defined results: NULL text is empty; an empty text's fingerprint has no
symbols, equal to another empty one (likeness 1) and unlike any other (0);
NULL ids come last, repeated ids in order of text; a table of one document
is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import partitions, renamed, with_package, written
from tillroll.llm.components import components

SAMPLES = 128
WALKS = 3
PERIOD, CLASSES = 8192, 64  # the shared random bits repeat after PERIOD steps; characters fall into CLASSES
SLICE = 3_000_000           # characters of a slice of the stream
CHUNK, FEW = 256, 40        # steps of a block of characters; so few walks go on one by one
BLOCK = 2048                # rows of a bucket that meet in one place
LEADERS = 3                 # rounds of leaders before the rest of a bucket meets
PAIRS = 64                  # others that a member of an open bucket meets on average without further rounds
AT_ONCE = 8192              # pairs of fingerprints compared together
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(WALKS)
def _stays(walk: int) -> np.ndarray:
    """For each class and step (mod PERIOD) how many steps a walk stays."""
    bits = np.random.default_rng(20_011 + walk).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1  # no endless stay
    at = np.where(bits == 1, np.arange(PERIOD), PERIOD)
    nearest = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    return (nearest - np.arange(PERIOD)).astype(np.uint8).ravel()


@functools.lru_cache(64)
def positions(level: int) -> np.ndarray:
    """Sampled steps of a level, ascending, all below 2^level."""
    found = []
    for a in range(0, 1 << level, 1 << 20):
        step = np.arange(a, min(a + (1 << 20), 1 << level), dtype=np.uint64)
        share = SAMPLES / 2 ** level
        found.append(step[_mix(step * MIX + np.uint64(1)) < np.uint64(int(share * 2 ** 64))] if share < 1 else step)
    return np.concatenate(found).astype(np.int64)


@functools.lru_cache(1)
def _advance() -> np.ndarray:
    """Steps from one character to the next, for walk, class and step."""
    return np.concatenate([1 + _stays(w).astype(np.int64) for w in range(WALKS)])


def _classes(flat: np.ndarray, walk: int) -> np.ndarray:
    return (_mix(flat * MIX + np.uint64(walk)) >> np.uint64(58)).astype(np.int32)


def _cells(flat: np.ndarray, walk: int) -> np.ndarray:
    """Row of ``_advance`` for each character."""
    return (_classes(flat, walk) + np.int32(walk * CLASSES)) * np.int32(PERIOD)


def _walks(flat: np.ndarray, start: np.ndarray, length: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each walk reaches each character [walk, place], and
    all steps of each walk [walk, text]; ``begin`` holds the first steps. All
    walks of all texts advance together, longest texts first, over blocks of
    characters laid out by step; the last few finish one by one."""
    n = len(start)
    cells = np.stack([_cells(flat, w) for w in range(WALKS)])
    steps = np.zeros(cells.shape, np.int64)
    order = np.argsort(-length, kind="stable")
    text, walk = np.repeat(order, WALKS), np.tile(np.arange(WALKS), n)
    at, size, j = walk * len(flat) + start[text], length[text], begin[walk, text].astype(np.int64)
    advance, mask = _advance(), PERIOD - 1
    cells, reached = cells.reshape(-1), steps.reshape(-1)
    active, i = int(np.searchsorted(-size, 0)), 0
    while active > FEW:
        width = int(min(CHUNK, size[active - 1] - i))
        places = at[:active] + (i + np.arange(width))[:, None]
        block = cells[places].astype(np.int64)
        seen = np.empty((width, active), np.int64)
        now, cell, more = j[:active], np.empty(active, np.int64), np.empty(active, np.int64)
        for k in range(width):
            seen[k] = now
            np.bitwise_and(now, mask, out=cell)
            np.bitwise_or(cell, block[k], out=cell)
            np.take(advance, cell, out=more, mode="clip")
            np.add(now, more, out=now)
        reached[places] = seen
        i += width
        active = int(np.searchsorted(-size, -i))
    table = advance.tolist() if active else []
    for r in range(active):
        now, a, e = int(j[r]), int(at[r]) + i, int(at[r] + size[r])
        out = []
        for c in cells[a:e].tolist():
            out.append(now)
            now += table[c | now & mask]
        reached[a:e] = out
        j[r] = now
    end = np.empty((WALKS, n), np.int64)
    end[walk, text] = j
    return steps, end


def _print(flat: np.ndarray, steps: list[np.ndarray], end: list[int]) -> str:
    """``level:symbols`` of each walk of a text, given its characters, the
    step that reaches each, and all steps."""
    out, n = [], len(flat)
    for reached, e in zip(steps, end, strict=True):
        level = max(0, (e - 1).bit_length())
        sampled = positions(level)
        at = np.searchsorted(reached, sampled[:np.searchsorted(sampled, e)], "right") - 1
        three = (flat[at] * np.uint64(0x100000001B3) + flat[np.minimum(at + 1, n - 1)] * np.uint64(0x10001) + flat[np.minimum(at + 2, n - 1)]) if n else flat[:0]
        out.append(f"{level}:{(_mix(three * MIX) >> np.uint64(56)).astype(np.uint8).tobytes().hex()}")
    return "-".join(out)


class Walked:
    """Walks over a list of texts, each from its own first steps (0)."""

    def __init__(self, texts: list[str], begin: np.ndarray | None = None):
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1].astype(np.int64)
        self.flat = np.concatenate(raw).astype(np.uint64) if raw else np.zeros(0, np.uint64)
        self.steps, self.end = _walks(self.flat, self.start, self.length, np.zeros((WALKS, len(texts)), np.int64) if begin is None else begin)

    def text(self, t: int) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
        a, e = int(self.start[t]), int(self.start[t] + self.length[t])
        return self.flat[a:e], [s[a:e] for s in self.steps], self.end[:, t].tolist()

    def state(self, t: int, n: int) -> np.ndarray:
        """The step of each walk at which it would read character n."""
        return self.end[:, t] if n == self.length[t] else self.steps[:, self.start[t] + n]


def fingerprint(texts: list[str]) -> list[str]:
    """``level:symbols`` of each walk, joined by ``-``, of whole texts; two
    hexadecimal digits a symbol."""
    walked = Walked(texts)
    return [_print(*walked.text(t)) for t in range(len(texts))]


def both_prints(texts: list[str]) -> tuple[list[str], list[str]]:
    """Fingerprints of all texts, and of all but the last as edited by the
    next one. An edited text begins as its own does, so its walks go on from
    there over the new third only."""
    own = Walked(texts)
    cut = [int(n - n // 3) for n in own.length[:-1]]
    begin = np.array([own.state(t, n) for t, n in enumerate(cut)], np.int64).reshape(len(cut), WALKS).T
    tails = Walked([f[:len(t) // 3] for t, f in zip(texts, texts[1:], strict=False)], begin)
    changed = []
    for t, n in enumerate(cut):
        (flat, steps, _), (more, after, end) = own.text(t), tails.text(t)
        changed.append(_print(np.concatenate((flat[:n], more)), [np.concatenate((x[:n], y)) for x, y in zip(steps, after, strict=True)], end))
    return [_print(*own.text(t)) for t in range(len(texts))], changed


@functools.lru_cache(256)
def _kept(low: int, high: int) -> np.ndarray:
    """Which samples of level ``low`` are also of level ``high``."""
    return np.isin(positions(low), positions(high))


def _walk_likeness(a: str, b: str) -> float:
    (la, xa), (lb, xb) = ((int(s.split(":")[0]), np.frombuffer(bytes.fromhex(s.split(":")[1]), np.uint8)) for s in (a, b))
    if la < lb:
        xa = xa[_kept(la, lb)[:len(xa)]]
    elif lb < la:
        xb = xb[_kept(lb, la)[:len(xb)]]
    n, most = min(len(xa), len(xb)), max(len(xa), len(xb))
    return float((xa[:n] == xb[:n]).sum() / most) if most else 0.0


def likeness(a: str, b: str) -> float:
    """Share of equal symbols among the steps sampled for either text, of
    the walk that agrees best."""
    if a == b:
        return 1.0
    return max(map(_walk_likeness, a.split("-"), b.split("-")))


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as much of the next text."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def _stream():
    """Rows of whole ranges in order -> one result row per document. Each
    range ends with the first document of the next one (``extra``)."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def emit(rows):  # rows: documents with their successors, in order; all but the last are new
        own = [t for _, t in rows]
        changed = [edited(t, f) for t, f in zip(own, own[1:], strict=False)]
        own_p, changed_p = both_prints(own)
        cols = [[d for d, _ in rows[:-1]], [len(t) for t in own[:-1]],
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], own_p[:-1], changed_p,
                [likeness(x, y) for x, y in zip(own_p, changed_p, strict=False)],
                [likeness(x, y) for x, y in zip(own_p, own_p[1:], strict=False)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches):
        rows, size, bucket, ended = [], 0, None, False
        for b in batches:
            for k, extra, doc, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if k != bucket:
                    if len(rows) > 1:
                        yield emit(rows)
                    rows, size, bucket, ended = [], 0, k, False
                if ended:
                    continue  # other rows of the next range's first id
                t = text.as_py() or ""
                rows.append((doc, t))
                size += len(t)
                ended = extra
                if size > SLICE and len(rows) > 1:
                    yield emit(rows)
                    rows, size = rows[-1:], len(t)
        if len(rows) > 1:
            yield emit(rows)
    return run


def _range_number(bounds: list[int]):
    """How many of the ascending bounds are at most the id, by bisection."""
    if not bounds:
        return F.lit(0)
    table, n, top = f"array({', '.join(f'{b}L' for b in bounds)})", len(bounds), 1 << (len(bounds).bit_length() - 1)
    return F.expr(f"""aggregate(sequence(0, {top.bit_length() - 1}), 0, (have, k) ->
        have + CASE WHEN have + shiftright({top}, k) <= {n} AND element_at({table}, least({n}, have + shiftright({top}, k))) <= doc_id
               THEN shiftright({top}, k) ELSE 0 END)""")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next: every document against its text with the last
    third replaced, and against the next document in descending id order."""
    source = with_package(renamed(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), "text")
    n = partitions(docs.sparkSession)
    cuts = source.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"] or []
    bounds = sorted(set(cuts))
    # ranges in descending order of id: 0 holds the largest, NULL ids are in the last
    placed = source.withColumn("k", F.when(F.col("doc_id").isNull(), F.lit(len(bounds)))
                               .otherwise(F.lit(len(bounds)) - _range_number(bounds)))
    # the first document of a range also goes to the range before it; the first range follows the last
    last = placed.select("k").distinct().withColumn("before", F.lag("k").over(Window.orderBy("k"))).withColumn(
        "before", F.coalesce("before", F.max("k").over(Window.partitionBy())))  # one row a range
    heads = placed.groupBy("k").agg(F.max("doc_id").alias("head")).join(last, "k")
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    copies = F.array_compact(F.array(F.struct(F.col("k").alias("k"), F.lit(False).alias("extra")),
                                     F.when(is_head, F.struct(F.col("before").alias("k"), F.lit(True).alias("extra")))))
    dealt = placed.join(F.broadcast(heads), "k").select("doc_id", "text", F.explode(copies).alias("to")).select("to.k", "to.extra", "doc_id", "text")
    ordered = dealt.repartitionByRange(n, "k").sortWithinPartitions("k", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(
        _stream(), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@functools.lru_cache(256)
def _bands(level: int, bands: int, rows: int) -> list[np.ndarray]:
    """Places of each band among the samples of a level, in turn among those
    that its texts have and the first half of these."""
    rng = np.random.default_rng([17, level])
    room = max(1, min(SAMPLES, 1 << level) // 2)
    pools = [max(1, room >> (n & 1)) for n in range(bands)]
    return [np.sort(rng.choice(pool, min(rows, pool), replace=False)) for pool in pools]


def _parsed(fp: str) -> list[tuple[int, np.ndarray]]:
    return [(int(one.split(":")[0]), np.frombuffer(bytes.fromhex(one.split(":")[1]), np.uint8)) for one in fp.split("-")]


def _band_keys(bands: int, rows: int):
    """(k, key) for each band of each walk, at the two levels that a text
    takes part in: a near text may be of the next level."""
    def run(batches):
        for b in batches:
            ks = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [_parsed(fp) for fp in b.column(1).to_pylist()]
            for walk in range(WALKS):
                at = {}
                for i, t in enumerate(texts):
                    level, symbols = t[walk]
                    at.setdefault(level, []).append((i, symbols))
                    at.setdefault(level + 1, []).append((i, symbols[_kept(level, level + 1)[:len(symbols)]]))
                out_k, out_key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for level, mine in at.items():
                    who, size = ks[[i for i, _ in mine]], np.array([len(x) for _, x in mine])
                    table = np.zeros((len(mine), SAMPLES // 2), np.uint64)
                    for row, (_, x) in zip(table, mine, strict=True):
                        row[:len(x)] = x[:SAMPLES // 2]
                    for n, places in enumerate(_bands(level, bands, rows)):
                        whole = size > places[-1]  # no place past the end
                        key = np.full(int(whole.sum()), (walk * 64 + level) * 65_536 + n + 1, np.uint64)
                        for place in places:
                            key = _mix((key + table[whole, place] + np.uint64(1)) * MIX)
                        out_k.append(who[whole])
                        out_key.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_key))], ["k", "key"])
    return run


def _shared(batches):
    """Of rows (k, key) in order of key and k those whose key another row has
    too, with the key's first row (a)."""
    names, held = ["k", "key", "a"], None  # the last row waits for the next one

    def batch(k, key, a):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(key), pa.array(a)], names)

    for b in batches:
        k, key = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        if not len(k):
            continue
        before = False
        if held is not None:
            k, key, before = np.insert(k, 0, held[0]), np.insert(key, 0, held[1]), held[2]
        same = key[1:] == key[:-1]
        a = k[np.maximum.accumulate(np.where(np.concatenate(([False], same)), 0, np.arange(len(k))))]
        if before:
            a[key == key[0]] = held[3]
        keep = np.concatenate(([before], same)) | np.concatenate((same, [False]))
        held = (k[-1], key[-1], bool(same[-1]) if len(same) else before, a[-1])
        yield batch(k[:-1][keep[:-1]], key[:-1][keep[:-1]], a[:-1][keep[:-1]])
    if held is not None and held[2]:
        yield batch(*(np.array([held[i]]) for i in (0, 1, 3)))


class Prints:
    """Distinct fingerprints as tables of symbols, by walk and level."""

    def __init__(self, prints: list[str]):
        parsed, self.walks = [_parsed(p) for p in prints], []
        for walk in range(WALKS):
            level, place, tables = np.array([p[walk][0] for p in parsed], np.int64), np.zeros(len(parsed), np.int64), {}
            for n in np.unique(level).tolist():
                who = np.flatnonzero(level == n)
                place[who] = np.arange(len(who))
                size = np.array([len(parsed[i][walk][1]) for i in who])
                table = np.full((len(who), size.max()), 256, np.int16)
                for row, i in zip(table, who.tolist(), strict=True):
                    row[:len(parsed[i][walk][1])] = parsed[i][walk][1]
                tables[n] = table, size
            self.walks.append((level, place, tables))

    @staticmethod
    def _raised(table: np.ndarray, size: np.ndarray, level: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a level that are also of level ``top``."""
        if level == top:
            return table, size
        columns = np.flatnonzero(_kept(level, top)[:table.shape[1]])
        return table[:, columns], np.searchsorted(columns, size)

    def likeness(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``likeness`` of the x-th with the y-th print, pair by pair."""
        best = (x == y).astype(np.float64)
        for level, place, tables in self.walks:
            both = level[x] * 64 + level[y]
            for n in np.unique(both).tolist():
                at, levels = np.flatnonzero(both == n), divmod(n, 64)
                (a, a_size), (b, b_size) = (self._raised(*tables[k], k, max(levels)) for k in levels)
                wide = min(a.shape[1], b.shape[1])
                a, b = a[:, :wide], np.where(b[:, :wide] == 256, 257, b[:, :wide])  # no place past both ends is equal
                for k in range(0, len(at), AT_ONCE):
                    part = at[k:k + AT_ONCE]
                    i, j = place[x[part]], place[y[part]]
                    most = np.maximum(np.maximum(a_size[i], b_size[j]), 1)
                    best[part] = np.maximum(best[part], (a[i] == b[j]).sum(axis=1) / most)
        return best


def _all_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """``likeness`` of each of ``left`` with each of ``right``."""
    x, y = np.divmod(np.arange(len(left) * len(right)), max(1, len(right)))
    return Prints(left + right).likeness(x, len(left) + y).reshape(len(left), len(right))


LINKS = "a long, b long, likeness double"


def _verified(at_least: float):
    def run(batches):
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            at = {p: i for i, p in enumerate(dict.fromkeys(x + y))}
            near = Prints(list(at)).likeness(np.array([at[p] for p in x], np.int64), np.array([at[p] for p in y], np.int64))
            keep = pa.array(near >= at_least)
            more = range(4, b.num_columns)  # further columns pass
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.float64()), *map(b.column, more)],
                                             ["a", "b", "likeness", *(b.schema.names[i] for i in more)]).filter(keep)
    return run


def _cross(left: np.ndarray, right: np.ndarray | None, c: np.ndarray):
    """Pairs (x, y) of a row of ``left`` and one of ``right`` of another
    class, a class of ``left`` at a time; without ``right`` each two rows of
    ``left`` meet once."""
    left = left[np.argsort(c[left], kind="stable")]
    ends = np.flatnonzero(np.diff(c[left], append=c[left[-1:]] - 1)) + 1 if len(left) else []
    if right is not None:
        right = right[np.argsort(c[right], kind="stable")]
    begin = 0
    for end in map(int, ends):
        if right is None:
            others = left[end:]
        else:
            low, high = np.searchsorted(c[right], c[left[begin]], "left"), np.searchsorted(c[right], c[left[begin]], "right")
            others = np.concatenate((right[:low], right[high:]))
        for k in range(begin, end, step := max(1, AT_ONCE * 16 // max(1, len(others)))):
            mine = left[k:min(end, k + step)]
            if len(others):
                yield np.repeat(mine, len(others)), np.tile(others, len(mine))
        begin = end


def _blocks_meet(at_least: float):
    """Rows (key, i, j, k, id, c, block, fp) in order of key, i and j -> near
    members of two blocks of a bucket (i, j), or of one with itself, whose
    classes are not yet connected. Rows of one class never meet."""
    names = ["a", "b", "likeness", "ca", "cb"]

    def found(rows, starts):
        key_i, key_j, k, c, block = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("i", "j", "k", "c", "block"))
        _, first, who = np.unique(k, return_index=True, return_inverse=True)
        prints, ids = Prints(rows.column("fp").take(pa.array(first)).to_pylist()), rows.column("id")
        out, waiting, size = [], [], 0

        def compare():
            x, y = (np.concatenate(side) for side in zip(*waiting, strict=True))
            near = prints.likeness(who[x], who[y])
            for n in np.flatnonzero(near >= at_least).tolist():
                one, other = sorted((int(x[n]), int(y[n])), key=lambda r: (not ids[r].is_valid, ids[r].as_py() or 0, k[r]))
                out.append((k[one], k[other], near[n], c[one], c[other]))

        for a, e in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            i, j = key_i[a], key_j[a]
            left, right = a + np.flatnonzero(block[a:e] == i), None if i == j else a + np.flatnonzero(block[a:e] == j)
            for pair in _cross(left, right, c):
                waiting.append(pair)
                size += len(pair[0])
                if size >= AT_ONCE * 16:
                    compare()
                    waiting, size = [], 0
        if waiting:
            compare()
        kinds = [np.int64, np.int64, np.float64, np.int64, np.int64]
        return pa.RecordBatch.from_arrays([pa.array(np.array([r[n] for r in out], kind)) for n, kind in enumerate(kinds)], names)

    def run(batches):
        held = []  # the last group may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([*held, b]).combine_chunks()
            of = [rows.column(x).to_numpy() for x in ("key", "i", "j")]
            starts = np.concatenate(([0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in of], axis=0)) + 1)).tolist()
            if len(starts) > 1:
                yield found(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]).to_batches()
        if held:
            yield found(pa.Table.from_batches(held), [0])
    return run


def _links(classes: DataFrame, bands: int, rows: int, at_least: float, least_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """a, b, likeness: links between classes (k, id, fp) that connect any two
    near ones which share a bucket; and a, b: the same connections, with one
    row for each class that the first leaders' links connect. A bucket's
    first leader is its smallest k, or with ``least_ids`` its smallest id."""
    n = partitions(classes.sparkSession)
    members = written(classes.select("k", "fp").mapInArrow(_band_keys(bands, rows), "k long, key long")
                      .repartition(n, "key").sortWithinPartitions("key", "k").mapInArrow(_shared, "k long, key long, a long"), "op7-members")
    fps = classes.select("k", "fp")
    first = members
    if least_ids:
        smallest = F.first("k").over(Window.partitionBy("key").orderBy(F.col("id").isNull(), "id", "k"))
        first = members.join(classes.select("k", "id"), "k").withColumn("a", smallest)
    pairs = first.filter("a <> k").select("a", F.col("k").alias("b")).distinct()
    sides = (pairs.join(fps.select(F.col("k").alias("a"), F.col("fp").alias("x")), "a")
             .join(fps.select(F.col("k").alias("b"), F.col("fp").alias("y")), "b").select("a", "b", "x", "y"))
    links = written(sides.mapInArrow(_verified(at_least), LINKS), "op7-stars")
    joined = components(links, "a", "b").toDF("a", "b").filter("a <> b")
    members = members.drop("a").join(joined.toDF("k", "c"), "k", "left").select("key", "k", F.coalesce("c", "k").alias("c"))
    # the members of open buckets, read out once
    members = written(_open(members, 1), "op7-open")
    sizes = members.groupBy("key", "c").agg(F.count("*").alias("s"), F.first("n").alias("n"))
    if _few_pairs(sizes):
        members = members.select("key", "k", "c", "n")
    else:
        members, links, joined = _more_leaders(members, fps, links, joined, at_least)
    mine = (members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")))
    dealt = (mine.select("key", "k", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .join(classes.select("k", "id", "fp"), "k").withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    more = (dealt.select("key", "i", "j", "k", "id", "c", "block", "fp").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(_blocks_meet(at_least), f"{LINKS}, ca long, cb long").dropDuplicates(["a", "b"]))
    more = written(more, "op7-more")
    return (links.unionByName(more.select("a", "b", "likeness")),
            joined.unionByName(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))


def _few_pairs(sizes: DataFrame) -> bool:
    """Whether the members of open buckets, n in a bucket and s of them of
    one class, have at most ``PAIRS`` others to meet on average: comparing
    these costs less than a round of leaders."""
    s = F.col("s").cast("double")
    r = sizes.agg(F.sum(s).alias("members"), F.sum(s * (F.col("n") - s)).alias("others")).first()
    return (r["others"] or 0) <= PAIRS * (r["members"] or 0)


def _more_leaders(members: DataFrame, fps: DataFrame, links: DataFrame, joined: DataFrame, at_least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rounds of further leaders in open buckets: what is left of the members
    (key, k, c, n), and links and connections with those found. The rounds
    follow the classes that each bucket holds (c, now part of another one,
    now), and a leader meets the members of other classes only."""
    held = members.groupBy("key", "c").agg(F.min(F.struct(F.xxhash64("k", F.lit(2)), "k")).alias("l"), F.first("n").alias("n"),
                                           F.first("a").alias("a"), F.first("ca").alias("ca"))
    held = written(held.select("key", "c", F.col("c").alias("now"), "l", "n", "a", "ca"), "op7-held")
    members = members.select("key", "c", "k")
    for _ in range(1, LEADERS):
        others = held.filter("now <> ca").select("key", "c", "now", "a", "ca")
        pairs = members.join(others, ["key", "c"]).select("a", F.col("k").alias("b"), "ca", F.col("now").alias("cb")).dropDuplicates(["a", "b"])
        sides = (pairs.join(fps.select(F.col("k").alias("a"), F.col("fp").alias("x")), "a")
                 .join(fps.select(F.col("k").alias("b"), F.col("fp").alias("y")), "b").select("a", "b", "x", "y", "ca", "cb"))
        found = written(sides.mapInArrow(_verified(at_least), f"{LINKS}, ca long, cb long"), "op7-stars")
        links, joined = links.unionByName(found.select("a", "b", "likeness")), joined.unionByName(found.select("a", "b"))
        merged = components(found.select("ca", "cb"), "ca", "cb").filter("id <> component")
        held = written(_next_leaders(held.join(merged.toDF("now", "to"), "now", "left").withColumn("now", F.coalesce("to", "now"))), "op7-held")
    return members.join(held.select("key", "c", "now", "n"), ["key", "c"]).select("key", "k", F.col("now").alias("c"), "n"), links, joined


def _next_leaders(held: DataFrame) -> DataFrame:
    """Classes (key, c, now, l, n) of the buckets that still hold several
    ones, with the bucket's next leader a, of class ca: the least by l."""
    keys = (held.groupBy("key").agg(F.min("now").alias("low"), F.max("now").alias("high"), F.min(F.struct("l", "now")).alias("one"))
            .filter("low <> high").select("key", F.col("one.l.k").alias("a"), F.col("one.now").alias("ca")))
    return held.select("key", "c", "now", "l", "n").join(keys, "key")


def _open(members: DataFrame, turn: int) -> DataFrame:
    """Members (key, k, c) of the buckets that hold several classes, with the
    bucket's size n and this turn's leader a, of class ca; of buckets with
    the same members one."""
    keys = (members.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"),
                                       F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("same"),
                                       F.min(F.struct(F.xxhash64("k", F.lit(turn)), "k", "c")).alias("l")).filter("low <> high")
            .groupBy("n", "same").agg(F.min(F.struct("key", "l")).alias("one"))
            .select("one.key", "n", F.col("one.l.k").alias("a"), F.col("one.l.c").alias("ca")))
    return members.join(keys, "key")


def similar(prints: DataFrame, id_col: str = "doc_id", print_col: str = "fingerprint", bands: int = 16, rows: int = 4,
            at_least: float = 0.6) -> DataFrame:
    """Near documents: left_id, right_id, likeness. Equal fingerprints are
    one class, linked to its smallest id; links between classes are those of
    their smallest ids. Any two near documents that share a bucket are
    connected by links."""
    source = with_package(renamed(prints, id=id_col, fp=print_col)).filter(F.col("fp").isNotNull() & F.col("id").isNotNull())
    classes = written(source.groupBy("fp").agg(F.min(F.col("id").cast("long")).alias("id")).withColumn("k", F.xxhash64("fp")), "op7-classes")
    copies = (source.withColumnRenamed("id", "right_id").join(classes.withColumnRenamed("id", "left_id"), "fp")
              .filter("left_id <> right_id").select("left_id", "right_id", F.lit(1.0).alias("likeness")))
    ids = classes.select("k", "id")
    links, _ = _links(classes, bands, rows, at_least, least_ids=True)
    found = (links.join(ids.toDF("a", "left_id"), "a").join(ids.toDF("b", "right_id"), "b")
             .select("left_id", "right_id", "likeness"))
    return found.unionByName(copies)


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 16, rows: int = 4, at_least: float = 0.6) -> DataFrame:
    """``fingerprints`` with ``class_id``: the smallest doc_id among the
    documents that links of ``similar`` and equal fingerprints connect (NULL
    if none of them has an id)."""
    prints = written(fingerprints(docs, id_col, text_col), "op7-prints")
    classes = (prints.groupBy(F.xxhash64("fingerprint").alias("k"))
               .agg(F.first("fingerprint").alias("fp"), F.min("doc_id").alias("id"), F.count("*").alias("n")))
    classes = written(classes, "op7-classes")
    _, joined = _links(classes, bands, rows, at_least)
    of = components(joined, "a", "b").filter("id <> component").select(F.col("id").alias("k"), F.col("component").alias("c"))
    whole = classes.select("k", "id", "n").join(of, "k", "left").withColumn("c", F.coalesce("c", "k"))
    low = whole.groupBy("c").agg(F.min("id").alias("class_id"), F.sum("n").alias("all")).filter("all > 1")
    of_k = written(whole.join(low, "c").select("k", "class_id"), "op7-class-ids")  # the others are alone
    # a merge join at every size: both sides grow with the corpus
    out = prints.withColumn("k", F.xxhash64("fingerprint")).join(of_k.hint("merge"), "k", "left")
    return out.select(*prints.columns, F.coalesce("class_id", "doc_id").alias("class_id"))
