"""Conversation structure repair by Four-Russians block tables.

The roles of a conversation, by their initials, should read ``(s?(ua)+)?``.
Each row is kept (0), given the role of user or assistant (3) or deleted
(4); messages with empty text may be inserted anywhere (3); a truncated row
that stays costs 3 more; blank and duplicate rows must go. Of the cheapest
edits those are chosen whose initials (K, R, D, I) in order are ASCII-least.

1. Order. Rows are range-partitioned and sorted by conversation, turn (NULLs
   first), role and text; a row's place ``at`` is global. Places are cut into
   segments of 2 ** ``segment_bits`` rows, so a conversation with a third of
   all rows is spread over many segments.
2. Symbols. A row is one of nine symbols: its role's initial (s, u, a or
   another) with or without truncation, or one that must go.
3. Tables. The cost vector over the four states of the role pattern, less
   its least entry, has few values (states that cannot be on a cheapest path
   are dropped). For every value and every block of ``BLOCK`` symbols the
   next value and the added cost are precomputed by composition, so a block
   is one lookup.
4. Tracing. Going back from the end, each block is expanded into its inner
   vectors and each place gets the set of states on any cheapest path; the
   ASCII-least edits are then read forward through these sets.
5. A conversation in several segments: each piece yields its map of vectors
   (one job), then of state sets and states (another); both are composed per
   conversation, one small row per 65,536 rows, and the pieces are traced
   apart.

Only symbols go through Python, at most a segment in a group.
``report`` streams the repaired text of a conversation through one SHA-256,
which is sequential by nature: that task holds no more than a batch.

Defined results: a NULL role or text is one space, a NULL turn comes first,
rows with a NULL conv_id are one conversation. A role that begins with none
of s, u, a (also an empty one) is never kept. Equal rows of one turn are
duplicates of the first. An empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import dropped, renamed, with_package, written

START, S, U, A = range(4)
KINDS = "sua"  # initials by number; 3: any other
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
MUST_GO = 8    # symbols: 2 * kind + truncated, or this
BLOCK = 4      # symbols of a table block
SEGMENT_BITS = 16
_FAR = 1 << 20
_STEP = {(START, 0): S, (START, 1): U, (S, 1): U, (U, 2): A, (A, 1): U}
_OWED = {START: U, S: U, U: A, A: U}  # where a reroled or inserted message leads
_ROLE = {U: "u", A: "a"}
_BLANK = " \t\n\x0b\x0c\r"


def _settled(v) -> tuple[tuple[int, ...], int]:
    """Inserts applied, states that are on no cheapest path dropped, least
    entry taken off. From A every way on from START costs at most a deletion
    more, and every way on from S costs the same."""
    v = list(v)
    for _ in range(3):
        for s, t in _OWED.items():
            v[t] = min(v[t], v[s] + INSERT)
    if v[START] > v[A] + DELETE:
        v[START] = _FAR
    if v[S] > v[A]:
        v[S] = _FAR
    low = min(v)
    return tuple(_FAR if x >= _FAR else x - low for x in v), low


def _edges(sym: int, s: int):
    """(edit, next state, cost) of a row read in state s."""
    yield "D", s, DELETE
    if sym != MUST_GO:
        kind, more = sym // 2, TRUNCATED * (sym % 2)
        if (s, kind) in _STEP:
            yield "K", _STEP[s, kind], KEEP + more
        yield "R", _OWED[s], REROLE + more


class Tables:
    """Cost vectors by number, and the tables over them."""

    def __init__(self, block: int):
        first, _ = _settled((0, _FAR, _FAR, _FAR))
        self.vectors, number, moves = [first], {first: 0}, []
        at = 0
        while at < len(self.vectors):
            v, row = self.vectors[at], []
            for sym in range(MUST_GO + 1):
                w = [_FAR] * 4
                for s in range(4):
                    if v[s] < _FAR:
                        for _, t, c in _edges(sym, s):
                            w[t] = min(w[t], v[s] + c)
                w, low = _settled(w)
                if w not in number:
                    number[w] = len(self.vectors)
                    self.vectors.append(w)
                row.append((number[w], low))
            moves.append(row)
            at += 1
        moves = np.array(moves, np.int32)
        self.symbols, self.block = MUST_GO + 1, block
        self.next1, self.cost1 = moves[:, :, 0], moves[:, :, 1]
        # blocks by composition: one more symbol at the end
        self.next, self.cost = self.next1, self.cost1
        for _ in range(block - 1):
            cost = self.cost[:, :, None] + self.cost1[self.next]
            self.next = self.next1[self.next].reshape(len(moves), -1)
            self.cost = cost.reshape(len(moves), -1)
        n = len(moves)
        self.before = np.array([[[self._before(v, y, m) for m in range(16)] for y in range(self.symbols)] for v in range(n)], np.int8)
        self.after = np.array([[[[self.read(v, y, m, s)[2] for s in range(4)] for m in range(16)] for y in range(self.symbols)]
                               for v in range(n)], np.int8)

    def _back(self, v: int, states: int) -> int:
        """States from which inserts lead into the given ones at no loss."""
        w = self.vectors[v]
        for _ in range(3):
            for s, t in _OWED.items():
                if states >> t & 1 and w[s] < _FAR and w[s] + INSERT == w[t]:
                    states |= 1 << s
        return states

    def _before(self, v: int, sym: int, states: int) -> int:
        """States before a row that are on a cheapest path into ``states``."""
        a, b, low = self.vectors[v], self.vectors[self.next1[v, sym]], self.cost1[v, sym]
        found = 0
        for s in range(4):
            if a[s] < _FAR and any(states >> t & 1 and a[s] + c == low + b[t] for _, t, c in _edges(sym, s)):
                found |= 1 << s
        return self._back(v, found)

    def end(self, v: int) -> int:
        """States at a conversation's end that are on a cheapest path."""
        w = self.vectors[v]
        least = min(w[START], w[A])
        return self._back(v, (w[START] == least) << START | (w[A] == least) << A)

    @lru_cache(maxsize=None)  # noqa: B019 - one instance a worker, few keys
    def read(self, v: int, sym: int, states: int, s: int) -> tuple[str, str, int]:
        """(edits, roles, next state): the ASCII-least edits at a row on the
        way from state s into ``states``, inserts before it included."""
        here, edits, roles = self._before(v, sym, states), "", ""
        a, b, low = self.vectors[v], self.vectors[self.next1[v, sym]], self.cost1[v, sym]
        if not here >> s & 1:
            return "", "", -1
        while True:
            fit = {e: t for e, t, c in _edges(sym, s) if states >> t & 1 and a[s] + c == low + b[t]}
            t = _OWED[s]
            if "D" in fit:
                return edits + "D", roles + "-", fit["D"]
            if here >> t & 1 and a[s] + INSERT == a[t]:
                edits, roles, s = edits + "I", roles + _ROLE[t], t
                continue
            edit = "K" if "K" in fit else "R"
            return edits + edit, roles + ("=" if edit == "K" else _ROLE[t]), fit[edit]

    def close(self, v: int, s: int) -> tuple[str, str]:
        """Inserts after the last row."""
        w, edits, roles = self.vectors[v], "", ""
        least = min(w[START], w[A])
        while not (s in (START, A) and w[s] == least):
            s = _OWED[s]
            edits, roles = edits + "I", roles + _ROLE[s]
        return edits, roles

    # pieces: runs of symbols of one conversation

    def _codes(self, symbols: np.ndarray) -> np.ndarray:
        whole = len(symbols) // self.block * self.block
        return symbols[:whole].reshape(-1, self.block) @ (self.symbols ** np.arange(self.block - 1, -1, -1))

    def forward(self, symbols: np.ndarray, v):
        """Vectors (or rows of vectors) at each block's begin, and at the end."""
        at = []
        for code in self._codes(symbols).tolist():
            at.append(v)
            v = self.next[v, code]
        at.append(v)
        for y in symbols[len(symbols) // self.block * self.block:].tolist():
            v = self.next1[v, y]
        return at, v

    def expand(self, symbols: np.ndarray, at, states):
        """(row, vector, states after the row) backward, block by block."""
        for k in range(len(at) - 1, -1, -1):
            inner, part = [at[k]], symbols[k * self.block:(k + 1) * self.block].tolist()
            for y in part[:-1]:
                inner.append(self.next1[inner[-1], y])
            for j in range(len(part) - 1, -1, -1):
                yield k * self.block + j, inner[j], states
                states = self.before[inner[j], part[j]][states]
        return states

    def trace(self, symbols: np.ndarray, v: int = 0, s: int = START, states: int | None = None):
        """Edits and roles of each row of a piece that begins with vector v
        in state s and ends in ``states`` (None: the conversation ends)."""
        at, last = self.forward(symbols, v)
        ends = states is None
        steps = [None] * len(symbols)
        for row, w, after in self.expand(symbols, at, self.end(last) if ends else states):
            steps[row] = (int(w), int(after))
        edits, roles = [], []
        for y, (w, after) in zip(symbols.tolist(), steps, strict=True):
            e, r, s = self.read(w, y, after, s)
            edits.append(e)
            roles.append(r)
        if ends and edits:
            e, r = self.close(last, s)
            edits[-1] += e
            roles[-1] += r
        return edits, roles

    def ways(self, symbols: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
        """For each set of end states: the states at the piece's begin, and
        the state that each begin state is led to."""
        at, _ = self.forward(symbols, v)
        steps, states = [], np.arange(16)
        for row, w, after in self.expand(symbols, at, states):
            steps.append((w, symbols[row], after))
            states = self.before[w, symbols[row]][after]
        led = np.tile(np.arange(4), (16, 1))
        for w, y, after in reversed(steps):
            led = np.where(led >= 0, self.after[w, y][after[:, None], led], -1)
        return states, led


@lru_cache(maxsize=4)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def _symbols(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    kinds, faults = (np.asarray(rows[c]).astype(np.int64) for c in ("kind", "fault"))
    return kinds, np.where(faults == 2, MUST_GO, 2 * kinds + (faults == 1))


def _piece_map(key, rows):
    """The vector each vector is led to, and the last row's kind."""
    rows = rows.sort_by("at")
    kinds, symbols = _symbols(rows)
    t = tables()
    _, last = t.forward(symbols, np.arange(len(t.vectors)))
    return pa.table({"conv": [key[0].as_py()], "seg": pa.array([key[1].as_py()], pa.int64()), "leads": pa.array([last.tolist()], pa.list_(pa.int32())),
                     "last_kind": pa.array([int(kinds[-1])], pa.int32())})


def _compose_vectors(rows):
    """Vector at the begin of each piece of a conversation, the kind before
    it, and the states at the conversation's end (on the last piece)."""
    t, v, kind, out = tables(), 0, None, []
    pieces = rows.sort_by("seg").to_pylist()
    for p in pieces:
        out.append({"conv": p["conv"], "seg": p["seg"], "v": v, "kind_before": kind, "end": None})
        v, kind = p["leads"][v], p["last_kind"]
    out[-1]["end"] = t.end(v)
    return pa.Table.from_pylist(out, schema=pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("v", pa.int32()), ("kind_before", pa.int32()),
                                                       ("end", pa.int32())]))


def _piece_ways(key, rows):
    rows = rows.sort_by("at")
    first = rows.slice(0, 1).to_pylist()[0]
    states, led = tables().ways(_symbols(rows)[1], first["v"])
    return pa.Table.from_pylist([{k: first[k] for k in ("conv", "seg", "v", "kind_before", "end")}
                                 | {"begins": states.tolist(), "led": led.ravel().tolist()}],
                                schema=pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("v", pa.int32()), ("kind_before", pa.int32()),
                                                  ("end", pa.int32()), ("begins", pa.list_(pa.int32())), ("led", pa.list_(pa.int32()))]))


def _compose_states(rows):
    pieces = rows.sort_by("seg").to_pylist()
    states = pieces[-1]["end"]
    for p in reversed(pieces):
        p["states"] = states
        states = p["begins"][states]
    s = START
    for p in pieces:
        p["s"] = s
        s = p["led"][4 * p["states"] + s]
    out = [{"conv": p["conv"], "seg": p["seg"], "v": p["v"], "kind_before": p["kind_before"], "s": p["s"],
            "states": None if p is pieces[-1] else p["states"]} for p in pieces]
    return pa.Table.from_pylist(out, schema=pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("v", pa.int32()), ("kind_before", pa.int32()),
                                                       ("s", pa.int32()), ("states", pa.int32())]))


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au


def _trace_segment(rows):
    """Edits of all rows of a segment; pieces of conversations that lie in
    several segments bring their begin with them (v, s, states)."""
    rows = rows.sort_by("at")
    kinds, symbols = _symbols(rows)
    conv = rows.column("conv").to_pylist()
    bounds = [0] + [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]] + [len(conv)]
    t, edits, roles = tables(), [], []
    illegal = np.zeros(len(conv), bool)
    illegal[1:] = ~_LEGAL[kinds[:-1], kinds[1:]]
    for a, e in zip(bounds, bounds[1:], strict=False):
        p = rows.slice(a, 1).select(["v", "s", "states", "kind_before"]).to_pylist()[0]
        illegal[a] = p["kind_before"] is not None and not _LEGAL[p["kind_before"], kinds[a]]
        whole = p["v"] is None
        x, y = t.trace(symbols[a:e], 0 if whole else p["v"], START if whole else p["s"], p["states"])
        edits += x
        roles += y
    return pa.table({"at": rows.column("at").cast(pa.int64()), "illegal": illegal, "edits": pa.array(edits, pa.string()), "roles": pa.array(roles, pa.string())})


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with faults put in by a digest of (conv_id,
    turn): rows dropped, emptied, without ends of sentences, repeated, or by
    another speaker."""
    rows = renamed(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).fillna(" ", ["role", "text"])
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_d", F.crc32(key.cast("binary")) % 20).filter("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


def _key(col: str):
    return F.when(F.col(col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(col).cast("string")))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Every row in order with what becomes of it: conv_id, at (place),
    turn, role, text, fault (blank, duplicate, truncated or NULL), illegal
    (the pair with the row before), edits (initials, inserts before and
    after the row's own included), roles (one sign per edit: u or a for a
    new role, = for the row's own, - for a deletion)."""
    rows = renamed(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).fillna(" ", ["role", "text"])
    rows = with_package(rows).withColumns({"conv": _key("conv_id"), "digest": F.xxhash64("text")})
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("digest")
                   .withColumn("at", F.monotonically_increasing_id()), "repair-rows")
    bare = F.rtrim("text", F.lit(_BLANK))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    judged = rows.select("conv", "at", kind.alias("kind"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    firsts = rows.groupBy("conv", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("at"))
    seen = rows.select("at").join(firsts.select("at"), "at", "left_anti").withColumn("seen", F.lit(True))
    fault = F.when(F.col("blank") | F.col("seen").isNotNull(), 2).when(F.col("cut"), 1).otherwise(0)
    cells = written(judged.join(seen, "at", "left").select(
        "conv", "at", F.expr(f"shiftright(at, {segment_bits})").alias("seg"), "kind", fault.alias("fault"),
        F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("cut"), "truncated").alias("name")), "repair-cells")
    # conversations that lie in several segments
    split = cells.groupBy("conv").agg(F.min("seg").alias("a"), F.max("seg").alias("z")).filter("a < z").select("conv")
    begun = "conv string, seg long, v int, kind_before int"
    pieces = written(cells.join(split, "conv", "left_semi").select("conv", "seg", "at", "kind", "fault"), "repair-pieces")
    maps = written(pieces.groupBy("conv", "seg").applyInArrow(_piece_map, "conv string, seg long, leads array<int>, last_kind int"), "repair-maps")
    vectors = maps.groupBy("conv").applyInArrow(_compose_vectors, begun + ", end int")
    ways = (pieces.join(vectors, ["conv", "seg"]).groupBy("conv", "seg")
            .applyInArrow(_piece_ways, begun + ", end int, begins array<int>, led array<int>"))
    starts = written(written(ways, "repair-ways").groupBy("conv").applyInArrow(_compose_states, begun + ", s int, states int"), "repair-starts")
    traced = (cells.drop("name").join(starts, ["conv", "seg"], "left").groupBy("seg")
              .applyInArrow(_trace_segment, "at long, illegal boolean, edits string, roles string"))
    done = written(rows.join(cells.select("at", "name"), "at").join(traced, "at").select(
        "conv_id", "at", "turn", "role", "text", F.col("name").alias("fault"), "illegal", "edits", "roles"), "repair-done")
    dropped(rows, cells, pieces, maps, starts)
    return done


def messages(repaired: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, at, k (order at one place), role,
    text."""
    each = F.expr("filter(sequence(1, length(edits)), k -> length(edits) > 0 AND substring(edits, k, 1) <> 'D')")
    sign, edit = F.expr("substring(roles, k, 1)"), F.expr("substring(edits, k, 1)")
    return (repaired.select("conv_id", "at", "role", "text", "edits", "roles", F.explode(each).alias("k"))
            .select("conv_id", "at", "k", F.when(sign == "u", "user").when(sign == "a", "assistant").otherwise(F.col("role")).alias("role"),
                    F.when(edit == "I", "").otherwise(F.col("text")).alias("text")))


def _streams(batches):
    """Sorted rows (conv, edits, lines) -> (conv, audit, digest); holds one
    conversation's edits, not its text."""
    now, audit, h, lines = None, [], None, 0
    fields = ["conv", "audit", "repaired_sha256"]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array(["".join(audit)], pa.string()), pa.array([h.hexdigest()], pa.string())], fields)

    for b in batches:
        out = []
        for conv, edits, part in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if conv != now:
                if now is not None:
                    out.append(row())
                now, audit, h, lines = conv, [], hashlib.sha256(), 0
            audit.append(edits)
            for line in part:
                h.update((("\n" if lines else "") + line).encode())
                lines += 1
        yield from out
    if now is not None:
        yield row()


def report(repaired: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation of the table: gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    rows = repaired.withColumn("conv", _key("conv_id"))

    def count(test):
        return F.sum(F.when(test, 1).otherwise(0).cast("long"))

    edits = {e: F.length("edits") - F.length(F.regexp_replace("edits", e, "")) for e in "RDI"}
    cost = (REROLE * edits["R"] + DELETE * edits["D"] + INSERT * edits["I"]
            + F.when((F.col("fault") == "truncated") & (edits["D"] == 0), TRUNCATED).otherwise(0)).cast("long")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    turns = rows.groupBy("conv", "turn").agg(*[count(F.col("fault") == f).alias(f) for f in sums[:3]], count(F.col("illegal")).alias("illegal"), F.sum(cost).alias("cost"))
    stats = turns.groupBy("conv").agg(*[F.sum(s).alias(s) for s in sums],
                                      (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    new_role = "CASE substring(roles, k, 1) WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE role END"
    lines = F.expr(f"""transform(filter(sequence(1, length(edits)), k -> substring(edits, k, 1) <> 'D'),
                       k -> concat({new_role}, ':', IF(substring(edits, k, 1) = 'I', '', text)))""")
    streams = (rows.select("conv", "edits", lines.alias("lines"), "at").repartition("conv").sortWithinPartitions("conv", "at")
               .select("conv", "edits", "lines").mapInArrow(_streams, "conv string, audit string, repaired_sha256 string"))
    ids = conversations.select(F.col(f"`{conv_col}`").alias("conv_id")).distinct().withColumn("conv", _key("conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (ids.join(stats, "conv", "left").join(streams, "conv", "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["gaps", *sums]],
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))
