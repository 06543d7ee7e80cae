import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from tillroll.llm import conversation_repair as cr

WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(symbols):
    """(cost, audit) by trying every edit from the front, least first."""
    @lru_cache(maxsize=None)
    def best(i, s, inserts):
        out = []
        if i == len(symbols):
            if s in (cr.START, cr.A):
                out.append((0, "", ""))
        else:
            y = symbols[i]
            kind, cut = (None, 0) if y == 8 else divmod(y, 2)
            edits = [("D", s, 4, "-")]
            if y != 8:
                step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
                name = ["", "s", "u", "a"]
                letter = "suao"[kind]
                to = step.get((name[s], letter))
                if to:
                    edits.append(("K", name.index(to), 3 * cut, "="))
                new = "a" if name[s] == "u" else "u"
                edits.append(("R", name.index(new), 3 + 3 * cut, new))
            for e, t, c, r in edits:
                rest = best(i + 1, t, 0)
                if rest:
                    out.append((rest[0] + c, e + rest[1], r + rest[2]))
        if inserts < 3:
            new, t = ("a", cr.A) if s == cr.U else ("u", cr.U)
            rest = best(i, t, inserts + 1)
            if rest:
                out.append((rest[0] + 3, "I" + rest[1], new + rest[2]))
        return min(out) if out else None
    return best(0, cr.START, 0)


def tried(t, symbols):
    import numpy as np
    edits, roles = t.trace(np.array(symbols, np.int64))
    return "".join(edits), "".join(roles)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_every_short_conversation(block):
    t = cr.tables(block)
    for n in range(1, 5):
        for symbols in itertools.product(range(9), repeat=n):
            assert tried(t, symbols) == cheapest(symbols)[1:]


def test_longer_conversations_and_pieces():
    import numpy as np
    t, rng = cr.tables(), random.Random(3)
    for _ in range(150):
        symbols = [rng.choice([0, 2, 3, 4, 4, 2, 4, 5, 6, 8]) for _ in range(rng.randrange(5, 60))]
        whole = cheapest(tuple(symbols))
        assert tried(t, symbols) == whole[1:]
        # in pieces: vectors forward, states backward, then each alone
        cuts = sorted(rng.sample(range(1, len(symbols)), min(3, len(symbols) - 1)))
        pieces = [np.array(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]
        begin, v = [], 0
        for p in pieces:
            begin.append(v)
            v = int(t.forward(p, np.arange(len(t.vectors)))[1][v])
        after, ways = [t.end(v)], []
        for p, b in zip(pieces[::-1], begin[::-1], strict=True):
            ways.append(t.ways(p, b))
            after.append(int(ways[-1][0][after[-1]]))
        s, got = cr.START, ""
        for p, b, m, (_, led) in zip(pieces, begin, after[-2::-1], ways[::-1], strict=True):
            got += "".join(t.trace(p, b, s, None if p is pieces[-1] else m)[0])
            s = int(led[m][s])
        assert got == whole[1]


def plain_way(rows):
    """The whole contract in plain Python."""
    found = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        found[c] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for c, lines in found.items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], cr_digest(r[2]), r[2]))
        seen, symbols, faults = set(), [], []
        for _, role, text in lines:
            chars = WORD.findall(text)
            fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            kind = "sua".find(role[:1]) if role[:1] else 3
            symbols.append(8 if fault in ("blank", "duplicate") else 2 * (3 if kind < 0 else kind) + (fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:], strict=False))
        turns = {t for t, *_ in lines if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, roles = cheapest(tuple(symbols)) if lines else (0, "", "")
        fixed, i = [], 0
        for e, r in zip(audit, roles, strict=True):
            name = {"u": "user", "a": "assistant"}.get(r)
            if e == "I":
                fixed.append(f"{name}:")
                continue
            if e != "D":
                fixed.append(f"{name or lines[i][1]}:{lines[i][2]}")
            i += 1
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def cr_digest(text):
    """Order of rows of one turn and role, as the operator has it."""
    import xxhash
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def found(df, **kw):
    return sorted((tuple(r) for r in cr.report(cr.repair(cr.damage(df), **kw), df).collect()), key=repr)


COLS = "conv_id long, turn long, role string, text string"
EXTRA = ", at long, seg long, kind int, fault string, edits string, conv string, v int"


@pytest.mark.parametrize("segment_bits", [0, 2, 16])
def test_contract_also_over_many_segments(spark, segment_bits):
    rng = random.Random(11)
    rows = []
    for c in range(25):
        for turn in range(rng.choice([0, 1, 3, 9, 40])):
            if rng.random() < 0.9:
                rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "Why? ", f"{turn}!", ""])))
    df = spark.createDataFrame(rows, COLS).repartition(4)
    assert found(df, segment_bits=segment_bits) == plain_way(rows)


def test_odd_rows(spark):
    rows = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 2, None, "x."), (1, 2, "", None), (2, None, None, None), (None, 1, "user", "A."),
            (None, 2, "assistant", "B."), (3, 5, "system", "   "), (3, -2, "user", "long text. " * 20_000), (3, 7, "assistant", "é\x0b!\n"),
            (4, 0, "USER", "a."), (4, 0, "user", "b."), (4, 0, "assistant", "b."), (5, 1, "user", " "), (5, 10**12, "assistant", "z.")]
    clash = spark.createDataFrame([(*r, 1, 2, 3, "f", "e", "c", 4) for r in rows], COLS + EXTRA).repartition(3)
    assert found(clash) == plain_way(rows)
    assert found(spark.createDataFrame([], COLS + EXTRA)) == []


def test_messages_read_as_the_pattern(spark):
    rows = [(c, t, r, "Text.") for c in range(30) for t, r in enumerate(random.Random(c).choices(["system", "user", "assistant", "tool"], k=c % 9))]
    rows = [(c, t, r, x + str(t) + ".") for c, t, r, x in rows]
    fixed = cr.messages(cr.repair(spark.createDataFrame(rows, COLS))).orderBy("conv_id", "at", "k").collect()
    for c in range(30):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in fixed if r.conv_id == c))
