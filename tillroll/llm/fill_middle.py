"""Fill-in-middle transformation over seekable compressed frames.

A unit is a word with the white space before it; white space at the end of
a text is a unit of its own. A text is cut after two of its units into
prefix, middle and suffix, which are put in another order between marks.

1. Store. ``store`` keeps each whole text as independent zstandard frames of
   at most ``frame_bytes`` bytes (cut between characters, also inside a very
   long unit), with the units that begin, the characters and the bytes that
   lie before each frame.
2. Plan. ``plan`` reads only the counts: form and cuts come from a keyed
   digest of the document's id, in DataFrame functions.
3. Selection. Where unit k begins is found by its frame's counts; only that
   frame is opened. The new text is written as frames again, each part
   streamed from the frames that hold it.
4. Digests and the way back stream ordered frames: the marks are found in
   the new text's frames, the parts read from there in the text's order. Of
   a long text one frame at a time is open; the rest stays compressed.

Scale: a narrow map; the frames are one table in the shared folder, written
once, and texts are not shuffled. A source that holds a third of all rows is
split as any other rows are.

Defined results: a NULL text counts as empty; an empty text, or one that
holds a mark, stays plain. A NULL id is written as nothing behind the seed
and its row stays; rows with equal ids and texts give equal rows. An empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import renamed, with_package

FRAME_BYTES = 1 << 16
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDER = {"plain": (), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

STORE = "doc_id long, n long, marked boolean, frames array<binary>, units array<long>, chars array<long>, bytes array<long>"
_STORE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(pa.binary())),
                    ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64()))])


def _begins(data: np.ndarray, first: bool) -> np.ndarray:
    """Places in a run of bytes where a unit begins: a blank behind a word.
    ``first``: so does the run itself."""
    blank = _BLANK[data]
    begins = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.concatenate(([0], begins)) if first and len(data) else begins


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Frames:
    """A text in independent frames; counts before each and at the end."""

    def __init__(self, blobs, units, chars, sizes):
        self.blobs, self.units, self.chars, self.sizes = blobs, units, chars, sizes
        self._open = (-1, b"")

    @classmethod
    def of(cls, chunks, frame_bytes: int, pack: zstandard.ZstdCompressor) -> Frames:
        """Frames of a text that arrives in chunks of UTF-8 bytes."""
        blobs, units, chars, sizes = [], [0], [0], [0]
        after_word, kept = False, b""

        def shut(part: bytes):
            nonlocal after_word
            data = np.frombuffer(part, np.uint8)
            first = not blobs or (after_word and bool(_BLANK[data[0]]))
            units.append(units[-1] + len(_begins(data, first)))
            chars.append(chars[-1] + _characters(data))
            sizes.append(sizes[-1] + len(part))
            after_word = not _BLANK[data[-1]]
            blobs.append(pack.compress(part))

        for chunk in chunks:
            kept = kept + bytes(chunk) if kept else bytes(chunk)
            at = 0
            while len(kept) - at > frame_bytes:
                end = at + frame_bytes
                while end > at + 1 and kept[end] & 0xC0 == 0x80:
                    end -= 1
                shut(kept[at:end])
                at = end
            kept = kept[at:]
        if kept:
            shut(kept)
        return cls(blobs, units, chars, sizes)

    def frame(self, j: int) -> bytes:
        if self._open[0] != j:
            self._open = (j, zstandard.ZstdDecompressor().decompress(self.blobs[j]))
        return self._open[1]

    def place(self, k: int) -> tuple[int, int]:
        """Byte and character at which unit k begins (the end, where there
        are k units only); opens the frame that holds it."""
        if k >= self.units[-1]:
            return self.sizes[-1], self.chars[-1]
        j = bisect_right(self.units, k) - 1
        data = np.frombuffer(self.frame(j), np.uint8)
        begins = _begins(data, False)
        if len(begins) < self.units[j + 1] - self.units[j]:
            begins = np.concatenate(([0], begins))
        at = int(begins[k - self.units[j]])
        return self.sizes[j] + at, self.chars[j] + _characters(data[:at])

    def stream(self, start: int = 0, end: int | None = None):
        """The bytes from start to end, a frame at a time."""
        end = self.sizes[-1] if end is None else end
        j = max(0, bisect_right(self.sizes, start) - 1)
        while j < len(self.blobs) and self.sizes[j] < end:
            yield self.frame(j)[max(0, start - self.sizes[j]):end - self.sizes[j]]
            j += 1

    def find(self, mark: bytes, start: int) -> int:
        """First place of a mark from ``start`` on, also across frames."""
        carry, at = b"", start
        for chunk in self.stream(start):
            seen = carry + chunk
            hit = seen.find(mark)
            if hit >= 0:
                return at - len(carry) + hit
            at += len(chunk)
            carry = seen[-(len(mark) - 1):]
        raise ValueError("mark not found")

    def text(self) -> str:
        return b"".join(self.stream()).decode("utf-8")


def digest(chunks) -> str:
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def rearranged(source: Frames, form: str, cuts: tuple[int, int]):
    """Chunks of the new text; cuts in bytes."""
    spans = {"prefix": (0, cuts[0]), "middle": cuts, "suffix": (cuts[1], source.sizes[-1])}
    if form == "plain":
        yield from source.stream()
    for part in ORDER[form]:
        yield MARKS[part]
        yield from source.stream(*spans[part])


def rebuilt(changed: Frames, form: str):
    """Chunks of the first text, read from the new one alone."""
    if form == "plain":
        yield from changed.stream()
        return
    at, marks = 0, []
    for part in ORDER[form]:
        at = changed.find(MARKS[part], at)
        marks.append(at)
        at += len(MARKS[part])
    spans = {part: (m + len(MARKS[part]), e) for part, m, e in zip(ORDER[form], marks, [*marks[1:], changed.sizes[-1]], strict=True)}
    for part in ("prefix", "middle", "suffix"):
        yield from changed.stream(*spans[part])


def _stored(frame_bytes: int):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows = []
            for doc_id, marked, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                f = Frames.of([text.as_buffer()] if text.is_valid else [], frame_bytes, pack)
                rows.append({"doc_id": doc_id, "n": f.units[-1], "marked": marked, "frames": f.blobs, "units": f.units,
                             "chars": f.chars, "bytes": f.sizes})
            yield pa.RecordBatch.from_pylist(rows, schema=_STORE)
    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """doc_id, n (units), marked (holds a mark), frames and the counts before
    each frame and at the end."""
    held = F.lit(False)
    for mark in MARKS.values():
        held = held | F.contains("text", F.lit(mark.decode()))
    source = with_package(renamed(docs, doc_id=id_col, text=text_col)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("marked"), "text")
    return source.mapInArrow(_stored(frame_bytes), STORE)


def plan(stored: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """The store with form and the cuts in units. ``rate`` per cent of the
    documents change, ``spm`` per cent of these with the suffix first."""
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(hexes, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    cuts = [F.pmod(h[k], F.col("n") + 1) for k in range(2)]
    form = (F.when((F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate), "plain")
            .when(h[3] % 100 < spm, "spm").otherwise("psm"))
    return stored.withColumns({"form": form, "first_cut": F.least(*cuts), "second_cut": F.greatest(*cuts)})


OUTPUTS = {"output": "string", "restored": "string", "output_sha256": "string", "restored_sha256": "string"}


def _filled(outputs: tuple[str, ...], frame_bytes: int):
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    schema = pa.schema(fields + [(o, pa.string()) for o in outputs])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                source = Frames(r["frames"], r["units"], r["chars"], r["bytes"])
                row = {"doc_id": r["doc_id"], "n": r["n"], "form": r["form"]}
                (a, a_chars), (e, e_chars) = source.place(r["first_cut"]), source.place(r["second_cut"])
                if r["form"] != "plain":
                    row |= {"prefix_chars": a_chars, "middle_chars": e_chars - a_chars}
                changed = Frames.of(rearranged(source, r["form"], (a, e)), frame_bytes, pack)
                for o in outputs:
                    chunks = changed.stream() if o.startswith("output") else rebuilt(changed, r["form"])
                    row[o] = digest(chunks) if o.endswith("sha256") else b"".join(chunks).decode("utf-8")
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def fill_middle(planned: DataFrame, outputs: tuple[str, ...] = ("output",), frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (NULL where plain) and the
    wanted of OUTPUTS: the new text, the text rebuilt from it alone, or the
    digest of either as streamed from its frames."""
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"no such output: {sorted(unknown)}")
    cols = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
    return with_package(planned).select("doc_id", "n", "form", "first_cut", "second_cut", "frames", "units", "chars", "bytes").mapInArrow(
        _filled(tuple(outputs), frame_bytes), ", ".join([cols, *[f"{o} {OUTPUTS[o]}" for o in outputs]]))
