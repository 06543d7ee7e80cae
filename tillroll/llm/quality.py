"""Quality scores by compression: how much better does a text compress with
a dictionary of good texts than with one of bad texts?

Two zstandard dictionaries are built from good and bad labelled texts. A
whole text is compressed in windows of ``window`` bytes with each (windows,
so that a long text's own content does not drown the dictionary). The
normalised difference of the two sizes, with the normalised sizes themselves
(texts that repeat themselves shrink to nothing under either dictionary),
goes through a logistic calibration fitted on other labelled rows than the
dictionaries.

Learning uses a bounded sample: ``rows_per_class`` labelled rows of either
class, chosen by a hash of the id, each text up to ``sample_chars``
characters of it at evenly spaced places. Every text is scored whole. Labels
of a fold given by crc32(id as text) mod ``folds`` = 0 are never read.

Scale: excerpts are cut where the documents are read (a broadcast join on at
most 2 x ``rows_per_class`` ids) and meet in one task, at most 48 MB of
text; the driver gets two dictionaries and a few numbers. Scoring is a map
over the documents without a shuffle.

Defined results: NULL text scores as empty; an empty text gets the share of
good labels; without labels of both classes every score is that share (0.5
without any); NULL and repeated ids are scored row by row; labels that are
NULL, neither 0 nor 1, or contradict each other are not learned; other
columns are ignored.
"""

from __future__ import annotations

import dataclasses
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import remainder, renamed, with_package

DICTIONARY = 96 * 1024
LEVEL = 3


@dataclasses.dataclass
class Model:
    good: bytes
    bad: bytes
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float
    window: int

    def key(self) -> str:
        return hashlib.sha256(self.good + b"|" + self.bad).hexdigest()


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained where the sample allows it, else the texts themselves."""
    if len(samples) >= 100:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes under the two dictionaries."""

    def __init__(self, model: Model):
        self.window = model.window
        self.compress = [self._compressor(model.good), self._compressor(model.bad)]

    @staticmethod
    def _compressor(data: bytes):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                        write_dict_id=False).compress

    def features(self, text: str) -> tuple[float, ...]:
        return self.measured(text.encode("utf-8", "surrogatepass"))

    def measured(self, raw: bytes) -> tuple[float, ...]:
        good, bad = ([len(c(raw[a:a + self.window])) for a in range(0, len(raw), self.window)] for c in self.compress)
        # frames of some bytes each are not the text's
        g, b, n = max(1, sum(good) - 8 * len(good)), max(1, sum(bad) - 8 * len(bad)), len(raw)
        diff = (b - g) / max(g, b)
        return diff, g / n, b / n, diff * abs(diff), (g / n) ** 2, 1 / (1 + n / 200)


_READY: dict[str, Sizes] = {}


def sizes(model: Model) -> Sizes:
    key = model.key()
    if key not in _READY:
        _READY.clear()
        _READY[key] = Sizes(model)
    return _READY[key]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression (intercept last) by Newton's steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1e-2)
    ridge[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          folds: int = 5, rows_per_class: int = 1500, sample_chars: int = 16_000, window: int = 2048) -> Model:
    marked = renamed(labels, id=id_col, y=label_col).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    marked = marked.filter(remainder("id", folds) != 0).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    counts = dict(marked.groupBy("y").count().collect())
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    empty = Model(b"", b"", np.zeros(6), np.ones(6), np.zeros(7), prior, window)
    if len(counts) < 2:
        return empty
    chosen = None
    for y in (0, 1):
        part = marked.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = with_package(renamed(docs, id=id_col, text=text_col)).filter("text IS NOT NULL AND text <> ''")
    # of a long text up to ``sample_chars`` characters from eight evenly spaced places
    part, n = sample_chars // 8, F.length("text")
    places = [F.substring("text", F.floor(F.lit(k / 7) * (n - part)).cast("int") + 1, F.lit(part)) for k in range(8)]
    excerpt = F.when(n <= sample_chars, F.col("text")).otherwise(F.concat(*places))
    rows = (texts.join(F.broadcast(chosen), "id").select(F.col("id").cast("long").alias("id"), excerpt.alias("text"), F.col("y").cast("int").alias("y"))
            .groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y")))
    # the sample is bounded, so one task takes it
    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_trained(empty), "good binary, bad binary, center array<double>, spread array<double>, weights array<double>").collect()
    if not found:
        return empty
    r = found[0]
    return dataclasses.replace(empty, good=bytes(r["good"]), bad=bytes(r["bad"]), center=np.array(r["center"]), spread=np.array(r["spread"]),
                               weights=np.array(r["weights"]))


def _trained(empty: Model):
    """Rows (id, text, y) of the sample -> the model, if both classes have a
    text."""
    schema = pa.schema([("good", pa.binary()), ("bad", pa.binary()), ("center", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64())),
                        ("weights", pa.list_(pa.float64()))])

    def run(table):
        # texts stay in the Arrow table: rows are places in it, in order of id
        text, marks = table.column("text").combine_chunks(), table.column("y").to_numpy()
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        raw = lambda i: text[int(i)].as_buffer().to_pybytes()
        # every other row, by class, builds the dictionaries; the others calibrate
        mine = {y: order[marks[order] == y] for y in (0, 1)}
        if not all(len(mine[y]) for y in (0, 1)):
            return schema.empty_table()
        window, prior = empty.window, empty.prior

        def pieces(y):
            return [t[a:a + window] for t in map(raw, mine[y][::2]) for a in range(0, len(t), window)]
        model = dataclasses.replace(empty, good=_dictionary(pieces(1)), bad=_dictionary(pieces(0)))
        kept = np.concatenate([mine[y][1::2] if len(mine[y]) > 1 else mine[y] for y in (0, 1)])
        measure = Sizes(model).measured
        x, y = np.array([measure(raw(i)) for i in kept]), marks[kept].astype(float)
        center, spread = x.mean(0), x.std(0) + 1e-9
        # the sample has as many of either class as it can; weights restore the share of all labelled rows
        weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
        weights = _logistic((x - center) / spread, y, weight)
        return pa.Table.from_pylist([{"good": model.good, "bad": model.bad, "center": center.tolist(), "spread": spread.tolist(),
                                      "weights": weights.tolist()}], schema=schema)
    return run


def _score(model: Model):
    def run(batches):
        measure = sizes(model).features if model.good else None
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            scores = np.full(len(texts), model.prior)
            full = [i for i, t in enumerate(texts) if t] if measure else []
            if full:
                x = (np.array([measure(texts[i]) for i in full]) - model.center) / model.spread
                scores[full] = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row."""
    source = with_package(renamed(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(_score(model), "doc_id long, score double")


def keep(docs: DataFrame, model: Model, at_least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose text scores at least ``at_least``."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        measure = sizes(model).features if model.good else None
        for b in batches:
            good = []
            for t in b.column(at):
                t = t.as_py()
                if not t or measure is None:
                    good.append(model.prior >= at_least)
                    continue
                z = ((np.array(measure(t)) - model.center) / model.spread) @ model.weights[:-1] + model.weights[-1]
                good.append(bool(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= at_least))
            yield b.filter(pa.array(good, pa.bool_()))
    return with_package(docs).mapInArrow(run, docs.schema)
