"""Best-fit packing of tokenized documents into sequences of bounded length.

Bounded-space online best fit: a task keeps at most ``open_bins`` open
sequences in a bitset keyed by their free space. A piece goes to the open
sequence that it leaves fullest; when none fits and the bound is reached,
the fullest open sequence is closed to make room for a new one. Pieces come
in runs of ``RUN``, the longest of a run first, which leaves less room
unused than any order by chance. Pieces of the full length are sequences of their own and never wait for a task. What
the tasks leave open is packed once more, whole sequences as items.

Scale: documents are tokenized where they are read; only a few numbers a
piece are shuffled (dealt by a hash of the document, so a hot source or a
group of copies spreads evenly). Memory a task: ``open_bins`` counters and
one Arrow batch.

Defined results: NULL text is empty; an empty text is one piece holding the
end id alone; a NULL id is kept as NULL; repeated rows are packed each on
its own; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import word_bpe
from tillroll.llm.common import renamed, with_package, written

RUN = 4096
BIN_BITS = 40  # sequence number = task number * 2^40 + number within the task


def _pieces(max_len: int, end_id: int, path: str, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        vocab = word_bpe.load(path)
        for b in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            ids_out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = vocab.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at:at + 4 * max_len]
                    for name, v in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        rows[name].append(v)
                    if with_ids:
                        ids_out.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32())]
            cols += [pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            names = list(rows)
            if with_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


class OpenBins:
    """At most ``limit`` open bins of one capacity, found by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.mask = 0  # bit f is set when an open bin has f free places
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        return number

    def put(self, size: int) -> tuple[int, int]:
        """(bin, place in it) for an item of ``size``, 1..capacity."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:  # the fullest closes
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.open -= 1
            free, number = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.mask |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free

    def still_open(self) -> set[int]:
        return {n for bins in self.by_free.values() for n in bins}


def _pack(capacity: int, open_bins: int):
    """Rows (task, size, key...) of one task -> bin number and place."""
    def run(batches):
        bins = OpenBins(capacity, open_bins)
        task = None
        for b in batches:
            if not b.num_rows:
                continue
            if task is None:
                from pyspark import TaskContext
                task = TaskContext.get().partitionId() << BIN_BITS
            sizes = b.column("length").to_numpy()
            placed = [None] * len(sizes)
            for a in range(0, len(sizes), RUN):
                for i in (a + np.argsort(-sizes[a:a + RUN], kind="stable")).tolist():
                    placed[i] = bins.put(int(sizes[i]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([task + n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                [*b.schema.names, "sequence_id", "offset"])
    return run


def _best_fit(items: DataFrame, key: list[str], tasks: int, capacity: int, open_bins: int) -> DataFrame:
    """Deal items over ``tasks`` by a hash of their key, in an order fixed by
    the data, so that a repeated task places them alike."""
    dealt = (items.withColumn("_deal", F.xxhash64(*key)).repartition(tasks, "_deal")
             .sortWithinPartitions("_deal", *key, "length").drop("_deal"))
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(_pack(capacity, open_bins), schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         max_len: int = 4096, open_bins: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ``ids`` if asked for)."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    source = with_package(renamed(docs, doc_id=id_col, text=text_col))
    pieces = written(source.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pieces(max_len, end_id, tokenizer, with_ids), T.StructType(fields)), "pack-pieces")
    full = F.col("length") == max_len
    # sequences are numbered by task: whole pieces below zero, packed ones from zero on
    whole = (pieces.filter(full).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
             .withColumn("offset", F.lit(0).cast("long")))
    total = pieces.filter(~full).agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(1, min(20_000, math.ceil(total / (max_len * 4096))))
    first = written(_best_fit(pieces.filter(~full), ["doc_id", "piece", "start"], tasks, max_len, open_bins), "pack-first")
    # sequences that a task left half empty or more can share one: pack them as items
    used = first.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    loose = used.filter(F.col("length") <= max_len // 2).withColumnRenamed("sequence_id", "_old")
    n_loose = loose.count()
    again = _best_fit(loose, ["_old"], max(1, math.ceil(n_loose / 50_000)), max_len, open_bins)
    moved = again.toDF("_old", "_used", "_new", "_base").drop("_used")
    shift = tasks + 1 << BIN_BITS  # beyond every number of the first round
    packed = (first.join(moved, F.col("sequence_id") == F.col("_old"), "left")
              .withColumn("offset", F.col("offset") + F.coalesce("_base", F.lit(0)))
              .withColumn("sequence_id", F.coalesce(F.col("_new") + F.lit(shift), "sequence_id"))
              .drop("_old", "_new", "_base"))
    return whole.unionByName(packed)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: sequence_id,
    n_tokens, ids, and where each document starts in it."""
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    g = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("_p"))
    return g.select("sequence_id", F.expr("aggregate(_p, 0L, (a, x) -> a + x.length)").alias("n_tokens"),
                    F.flatten(F.col("_p.ids")).alias("ids"),
                    F.expr("transform(_p, x -> struct(x.doc_id, x.piece, x.offset))").alias("parts"))
