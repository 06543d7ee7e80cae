"""SimHash near-duplicates by pigeonhole blocks.

1. Fingerprints. Every whole text's word shingles, repeats included, are
   hashed (XXH64, seed 42); a fingerprint bit is 1 if it is set in over half
   of the hashes. Words are runs of characters other than blank and
   U+0009-U+000D with A-Z lower-cased; a text of fewer words than a shingle
   has is one shingle, one without words has the fingerprint zero.
2. Blocks. The 64 bits are split into ``blocks`` blocks. Two fingerprints
   that differ in at most ``distance`` bits agree in all but ``distance``
   blocks, so they share one of the C(blocks, distance) choices of the
   remaining blocks: 35 keys of about 27 bits for 7 blocks and distance 4.
3. Leaders. Each key's members are compared with its smallest fingerprint;
   the links found give first classes.
4. Verification. Keys that hold several classes join with themselves; the
   Hamming distance is part of the join's condition, and two of one class
   are not compared again. Members beyond ``PART`` of a key meet in parts.
5. Classes: connected components of fingerprints; a class takes its
   smallest doc_id.

Nothing is capped. Equal fingerprints are one row from step 2 on, so a group
of copies costs as much as one document, and a group of near copies is held
together by its leaders before any pair is looked at.

Scale: texts are not shuffled; a fingerprint sends 35 rows of some 20 bytes.
The way back from fingerprints to documents is salted ``SALT``-fold, for a
group of copies may hold a third of all rows.

Defined results: a NULL text counts as empty. A NULL id keeps its row with
its fingerprint and a NULL component_id and links with nothing; rows with
equal ids are one document that has the links of each text. Repeated rows
stay. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import dropped, renamed, with_package, written
from tillroll.llm.components import components

SEED = 42
PART = 4096  # members of a key that one left-hand part holds
SALT = 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SLICE = 1 << 16  # shingles whose bits are counted together


def shingle_hashes(text: bytes, words: int):
    """Arrays of the hashes of all shingles of a text, in order."""
    joined = b" ".join(_WORD.findall(text.translate(_LOWER)))
    if not joined:
        return
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined)).tolist()
    view, hashed = memoryview(joined), xxhash.xxh64_intdigest
    if len(ends) < words:
        yield np.array([hashed(joined, SEED)], np.uint64)
        return
    starts = [0] + [e + 1 for e in ends[:len(ends) - words]]
    ends = ends[words - 1:]
    for at in range(0, len(starts), _SLICE):
        yield np.array([hashed(view[a:e], SEED) for a, e in zip(starts[at:at + _SLICE], ends[at:at + _SLICE], strict=True)], np.uint64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """64 bits, bit i set if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches):
        for b in batches:
            found = [fingerprint(bytes(t.as_buffer()), words) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) per row."""
    source = with_package(renamed(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bits of each choice of blocks - distance blocks, as signed longs."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(bits, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(fps: DataFrame, distance: int = 4, blocks: int = 7) -> tuple[DataFrame, DataFrame]:
    """Links between distinct fingerprints (column fp): those with a key's
    leader, and those between different classes of the first. Together they
    connect whatever all pairs within ``distance`` connect."""
    if not 0 < distance < blocks <= 64:
        raise ValueError("blocks must exceed distance")
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(blocks, distance)])
    cells = fps.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.col("mask").bitwiseAND(F.col("fp")).alias("block"))
    several = cells.groupBy("k", "block").agg(F.min("fp").alias("leader"), F.max("fp").alias("last")).filter("leader < last").drop("last")
    cells = written(cells.join(several, ["k", "block"]), "simhash-cells")
    star = written(cells.filter(_near("fp", "leader", distance)).filter("fp <> leader").select("fp", "leader").distinct(), "simhash-star")
    first = written(components(star, "fp", "leader"), "simhash-first")
    classed = cells.select("fp", "k", "block").join(first.withColumnRenamed("id", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp")).drop("component")
    mixed = (classed.groupBy("k", "block").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"))
             .filter("lo < hi").select("k", "block", F.ceil(F.col("m") / PART).cast("int").alias("parts")))
    rest = written(classed.join(mixed, ["k", "block"]), "simhash-rest")
    left = rest.select("k", "block", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), F.col("fp").alias("a"), F.col("c").alias("ca"))
    right = rest.select("k", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("fp").alias("b"), F.col("c").alias("cb"))
    found = (left.join(right.hint("merge"), (left["k"] == right["k"]) & (left["block"] == right["block"]) & (left["part"] == right["part"])
                       & (F.col("ca") < F.col("cb")) & _near("a", "b", distance)).select("a", "b").distinct())
    found = written(found, "simhash-links")
    dropped(cells, first, rest)
    return star.toDF("a", "b"), found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4,
                    blocks: int = 7) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id per row."""
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    known = rows.filter("doc_id IS NOT NULL")
    fps = written(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fingerprints")
    star, found = links(fps, distance, blocks)
    # several texts under one id are one document
    ids = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").drop("z")
    same = known.join(ids, "doc_id").select("a", F.col("fp").alias("b")).filter("a <> b").distinct()
    roots = written(components(star.union(found).union(same), "a", "b"), "simhash-roots")
    member = written(roots.withColumnRenamed("id", "fp").join(fps, "fp"), "simhash-members")
    least = member.groupBy("component").agg(F.min("least").alias("low"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int")
    lows = member.select("fp", "component", salt.alias("salt")).join(least.select("component", "low", every), ["component", "salt"]).select("fp", "low")
    named = fps.join(lows, "fp", "left").select("fp", F.coalesce("low", "least").alias("component_id"), every)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    out = written(salted.join(named, ["fp", "salt"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "simhash-result")
    dropped(rows, fps, found, roots, member)
    return out
