"""Similarity join of documents on word shingles by a token-group matrix.

Documents whose shingle sets have a Jaccard similarity of at least
``percent`` / 100 are linked; the result is each document's component.

1. Sets. Every whole text becomes its distinct five-word shingles. Equal
   sets are one class, and only class representatives go on, under a key of
   the class's own (several texts under one id are several classes).
2. Groups. Representatives that share a pair of min-hashes meet their key's
   smallest id; the exact similarity decides who joins that leader's star,
   so every member of a star is linked with its leader. The others stay
   together as similar documents, not known to be linked, in groups of about
   ``PART`` of those that met the same leader; the rest are alone.
3. Matrix. Tokens (shingles) are ordered from rare to frequent by a
   count-min sketch of all documents. Sets that reach the threshold share a
   token among their first |x| - ceil(t|x|) + 1, so the matrix of these
   tokens against groups finds every group that may hold a partner of a
   query: (query, group) rows, however many of the group's members hold the
   token. A star is not asked for its own members.
4. Bound. The distance of two sets is bounded below by their parity bitmaps,
   which a group of similar documents keeps of each member, a star of its
   leader. Jaccard distance is a metric, so a star whose leader is farther
   than 2 (1 - t) away cannot hold a partner. Pairs that remain are compared
   exactly.
5. Opening. For a query not linked with a star's leader the overlap with the
   token union of each part of the star is counted; only parts that reach
   the needed overlap are opened and their members verified.

All bounds are exact; nothing is capped or sampled.

Scale: shuffled are prefix tokens (about a fifth of all), heads of some
hundred bytes a document, and the sets of documents in candidate pairs; the
texts are not shuffled. A large group of copies is one class, one of near
copies a star: neither is paired within itself; documents that are similar
but not linked meet group by group, not as rows of pairs. A frequent
passage stands last in the token order, so only documents made up of little
else look it up. Sketch and id filter have a fixed size (16 MB, 1 MB).

Defined results: without words or text a document has an empty set and no
link; one to four words are one shingle. A NULL id gets a NULL component and
links with nothing; rows with equal ids are one document that has the links
of each. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm import shingles
from tillroll.llm.common import dropped, renamed, with_package, written
from tillroll.llm.components import components

SKETCH_BITS, FILTER_BITS, SEGMENTS = 22, 23, 16
KEYS = 4   # pairs of min-hashes a document offers for grouping
PART = 64  # members of a group of similar documents, and of a part of a star
_MINHASH = np.array([0x8F14E45FCEEA167B, 0xC9F0F895FB98AB91, 0x45C48CCE2E2D7FBD, 0xD3D9446802A44259,
                     0x6512BD43D9CAA6E1, 0xC20AD4D76FE97759, 0xC51CE410C124A10F, 0xAAB3238922BCC25B], np.uint64)


def _sets(batch: pa.RecordBatch, column: int):
    """(row, ascending distinct shingles) of a batch of texts."""
    for first, hashes, counts in shingles.words(batch.column(column)):
        flat, sizes = shingles.shingle_sets(hashes, counts)
        at = 0
        for i, n in enumerate(sizes.tolist()):
            yield first + i, flat[at:at + n]
            at += n


def _slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (shingles.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int64)


# parity bitmaps: bit h(x) flips for every token; its weight bounds distances

def parity(tokens: np.ndarray) -> bytes:
    bits = max(64, 1 << int(4 * len(tokens) - 1).bit_length())
    flips = np.bincount((shingles.mix(tokens + np.uint64(77)) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x


def least_differences(a: bytes, others: list[bytes]) -> np.ndarray:
    """Lower bounds of the sizes of the symmetric differences of one set
    with others. Of two bitmaps the longer one is folded."""
    x, out = np.frombuffer(a, np.uint8), np.empty(len(others), np.int64)
    sizes = np.array([len(o) for o in others])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        y = np.frombuffer(b"".join(others[i] for i in at), np.uint8).reshape(len(at), size)
        if size > len(x):
            y = np.bitwise_xor.reduce(y.reshape(len(at), -1, len(x)), axis=1)
        out[at] = np.bitwise_count(y ^ _folded(x, size)).sum(axis=1)
    return out


# sketches of a fixed size, summed by segments

def _emit_sketch(counts: np.ndarray) -> list[bytes]:
    return [_packed(p) for p in np.split(counts, SEGMENTS)]


def _packed(counts: np.ndarray) -> bytes:
    """By byte planes: nearly all high bytes are 0."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.view(np.uint8).reshape(len(counts), -1).T).tobytes())


def _unpacked(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _add_up(kind):
    def run(key, rows):
        total = None
        for chunk in rows.column("blob"):
            part = _unpacked(chunk.as_py(), kind)
            total = part.copy() if total is None else (total | part if kind == np.uint8 else total + part)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([_packed(total)], pa.binary())})
    return run


def _collect_sketch(parts: DataFrame, kind) -> dict[int, bytes]:
    """Packed sums by segment: SEGMENTS rows of at most a fixed size."""
    return dict(parts.groupBy("segment").applyInArrow(_add_up(kind), "segment int, blob binary").collect())


def _sketch(segments: dict[int, bytes], kind, size: int) -> np.ndarray:
    empty = np.zeros(size // SEGMENTS, kind)
    return np.concatenate([_unpacked(segments[k], kind) if k in segments else empty for k in range(SEGMENTS)])


HEAD = "doc_id long, n long, d1 long, d2 long, keys array<long>, bits binary, segment int, blob binary"
_HEAD = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                   ("keys", pa.list_(pa.int64())), ("bits", pa.binary()), ("segment", pa.int32()), ("blob", pa.binary())])


def _digest(s: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join: either side grows with the corpus, and the hashed
    relation of a broadcast join is built on the driver."""
    return left.join(right.hint("merge"), on, how)


def _heads(batches):
    """A head per document and, at the end, the task's part of the sketch."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    some = False
    for b in batches:
        rows, ids = [], b.column(0).to_pylist()
        for i, s in _sets(b, 1):
            some = True
            row = {"doc_id": ids[i], "n": len(s)}
            if len(s):
                digest = _digest(s)
                low = [shingles.mix(s * m).min() for m in _MINHASH]
                keys = [int(np.int64(np.uint64(low[2 * k]) ^ shingles.mix(np.array([low[2 * k + 1] + np.uint64(k)]))[0])) for k in range(KEYS)]
                row |= {"d1": digest[0], "d2": digest[1], "keys": keys, "bits": parity(s)}
                np.add.at(counts, _slots(s, SKETCH_BITS), 1)
            rows.append(row)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_HEAD)
    if some:
        for k, blob in enumerate(_emit_sketch(counts)):
            yield pa.RecordBatch.from_pylist([{"segment": k, "blob": blob}], schema=_HEAD)


def _prefixes(sketch, percent: int):
    """The rarest tokens of each set, as many as the threshold needs."""
    def run(batches):
        counts = _sketch(sketch.value, np.uint32, 1 << SKETCH_BITS)
        for b in batches:
            ids = b.column(0)
            rows, tokens, sizes, digests = [], [], [], []
            for i, s in _sets(b, 1):
                if not len(s):
                    continue
                digests.append(_digest(s)[0])
                most = len(s) - -(-percent * len(s) // 100) + 1
                order = np.lexsort((s, counts[_slots(s, SKETCH_BITS)]))[:most]
                rows.append(i)
                tokens.append(s[order])
                sizes.append(most)
            if rows:
                flat = pa.array(np.concatenate(tokens).view(np.int64), pa.int64())
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(digests, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                                                 ["of", "d1", "tokens"])
    return run


def _filter_parts(batches):
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        bits[_slots(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), FILTER_BITS)] = True
    packed = np.packbits(bits)
    for k, blob in enumerate(_emit_sketch(packed)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["segment", "blob"])


def _sets_of(wanted):
    """Shingle sets of the documents whose id passes the filter."""
    def run(batches):
        bits = np.unpackbits(_sketch(wanted.value, np.uint8, (1 << FILTER_BITS) // 8)).astype(bool)
        for b in batches:
            ids = b.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            hit = bits[_slots(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), FILTER_BITS)] & known
            if not hit.any():
                continue
            part = b.filter(pa.array(hit))
            rows, blobs, digests = [], [], []
            for i, s in _sets(part, 1):
                rows.append(i)
                blobs.append(s.tobytes())
                digests.append(_digest(s)[0])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(digests, pa.int64()), pa.array(blobs, pa.binary())],
                                             ["of", "d1", "tokens"])
    return run


def _near_bitmaps(percent: int):
    """Rows (id, n, bits, own, head group: several, ids, ns, maps) -> the
    pairs (id, head) that the bound leaves. Within a query's own group only
    smaller ids are its partners."""
    def run(batches):
        t = percent / 100
        for b in batches:
            left, right = [], []
            for r in b.to_pylist():
                far = min(1.0, (2 if r["several"] else 1) * (1 - t))  # largest distance that matters
                room = (r["n"] + np.array(r["ns"])) * far / (2 - far) + 1e-9
                near = np.flatnonzero(least_differences(r["bits"], r["maps"]) <= room)
                heads = [r["ids"][i] for i in near]
                heads = [h for h in heads if (h < r["id"] if r["own"] else h != r["id"])]
                left += [r["id"]] * len(heads)
                right += heads
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["id", "head"])
    return run


def _overlap(percent: int, both: bool):
    """Rows (id, head, tokens, head_tokens) that reach the threshold, or,
    against a union of sets, the overlap that any partner in it would need."""
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("tokens").to_pylist(), b.column("head_tokens").to_pylist(), strict=True):
                q, g = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(g, q), len(g) - 1)
                common = int((g[at] == q).sum())
                keep.append(100 * common >= percent * (len(q) + len(g) - common if both else len(q)))
            yield b.drop_columns(["tokens", "head_tokens"]).filter(pa.array(keep, pa.bool_()))
    return run


def _unions(key, rows):
    """Token union of one part of a group (at most about PART members)."""
    tokens = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("tokens")]))
    return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
                     "head_tokens": pa.array([tokens.tobytes()], pa.binary())})


class Join:
    """One run of the join over (id, text)."""

    def __init__(self, docs: DataFrame, percent: int, reps: DataFrame | None = None):
        self.spark, self.docs, self.percent, self.reps = docs.sparkSession, docs, percent, reps

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, tokens) of the given classes, read from the document that
        stands for each."""
        held = _met(self.reps.select("id", "of", "d1"), ids, "id", "left_semi")
        wanted = _collect_sketch(held.select("of").mapInArrow(_filter_parts, "segment int, blob binary"), np.uint8)
        sent = self.spark.sparkContext.broadcast(wanted)
        found = written(_met(self.docs.mapInArrow(_sets_of(sent), "of long, d1 long, tokens binary"), held, ["of", "d1"])
                        .select("id", "tokens").dropDuplicates(["id"]), "join-sets")
        sent.destroy()
        return found

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (id, head) that are linked."""
        rows = (_met(_met(pairs, sets, "id"), sets.toDF("head", "head_tokens"), "head")
                .select("id", "head", "tokens", "head_tokens"))
        return rows.mapInArrow(_overlap(self.percent, True), "id long, head long")

    def bounded(self, rows: DataFrame) -> DataFrame:
        """Pairs that the bitmaps cannot rule out (see ``_near_bitmaps``)."""
        return rows.mapInArrow(_near_bitmaps(self.percent), "id long, head long")

    def bounded_pairs(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """The same for single pairs (id, head)."""
        heads = reps.select(F.col("id").alias("head"), F.array("id").alias("ids"), F.array("n").alias("ns"), F.array("bits").alias("maps"))
        return self.bounded(_met(_met(pairs, reps.select("id", "n", "bits"), "id"), heads, "head")
                            .withColumns({"several": F.lit(False), "own": F.lit(False)}).drop("head"))

    @staticmethod
    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("id", "head")).alias("id")).distinct()


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id per row."""
    source = with_package(renamed(docs, id=id_col, text=text_col)).select(F.col("id").cast("long"), "text")
    spark = docs.sparkSession
    heads = written(source.mapInArrow(_heads, HEAD), "join-heads")
    rows = heads.filter("segment IS NULL")
    sketch = spark.sparkContext.broadcast(_collect_sketch(heads.filter("segment IS NOT NULL").select("segment", "blob"), np.uint32))

    sizes_of = written(rows.select("doc_id", "n"), "join-sizes")

    # classes of equal sets
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("of"))
    # a class goes by its smallest doc_id; of several texts under that id all but one class go by a hash of the set
    first = classes.groupBy("of").agg(F.min(F.struct("d1", "d2", "n")).alias("first"))
    own = F.struct("d1", "d2", "n") == F.col("first")
    by_hash = F.lit(-(1 << 63)) + F.pmod(F.xxhash64("d1", "d2", "n"), F.lit(1 << 62))
    classes = _met(classes, first, "of").select("d1", "d2", "n", "of", F.when(own, F.col("of")).otherwise(by_hash).alias("rep"))
    member = written(_met(full, classes, ["d1", "d2", "n"]).select("doc_id", "n", "rep", "of", "d1", *[
        F.when(F.col("doc_id") == F.col("of"), F.col(c)).alias(c) for c in ("keys", "bits")]), "join-members")
    reps = written(member.filter("doc_id = of").select(F.col("rep").alias("id"), "of", "d1", "n", "keys", "bits").dropDuplicates(["id"]), "join-reps")
    job = Join(source, percent, reps)
    dropped(heads)

    # groups around leaders
    keyed = reps.select("id", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head < last").drop("last")
    offered = written(_met(keyed, leaders, "key").groupBy("id").agg(F.min("head").alias("head")), "join-offers")
    tried = written(job.bounded_pairs(offered.filter("id <> head"), reps), "join-tried")
    sets = job.sets(job.ends(tried))
    star = written(job.verified(tried, sets), "join-stars")
    dropped(sets, tried)  # tables go as soon as no step reads them: sets take some kilobytes a document
    # a star's number is its leader; a loose group of similar documents has a number by hash
    led = star.select("head").distinct().withColumn("leads", F.lit(True))
    alone = _met(_met(offered, star.select("id"), "id", "left_anti"), led.select(F.col("head").alias("id")), "id", "left_anti")
    met_at = alone.groupBy("head").agg(F.count("*").alias("met"))
    similar = (_met(alone, met_at, "head").select("id", (-1 - F.pmod(F.xxhash64("head", F.pmod(F.xxhash64("id"), F.ceil(F.col("met") / PART))), F.lit(1 << 62))).alias("s")))
    grouped = written(_met(_met(reps.select("id", "of", "d1", "n"), star, "id", "left"), similar, "id", "left")
                      .select("of", "d1", "id", "n", F.coalesce("head", "s", "id").alias("g"), (F.col("head").isNull() & F.col("s").isNotNull()).alias("loose")), "join-groups")
    dropped(offered)

    # the matrix of rare tokens against groups
    prefix = source.filter("id IS NOT NULL").mapInArrow(_prefixes(sketch, percent), "of long, d1 long, tokens array<long>")
    matrix = written(_met(prefix, grouped, ["of", "d1"]).select("id", "n", "g", "loose", "tokens"), "join-matrix")
    sketch.destroy()
    cells = matrix.select("id", "n", "g", "loose", F.explode("tokens").alias("token"))
    # one shuffle of the cells: counting tokens apart from them would write as much again
    of_token = Window.partitionBy("token")
    cells = (cells.withColumns({"lo": F.min("g").over(of_token), "hi": F.max("g").over(of_token), "a": F.min("id").over(of_token),
                                "b": F.max("id").over(of_token), "any": F.max("loose").over(of_token)})
             .filter("lo < hi OR (any AND a < b)").select("token", "id", "n", "g", "loose"))
    cells = written(cells, "join-cells")
    dropped(matrix)
    held = cells.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumnRenamed("g", "head")
    met = (_met(cells, held, "token").filter("g > head OR (g = head AND loose)").filter(f"100 * most >= {percent} * n AND {percent} * least <= 100 * n")
           .select("id", "head").distinct())
    met = written(met, "join-met")
    dropped(cells)
    sizes = grouped.groupBy("g").agg(F.count("*").alias("members"), F.max(F.when(F.col("id") != F.col("g"), 1).otherwise(0)).alias("others"), F.max("loose").alias("loose")).filter("NOT loose")
    # a star shows its leader, any other group all its members
    heads_met = met.select(F.col("head").alias("g")).distinct()
    shown = (_met(grouped.filter("loose").select("g", "id"), heads_met, "g", "left_semi")
             .union(_met(heads_met, grouped.filter("loose").select("g").distinct(), "g", "left_anti").select("g", F.col("g").alias("id"))))
    shown = _met(shown, reps.select("id", "n", "bits"), "id").groupBy("g").agg(F.collect_list(F.struct("id", "n", "bits")).alias("m"))
    shown = (_met(shown, sizes.select("g", (F.col("others") == 1).alias("several")), "g", "left")
             .select(F.col("g").alias("head"), F.coalesce("several", F.lit(False)).alias("several"), F.col("m.id").alias("ids"), F.col("m.n").alias("ns"), F.col("m.bits").alias("maps")))
    asked = _met(_met(_met(met, grouped.select("id", "g"), "id"), reps.select("id", "n", "bits"), "id"), shown, "head").select(
        "id", "n", "bits", (F.col("g") == F.col("head")).alias("own"), "several", "ids", "ns", "maps")
    near = written(job.bounded(asked).distinct(), "join-near")

    # leaders first, then the parts of groups that may hold a partner
    sets = job.sets(job.ends(near))
    linked = written(job.verified(near, sets), "join-linked")
    dropped(sets, met)
    parted = (_met(grouped, sizes.filter("others = 1"), "g")
              .select(F.col("g").alias("head"), F.col("id").alias("member"),
                      F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / PART)).cast("long").alias("part")))
    waiting = written(_met(_met(near, linked, ["id", "head"], "left_anti"), sizes.filter("others = 1").select(F.col("g").alias("head")), "head", "left_semi"),
                      "join-waiting")
    links = star.union(linked)
    if not waiting.isEmpty():
        inside = _met(parted, waiting.select("head").distinct(), "head", "left_semi")
        inside = written(inside, "join-inside")
        sets = job.sets(inside.select(F.col("member").alias("id")).union(waiting.select("id")).distinct())
        unions = (_met(inside, sets.withColumnRenamed("id", "member"), "member").groupBy("head", "part")
                  .applyInArrow(_unions, "g long, part long, head_tokens binary"))
        asked = (_met(_met(waiting, unions.withColumnRenamed("g", "head"), "head"), sets, "id")
                 .select("id", "head", "part", "tokens", "head_tokens"))
        opened = asked.mapInArrow(_overlap(percent, False), "id long, head long, part long")
        pairs = _met(opened, inside, ["head", "part"]).select("id", F.col("member").alias("head")).filter("id <> head").distinct()
        pairs = written(job.bounded_pairs(pairs, reps), "join-opened")
        links = links.union(written(job.verified(pairs, sets), "join-found"))
        dropped(sets, inside, pairs)
    roots = components(links, "id", "head")
    # rows with one id and several texts link their classes
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("doc_id", "a")
    if not twice.isEmpty():
        roots = components(links.union(_met(member.select("doc_id", "rep"), twice, "doc_id").select("a", "rep")), "id", "head")
    roots = written(roots, "join-roots")
    # a component's number is the smallest doc_id of its classes
    named = _met(reps.select("id", "of"), roots, "id", "left").withColumn("component", F.coalesce("component", "id"))
    low = named.groupBy("component").agg(F.min("of").alias("low"))
    of_class = _met(named, low, "component").select(F.col("id").alias("rep"), "low")
    found = _met(member.select("doc_id", "rep"), of_class, "rep").groupBy("doc_id").agg(F.min("low").alias("root"))
    out = written(_met(sizes_of, found, "doc_id", "left")
                  .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")), "join-result")
    dropped(member, reps, roots, sizes_of, grouped, near, linked, star, waiting)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows, all columns, of the document with the smallest id of each
    component; of rows with one id the first by text. Documents without
    words and rows with a NULL id stay."""
    found = ngram_components(docs, id_col, text_col, percent)
    at = F.col(f"`{id_col}`")
    kept = docs.join(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), at == F.col("_gone"), "left_anti")
    twice = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_twice")).count().filter("count > 1").drop("count")
    if twice.isEmpty():
        return kept
    first = Window.partitionBy(at).orderBy(F.col(f"`{text_col}`"))
    once = kept.join(twice, at == F.col("_twice"), "left_semi").withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row")
    return kept.join(twice, at == F.col("_twice"), "left_anti").unionByName(once)
