"""Exact top-k search by inner product, term at a time.

Vectors become integer sparse rows: per component (term) the non-zero
weights. Candidates are cut into blocks of rows that hold a posting list per
term (positions and weights); a task takes one block of queries and one
block of candidates, scatters each query term's weighted postings into a
dense array of scores, selects each query's k best by partition selection,
and Spark merges the blocks' lists. Every candidate is scored; nothing is
approximated.

Scale: the stated queries meet all rows in blocks: a candidate block is sent
once per block of queries, as one binary row. Score arrays are
``QUERY_STEP`` x block, whatever the table. A common vector only makes ties,
which go to the smaller id.

Defined results: rows with a NULL id, a NULL vector, or NULL or non-finite
components take no part; a shorter vector counts as padded by zeros; rows
with the query's own id are not candidates; an empty table gives no rows;
other input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import renamed, with_package, written

QUERY_STEP = 64  # queries whose score arrays are open at once
BLOCK = 4096     # candidates in a block: with QUERY_STEP, 1 to 2 MB of scores




def _pack(key, table):
    block = key[0].as_py()
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    ids = table.column("id").to_numpy()[order]
    vecs = table.column("vec").to_pylist()
    width = max(map(len, vecs))
    m = np.zeros((len(ids), width), np.int64)
    for i, k in enumerate(order):
        m[i, :len(vecs[k])] = vecs[k]
    return pa.table({"block": pa.array([block], pa.int64()), "n": pa.array([len(ids)], pa.int64()),
                     "width": pa.array([width], pa.int64()), "top": pa.array([int(np.abs(m).max(initial=0))], pa.int64()),
                     "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                     "weights": pa.array([_small(m).tobytes()], pa.binary()),
                     "bytes": pa.array([_small(m).itemsize], pa.int64())})


PACKED = "block long, n long, width long, top long, ids binary, weights binary, bytes long"


def _small(m: np.ndarray) -> np.ndarray:
    for kind in ("<i1", "<i2", "<i4"):
        if np.abs(m).max(initial=0) <= np.iinfo(kind).max:
            return m.astype(kind)
    return m


def _matrix(r: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r[f"{side}_ids"], "<i8")
    return ids, np.frombuffer(r[f"{side}_weights"], f"<i{r[f'{side}_bytes']}").reshape(len(ids), r[f"{side}_width"])


def score_block(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of a few queries against a block: per term, the query weights
    times the term's postings are added to the dense score array."""
    terms = min(queries.shape[1], candidates.shape[1])
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(1, terms)
    kind = np.int32 if bound < 2 ** 31 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    spare = np.empty_like(scores)
    by_term = np.ascontiguousarray(candidates.T.astype(kind))
    for t in range(terms):
        weights = queries[:, t].astype(kind)
        postings = by_term[t]
        rows = np.flatnonzero(weights)
        at = np.flatnonzero(postings)
        if not len(rows) or not len(at):
            continue
        if len(at) * 3 > len(postings) and len(rows) * 3 > len(weights):  # a full list: add it in place
            np.multiply.outer(weights, postings, out=spare)
            scores += spare
        else:
            scores[np.ix_(rows, at)] += np.multiply.outer(weights[rows], postings[at])
    return scores


def _search(k: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                qid, q = _matrix(r, "q")
                cid, c = _matrix(r, "c")  # ascending ids
                out = [[], [], []]
                for s in range(0, len(qid), QUERY_STEP):
                    scores = score_block(q[s:s + QUERY_STEP], c)
                    for i, own in enumerate(qid[s:s + QUERY_STEP]):
                        row = scores[i]
                        a, e = np.searchsorted(cid, own, "left"), np.searchsorted(cid, own, "right")
                        if e > a:  # never its own candidate
                            row = np.delete(row, slice(a, e))
                        n = min(k, len(row))
                        if not n:
                            continue
                        edge = np.partition(row, len(row) - n)[len(row) - n]
                        above = np.flatnonzero(row > edge)
                        at = np.concatenate((above, np.flatnonzero(row == edge)[:n - len(above)]))
                        ids = np.where(at >= a, at + (e - a), at) if e > a else at
                        out[0].append(np.full(n, own))
                        out[1].append(cid[ids])
                        out[2].append(row[at].astype(np.int64))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out],
                                                     ["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0,
          query_every: int = 20, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query
    (ids divisible by ``query_every``), ties to the smaller id."""
    source = with_package(renamed(vectors, id=id_col, vec=vec_col))
    # finite: neither NaN nor beyond the largest double; a NULL component makes forall NULL
    fine = F.forall("vec", lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308)))
    rows = source.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("id").cast("long"), F.transform("vec", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vec"))
    rows = written(rows, "topk-rows")
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % query_every == 0, 1)).alias("q")).first()
    n_c, n_q = (max(1, math.ceil(v / s)) for v, s in ((size["n"], BLOCK), (size["q"], query_block)))

    def blocks(df: DataFrame, n: int, side: str) -> DataFrame:
        g = df.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(n))).groupBy("block")
        return g.applyInArrow(_pack, PACKED).select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "ids", "weights", "bytes", "width")])

    q = blocks(rows.filter(F.col("id") % query_every == 0), n_q, "q")
    c = blocks(rows, n_c, "c").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    pairs = c.join(q, "q_block").repartition(max(1, n_c * n_q), "q_block", "c_block")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
