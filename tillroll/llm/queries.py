"""One registered query per corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tillroll.llm import (
    conversation_repair, fill_middle, fingerprints, lm, ngram_join, packing, piece_bpe, pseudonyms, quality, records, simhash, token_counts,
    vector_search)
from tillroll.llm.common import fresh_folder, remainder, table, tokenizer_path, written

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), percent=80)


ORACLE["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""


@query
def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), folds=5)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, max_len=4096)


#: The registered query's key; a deployment passes its own.
DEMO_KEY = "demo0key"


@query
def op4_pii_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


@query
def op5_sentencepiece(spark, sf_dir):
    return piece_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"),
                            outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op6_token_records(spark, sf_dir):
    folder = fresh_folder(spark, "records")
    manifest = records.write_records(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return records.read_records(spark, folder, manifest, with_ids=False)


@query
def op7_document_fingerprints(spark, sf_dir):
    return fingerprints.classed(table(spark, sf_dir, "documents"))


@query
def op8_exact_topk(spark, sf_dir):
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


ORACLE["op8_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


@query
def op9_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"), folds=10)


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"),
                                     cache=fresh_folder(spark, "token-count-cache"), limit=4096)


@query
def op11_fill_in_middle(spark, sf_dir):
    stored = written(fill_middle.store(table(spark, sf_dir, "documents")), "fill-middle-frames")
    return fill_middle.fill_middle(fill_middle.plan(stored, seed=42, rate=50, spm=80), outputs=("output_sha256", "restored_sha256"))


ORACLE["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         list_transform(range(0, 4), lambda k: CAST('0x' || substr(hx, CAST(8 * k + 1 AS INTEGER), 8) AS BIGINT)) AS h FROM d),
c AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS c1,
         greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS c2 FROM u),
p AS (
  SELECT doc_id, text, n,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:c1], '') AS a, array_to_string(units[c1 + 1:c2], '') AS b, array_to_string(units[c2 + 1:n], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b
              ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query
def op12_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair(conversation_repair.damage(conversations))
    return conversation_repair.report(repaired, conversations)


# Costs and edits from the last row to the first, a state machine of its own; rows of one turn in order of role and text.
ORACLE["op12_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
-- CRC-32, bit by bit
crc AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda j: CAST(ascii(substr(k, CAST(j AS INTEGER), 1)) AS BIGINT)),
      lambda c, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
      CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS m FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, copy,
         CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE m <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM placed),
talk AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal,
         list({'r': r, 'go': coalesce(fault IN ('blank', 'duplicate'), false), 'cut': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'role': role, 'text': text}
              ORDER BY i DESC) AS todo
  FROM judged GROUP BY conv_id),
-- least (cost, edits) to the end from each state before the rows read so far, last row first; z: nothing yet, s, u, a
best AS (
  SELECT conv_id, todo, {'c': 0, 'e': '', 'o': CAST([] AS VARCHAR[])} AS z, {'c': 6, 'e': 'II', 'o': ['user:', 'assistant:']} AS s,
         {'c': 3, 'e': 'I', 'o': ['assistant:']} AS u, {'c': 0, 'e': '', 'o': CAST([] AS VARCHAR[])} AS a FROM talk
  UNION ALL
  SELECT conv_id, todo, list_sort([bz, {'c': nu.c + 3, 'e': 'I' || nu.e, 'o': ['user:'] || nu.o}])[1], list_sort([bs, {'c': nu.c + 3, 'e': 'I' || nu.e, 'o': ['user:'] || nu.o}])[1],
         nu, list_sort([ba, {'c': bu.c + 3, 'e': 'I' || bu.e, 'o': ['user:'] || bu.o}])[1]
  FROM (SELECT *, list_sort([bu, {'c': ba.c + 3, 'e': 'I' || ba.e, 'o': ['assistant:'] || ba.o}])[1] AS nu
    FROM (SELECT conv_id, todo[2:] AS todo,
        list_sort([{'c': z.c + 4, 'e': 'D' || z.e, 'o': z.o}]
          || CASE WHEN x.go THEN [] ELSE [{'c': u.c + 3 + x.cut, 'e': 'R' || u.e, 'o': ['user:' || x.text] || u.o}] END
          || CASE WHEN x.go OR x.r <> 's' THEN [] ELSE [{'c': s.c + x.cut, 'e': 'K' || s.e, 'o': [x.role || ':' || x.text] || s.o}] END
          || CASE WHEN x.go OR x.r <> 'u' THEN [] ELSE [{'c': u.c + x.cut, 'e': 'K' || u.e, 'o': [x.role || ':' || x.text] || u.o}] END)[1] AS bz,
        list_sort([{'c': s.c + 4, 'e': 'D' || s.e, 'o': s.o}]
          || CASE WHEN x.go THEN [] ELSE [{'c': u.c + 3 + x.cut, 'e': 'R' || u.e, 'o': ['user:' || x.text] || u.o}] END
          || CASE WHEN x.go OR x.r <> 'u' THEN [] ELSE [{'c': u.c + x.cut, 'e': 'K' || u.e, 'o': [x.role || ':' || x.text] || u.o}] END)[1] AS bs,
        list_sort([{'c': u.c + 4, 'e': 'D' || u.e, 'o': u.o}]
          || CASE WHEN x.go THEN [] ELSE [{'c': a.c + 3 + x.cut, 'e': 'R' || a.e, 'o': ['assistant:' || x.text] || a.o}] END
          || CASE WHEN x.go OR x.r <> 'a' THEN [] ELSE [{'c': a.c + x.cut, 'e': 'K' || a.e, 'o': [x.role || ':' || x.text] || a.o}] END)[1] AS bu,
        list_sort([{'c': a.c + 4, 'e': 'D' || a.e, 'o': a.o}]
          || CASE WHEN x.go THEN [] ELSE [{'c': u.c + 3 + x.cut, 'e': 'R' || u.e, 'o': ['user:' || x.text] || u.o}] END
          || CASE WHEN x.go OR x.r <> 'u' THEN [] ELSE [{'c': u.c + x.cut, 'e': 'K' || u.e, 'o': [x.role || ':' || x.text] || u.o}] END)[1] AS ba
      FROM (SELECT *, todo[1] AS x FROM best WHERE len(todo) > 0))))
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(z.c, 0) AS BIGINT) AS cost, coalesce(z.e, '') AS audit, sha256(array_to_string(coalesce(z.o, []), chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN talk ON talk.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id AND len(best.todo) = 0
"""


@query
def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
