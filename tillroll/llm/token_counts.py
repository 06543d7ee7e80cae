"""Token counts behind a digest cache.

A text's key is the digest of its normalised UTF-8 bytes with the digest of
the tokenizer file. Counts known under that key come from the cache by a
join; of the others each distinct text is encoded once and its count is
appended to the cache, a Parquet table in a shared folder. A second run over
the same texts encodes nothing.

Scale: copies of a text meet by digest, and every map task hands on one row
of each text it saw, so a text that a third of all documents share costs one
row a task. The join by digest carries no text; its hot keys are split by
Spark's skew join.

Counts are those of the sentencepiece library without begin, end or added
ids. In this vocabulary no piece goes on past a blank, so a text's count is
the sum over its blank-separated words, each encoded by the library and
remembered in the worker (a bounded number of words); texts with runs of
blanks, or that hold the blank's own symbol, are encoded whole.

Defined results: NULL text counts as empty (0 bytes, 0 tokens); NULL ids and
repeated rows are kept; an empty table gives no rows; other input columns
are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import renamed, with_package, written

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
GENERATION = 300_000  # words remembered in each of two generations


class WordCounts(dict):
    """word -> number of its ids. ``by_words`` is False for a vocabulary in
    which some piece goes on past a blank; texts are then encoded whole."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.vocab_size()))
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces) and [
            self.library.encode(x, out_type=str) for x in ("a b", "a")] == [["▁a", "▁b"], ["▁a"]]
        self.old: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = len(self.library.encode(word))
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[word] = n
        return n

    def count(self, text: str) -> int:
        if not self.by_words or not text or "  " in text or text[0] == " " or text[-1] == " " or "▁" in text:
            return len(self.library.encode(text))
        return sum(map(self.__getitem__, text.split(" ")))


_LOADED: dict[str, WordCounts] = {}


def load(path: str) -> WordCounts:
    if path not in _LOADED:
        _LOADED[path] = WordCounts(path)
    return _LOADED[path]


def version(path: str) -> str:
    """Digest of the tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def _count(path: str, name: str):
    def run(batches):
        words = load(path)
        for b in batches:
            counts = [words.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([name] * b.num_rows, pa.string()),
                                              pa.array(counts, pa.int64())], ["digest", "tokenizer", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, normalise=None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``cache``: folder of the
    Parquet cache, made if absent, appended to otherwise. ``normalise``:
    column -> column, to match the tokenizer's own normalisation (default:
    none, as this vocabulary has none)."""
    spark = docs.sparkSession
    name = version(tokenizer)
    text = F.coalesce(F.col("_text"), F.lit(""))
    source = with_package(renamed(docs, _id=id_col, _text=text_col)).select(
        F.col("_id").alias("doc_id"), (normalise(text) if normalise else text).alias("text"), text.alias("_raw"))
    keyed = source.withColumn("digest", F.sha2("text", 256))
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        known.schema  # noqa: B018
        known.limit(1).collect()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], CACHE_SCHEMA)
    stored = known.filter(F.col("tokenizer") == name).select("digest", "n_tokens").dropDuplicates(["digest"])
    misses = keyed.select("digest", "text").join(stored, "digest", "left_anti").dropDuplicates(["digest"])
    new = misses.mapInArrow(_count(tokenizer, name), CACHE_SCHEMA)
    new.write.mode("append").parquet(cache)
    counts = (spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == name)
              .select("digest", "n_tokens").dropDuplicates(["digest"]))
    heads = keyed.select("doc_id", "digest", F.octet_length("_raw").cast("long").alias("n_bytes"))
    return heads.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
