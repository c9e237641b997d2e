"""Token counts by a map-side two-tier lookup.

Tier one is a table of the most frequent pre-tokens and their lengths in tokens, broadcast to every worker;
tier two is the worker's own bounded cache, filled by encoding what tier one lacks. Nothing is shuffled: a
text is counted in the task that reads it. The table only saves work; a count never depends on it. It is drawn
from all partitions: each task counts its pre-tokens, dropping the rarer half whenever it holds SAMPLE_WORDS
different ones, and sends its TASK_WORDS most frequent to the driver, which adds them up. The table
holds at most TABLE_WORDS words (about 2 MB). Pre-tokens over WORD_LENGTH characters are left to tier two.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each by itself; other columns of the
input, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, text_or_empty, tidied
from .tokenization import Encoder

SAMPLE_WORDS, WORD_LENGTH, TABLE_WORDS, TASK_WORDS, TOKEN_LIMIT = 200_000, 64, 32_768, 4096, 2048


def _pruned(seen: Counter, limit: int) -> Counter:
    """seen, or its more frequent half where it holds more than limit words."""
    return Counter(dict(_best(seen, limit // 2))) if len(seen) > limit else seen


def _best(seen: Counter, words: int) -> list[tuple[str, int]]:
    return sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:words]


def _frequent(docs: DataFrame, path: str, text: str, sample: int, words: int) -> dict[str, int]:
    """The most frequent pre-tokens of all partitions and their lengths in tokens; no pre-token is shuffled."""
    most = min(words, TASK_WORDS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = resident(("lengths", path), lambda: Encoder(path, len)), Counter()
        for batch in tidied(batches):
            for t in batch.column(0):
                seen.update(encoder.pre_tokens(t.as_py()))
                seen = _pruned(seen, sample)
        best = _best(Counter({w: n for w, n in seen.items() if len(w) <= WORD_LENGTH}), most)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["word", "n"])

    encoder = Encoder(path, len)
    if not encoder.by_word:
        return {}  # its texts are encoded whole, nothing would be looked up
    lists = docs.select(text_or_empty(text).alias("text")).mapInArrow(counted, "word string, n long").toArrow()
    best = lists.group_by("word").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("word", "ascending")])
    return {w: encoder.words[w] for w in best["word"][:words].to_pylist()}


def token_lengths(docs: DataFrame, path: str, text: str = "text", sample: int = SAMPLE_WORDS, words: int = TABLE_WORDS):
    """A Column with the number of tokens of `text`, for docs.select()."""
    table = docs.sparkSession.sparkContext.broadcast(_frequent(docs, path, text, sample, words))

    key = uuid.uuid4().hex

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = resident(key, lambda: Encoder(path, len, table.value))
        for batch in tidied(batches):
            yield pa.array([sum(encoder.of(t.as_py())) for t in batch], pa.int64())

    return n_tokens(text_or_empty(text))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row."""
    return docs.select("doc_id", F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), token_lengths(docs, path, text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
