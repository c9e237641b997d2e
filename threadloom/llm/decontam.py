"""Benchmark decontamination by winnowing.

Texts become lower-cased words. Every text keeps the least hash of each run of WINDOW - GRAM + 1 consecutive
GRAM-word hashes; a shared run of WINDOW words has the same hashes on both sides and so the same least one, so
no such run can be missed. Fingerprints of documents and benchmark are joined, and a hit is extended to the
whole window, which must be equal to count. Items shorter than WINDOW words are one window of their own
length and are looked up by it.

The benchmark's index is broadcast while its texts hold at most BROADCAST_BYTES; a larger one is joined by
shuffles, with the same result. Null texts have no words and no hits. Benchmark rows without item_id or
without words are left out. Equal item texts count each by its id, repeated ids once. Rows with equal doc_id
are judged each by itself; other columns pass through untouched under their own names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, signed, texts_of, tidied, word_hashes, written

WINDOW, GRAM = 13, 5
BROADCAST_BYTES = 32 << 20
#: Bytes of words, A-Z to a-z; all others become spaces. One byte for one byte, so places stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_SPANS = "array<struct<start:long,end:long>>"


def least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` hashes."""
    n = len(g) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, width):
        np.minimum(out, g[j : j + n], out=out)
    return out


class Index:
    """Windows of the benchmark by hash, and the fingerprints of the long ones."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        by: dict[int, dict[int, set[str]]] = {}
        prints = [np.empty(0, np.uint64)]
        for item, text in rows:
            if not (words := text.translate(TABLE).split()):
                continue
            h = word_hashes(words)
            n = min(window, len(h))
            own = by.setdefault(n, {})
            for x in gram_hashes(h, n).tolist():
                own.setdefault(x, set()).add(item)
            if n == window:
                prints.append(least(gram_hashes(h, gram), window - gram + 1))
        self.windows = by
        self.prints = np.unique(np.concatenate(prints))
        self.short = {n: np.array(sorted(x), np.uint64) for n, x in by.items() if n < window}

    def load(self) -> None:
        """A table of the leading bits, to pass over most hashes at one look."""
        self.seen = {n: self._table(x) for n, x in [(0, self.prints), *self.short.items()]}

    @staticmethod
    def _table(x: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 22, bool)
        table[x >> np.uint64(42)] = True
        return table

    def _among(self, x: np.ndarray, key: int) -> np.ndarray:
        at = np.flatnonzero(self.seen[key][x >> np.uint64(42)])
        known = self.prints if key == 0 else self.short[key]
        if not len(at) or not len(known):
            return at[:0]
        found = np.minimum(np.searchsorted(known, x[at]), len(known) - 1)
        return at[known[found] == x[at]]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words lie in a window of the benchmark, and the items of those windows."""
        h = word_hashes(words)
        covered, items = None, set()
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(h) >= self.window and len(self.prints):
            at = self._among(least(gram_hashes(h, self.gram), self.window - self.gram + 1), 0)
            if len(at):
                found.append((self.window, at, gram_hashes(h, self.window)[at]))
        for n in self.short:
            if len(h) >= n:
                x = gram_hashes(h, n)
                at = self._among(x, n)
                found.append((n, at, x[at]))
        for n, places, hashes in found:
            own = self.windows[n]
            for i, x in zip(places.tolist(), hashes.tolist()):
                if x in own:
                    if covered is None:
                        covered = np.zeros(len(h), bool)
                    covered[i : i + n] = True
                    items |= own[x]
        return covered, items


def spans_of(data: bytes, covered: np.ndarray) -> list[tuple[int, int]]:
    """Runs of covered words as places in the text, in code points."""
    places = [m.span() for m in _WORD.finditer(data.translate(TABLE))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    out, at, chars = [], 0, 0
    for a, b in edges.reshape(-1, 2).tolist():
        start, end = places[a][0], places[b - 1][1]
        chars += len(data[at:start].decode())
        n = len(data[start:end].decode())
        out.append((chars, chars + n))
        at, chars = end, chars + n
    return out


def _benchmark(benchmark: DataFrame, text: str) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull() & F.col(text).isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col(text).cast("string").alias("words"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", bound: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (code points) and hit_items (sorted as strings) added."""
    items = _benchmark(benchmark, text)
    return (_by_broadcast if _fits(items, bound) else _by_shuffle)(docs, items, window, gram, text)


def _fits(items: DataFrame, bound: int) -> bool:
    return items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] <= bound


def _sent(items: DataFrame, window: int, gram: int) -> Broadcast[Index]:
    return items.sparkSession.sparkContext.broadcast(Index([(r["item"], r["words"].encode()) for r in items.collect()], window, gram))


def _loaded(index: Broadcast[Index]) -> Index:
    own = index.value
    if not hasattr(own, "seen"):
        own.load()
    return own


def _by_broadcast(docs: DataFrame, items: DataFrame, window: int, gram: int, text: str) -> DataFrame:
    index = _sent(items, window, gram)

    @F.arrow_udf(f"struct<n_words:long,n_hit:long,hit_spans:{_SPANS},hit_items:array<string>>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _loaded(index)
        for batch in batches:
            yield _judged(batch, own)

    return _apart(docs, judged(F.col(text).cast("string")))


def _judged(batch: pa.Array, index: Index) -> pa.Array:
    n_words, n_hit, spans, ids = [], [], [], []
    for data in texts_of(batch):
        words = (data or b"").translate(TABLE).split()
        covered, found = index.hits(words) if words else (None, ())
        n_words.append(len(words))
        n_hit.append(0 if covered is None else int(covered.sum()))
        spans.append([] if covered is None else [{"start": a, "end": b} for a, b in spans_of(data, covered)])
        ids.append(sorted(found))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind), pa.array(ids, pa.list_(pa.string()))], ["n_words", "n_hit", "hit_spans", "hit_items"])


_ADDED = ("n_words", "n_hit", "hit_spans", "hit_items")


def _apart(docs: DataFrame, found) -> DataFrame:
    """docs and what was found, whose names take the place of equal ones."""
    kept = [c for c in docs.columns if c.lower() not in {*_ADDED, "_hits"}]
    return docs.select(*kept, found.alias("_hits")).select(*kept, *(F.col(f"_hits.{c}").alias(c) for c in _ADDED))


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int, gram: int, text: str) -> DataFrame:
    """For a benchmark too large to broadcast: prints are joined, and only texts with a common print are cut into windows.

    A text is known by its digest, so copies are looked at once. The windows of a text and the ids of its items
    meet again in groups of one text.
    """
    spark = docs.sparkSession
    lengths = F.udf(lambda t: min(window, len(t.encode().translate(TABLE).split())), "int")
    sizes = sorted(r[0] for r in items.select(lengths("words").alias("n")).distinct().where("n > 0").collect())  # at most `window` numbers

    def grams(batches: Iterator[pa.RecordBatch], prints: bool, one: bool) -> Iterator[pa.RecordBatch]:
        """(key, at, n, x): prints of each text, or all its windows; one: an item has windows of its own length only."""
        for batch in batches:
            keys, ats, ns, xs = [], [], [], []
            for key, data in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words = (data or b"").translate(TABLE).split()
                if not words:
                    continue
                h = word_hashes(words)
                for n in [min(window, len(h))] if one else sizes:
                    x = least(gram_hashes(h, gram), window - gram + 1) if prints and n == window else gram_hashes(h, n)
                    at = np.arange(len(x))
                    if prints:
                        x, at = np.unique(x, return_index=True)
                    keys += [key] * len(x)
                    ats.append(at)
                    ns.append(np.full(len(x), n))
                    xs.append(x)
            join = lambda a, t: np.concatenate([np.empty(0, t), *a]).astype(t)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(join(ats, np.int64)), pa.array(join(ns, np.int32)), pa.array(signed(join(xs, np.uint64)))], ["key", "at", "n", "x"])

    schema = "key string, at long, n int, x long"
    key = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    texts = docs.select(key.alias("key"), F.col(text).cast("string").alias("words"))
    test_prints = items.mapInArrow(lambda b: grams(b, True, True), schema).select("n", "x").distinct()
    candidates = texts.mapInArrow(lambda b: grams(b, True, False), schema).join(test_prints, ["n", "x"], "left_semi").select("key").distinct()
    windows = texts.join(candidates, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(lambda b: grams(b, False, False), schema)
    test_windows = items.mapInArrow(lambda b: grams(b, False, True), schema).select("n", "x", F.col("key").alias("item")).distinct()
    hits = written(spark, windows.join(test_windows, ["n", "x"]).select("key", "at", "n", "item"), "hits")
    by_text = hits.groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("at")).join(hits.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("ids")), "key")

    @F.arrow_udf(f"struct<n_words:long,n_hit:long,hit_spans:{_SPANS},hit_items:array<string>>")
    def judged(texts: pa.Array, at: pa.Array, ids: pa.Array) -> pa.Array:
        n_words, n_hit, spans = [], [], []
        for data, places in zip(texts_of(texts), at.to_pylist()):
            words = (data or b"").translate(TABLE).split()
            covered = np.zeros(len(words), bool)
            for p in places or ():
                covered[p["at"] : p["at"] + p["n"]] = True
            n_words.append(len(words))
            n_hit.append(int(covered.sum()))
            spans.append([{"start": a, "end": b} for a, b in spans_of(data, covered)] if covered.any() else [])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind), pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.string()))], list(_ADDED))

    kept = [c for c in docs.columns if c.lower() not in {*_ADDED, "_hits"}]
    joined = docs.withColumn("__text", key).join(by_text.select(F.col("key").alias("__text"), F.col("at").alias("__at"), F.col("ids").alias("__ids")), "__text", "left")
    return joined.select(*kept, judged.asNondeterministic()(F.col(text).cast("string"), "__at", "__ids").alias("_hits")).select(*kept, *(F.col(f"_hits.{c}").alias(c) for c in _ADDED))


#: Hit words of a contaminated text, in hundredths of all its words.
SHARE = 5


def verdicts(hits: DataFrame) -> DataFrame:
    """The digest columns of find_hits."""
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= SHARE * F.col("n_words"))).alias("contaminated"),
    )


def without_hits(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """docs without contaminated rows; in the others the hit passages are cut out, so that no window of the benchmark stays.

    What a cut brings together may be a window again, so texts that were cut are looked at until nothing hits;
    each round they are fewer, and shorter. Only the texts as they come are judged contaminated.
    """
    items = _benchmark(benchmark, "text")
    return _cleaned_at_once(docs, items) if _fits(items, bound) else _cleaned_in_rounds(docs, items)


def _cleaned_at_once(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All rounds of a text in the task that reads it, and one Python worker a task.

    Filters are pushed through what is deterministic, which would run the function in the filter and again above it.
    """
    index = _sent(items, WINDOW, GRAM)

    @F.arrow_udf("struct<kept:boolean,cut:string>")
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _loaded(index)
        for batch in tidied(batches):
            yield _cleaned(batch, own)

    left = cleaned.asNondeterministic()(F.col("text").cast("string"))
    found = docs.select("*", left.alias("__left")).where("__left.kept")
    return found.withColumn("text", F.coalesce("__left.cut", "text")).select(*docs.columns)


def _cleaned(batch: pa.Array, index: Index) -> pa.Array:
    """Whether each text stays; what is left of it if passages were cut out, else null."""
    kept, left = [], []
    for data in texts_of(batch):
        cut, words = None, (data or b"").translate(TABLE).split()
        covered = index.hits(words)[0] if words else None
        kept.append(covered is None or 100 * int(covered.sum()) < SHARE * len(words))
        while kept[-1] and covered is not None:
            cut = without_hits(data.decode(), spans_of(data, covered))
            data = cut.encode()
            covered = index.hits(words)[0] if (words := data.translate(TABLE).split()) else None
        left.append(cut)
    return pa.StructArray.from_arrays([pa.array(kept, pa.bool_()), pa.array(left, pa.string())], ["kept", "cut"])


def _cleaned_in_rounds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For a benchmark too large to broadcast: each round finds the hits of all texts that the one before has cut."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without_hits(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    def shortened(hits: DataFrame) -> DataFrame:
        return hits.withColumn("text", cut("text", "hit_spans")).select(*docs.columns)

    hits = _by_shuffle(docs, items, WINDOW, GRAM, "text")
    kept = hits.where(~((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= SHARE * F.col("n_words"))))
    parts = [kept.where("n_hit = 0").select(*docs.columns)]
    rest = written(docs.sparkSession, shortened(kept.where("n_hit > 0")), "cut")
    while not rest.isEmpty():
        hits = _by_shuffle(rest, items, WINDOW, GRAM, "text")
        parts.append(hits.where("n_hit = 0").select(*docs.columns))
        rest = written(docs.sparkSession, shortened(hits.where("n_hit > 0")), "cut")
    return reduce(DataFrame.unionByName, parts)
