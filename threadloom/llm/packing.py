"""Packing of token sequences by bin completion.

Documents are cut into pieces of at most `capacity` tokens. What matters to the packing is how many pieces
there are of each length, a histogram of fewer than `capacity` numbers however large the corpus is. The
driver packs that histogram by bin-completion branch and bound and gets patterns (a filling and how often it
is used); a piece finds its place from its rank among the pieces of its length.

Null text is empty: only the end token. Rows with equal doc_id are packed each by itself. Other columns are
not read. An empty table gives no pieces. Very long texts become pieces of exactly `capacity` tokens (each a
sequence of its own) and one shorter piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import resident, text_or_empty, tidied, written
from .tokenization import Encoder, packed

CAPACITY, END_ID = 2048, 0
#: Effort of the search: nodes of the tree in all, fillings looked at and kept for one largest piece.
NODES, LOOKS, KEEP = 3000, 800, 4

Filling = tuple[int, ...]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total, and by pieces that cannot share (bound L2)."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(s)] for s in sizes], np.int64)
    for k in sizes[sizes * 2 <= capacity]:
        big, mid, small = sizes > capacity - k, (sizes <= capacity - k) & (sizes * 2 > capacity), (sizes * 2 <= capacity) & (sizes >= k)
        room = int((n[mid] * (capacity - sizes[mid])).sum())
        best = max(best, int(n[big].sum() + n[mid].sum()) + max(0, -(-(int((n[small] * sizes[small]).sum()) - room) // capacity)))
    return max(best, int(n[sizes * 2 > capacity].sum()))


def dominates(a: Filling, b: Filling) -> bool:
    """Whether b's pieces can be dealt into the places of a's pieces: then a is at least as good a filling."""
    if len(b) > 10:
        return False

    def place(rest: Filling, rooms: list[int]) -> bool:
        if not rest:
            return True
        for i, room in enumerate(rooms):
            if room >= rest[0] and room not in rooms[:i]:
                if place(rest[1:], [*rooms[:i], room - rest[0], *rooms[i + 1 :]]):
                    return True
        return False

    return place(tuple(sorted(b, reverse=True)), list(a))


def fillings(sizes: list[int], left: dict[int, int], room: int, slack: int) -> list[Filling]:
    """Undominated fillings of `room`, least waste first; sizes: descending. Waste over `slack` is cut unless nothing else is found.

    Pieces are tried from the largest, so that a filling comes before those it dominates; the first one met
    is the greedy filling, which is always kept as a candidate.
    """
    found: list[tuple[int, Filling]] = []
    looks = 0
    least = room + 1

    def go(start: int, rest: int, taken: list[int], used: dict[int, int]) -> bool:
        nonlocal looks, least
        fits = False
        i = start
        while i < len(sizes):
            s = sizes[i]
            if s > rest:  # jump to what fits
                lo, hi = i + 1, len(sizes)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if sizes[mid] > rest else (lo, mid)
                i = lo
                continue
            if left[s] - used.get(s, 0) > 0:
                fits = True
                used[s] = used.get(s, 0) + 1
                taken.append(s)
                done = go(i, rest - s, taken, used)
                taken.pop()
                used[s] -= 1
                if done:
                    return True
                looks += 1
                if looks > LOOKS:
                    return True
            i += 1
        if not fits and (rest < least or rest <= slack):
            least = min(least, rest)
            found.append((rest, tuple(taken)))
            if rest == 0 and sum(1 for x in found if x[0] == 0) >= KEEP:
                return True
        return False

    go(0, room, [], {})
    out: list[Filling] = []
    for _, filling in sorted(found, key=lambda x: (x[0], len(x[1]), tuple(-s for s in x[1]))):
        if filling not in out and not any(dominates(x, filling) for x in out):
            out.append(filling)
            if len(out) >= KEEP:
                break
    return out


def _times(filling: Filling, left: dict[int, int]) -> int:
    return min(left[s] // filling.count(s) for s in set(filling))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: always the largest piece left, then the largest that fits, as often as it can be had."""
    left = dict(counts)
    sizes = sorted(left, reverse=True)
    out = []
    while sizes:
        used: dict[int, int] = {}
        taken, room = [], capacity
        for s in sizes:
            n = min(left[s], room // s)
            if n:
                used[s] = n
                taken += [s] * n
                room -= n * s
        times = min(left[s] // n for s, n in used.items())
        out.append((tuple(taken), times))
        for s, n in used.items():
            left[s] -= n * times
        sizes = [s for s in sizes if left[s]]
    return out


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Patterns (pieces, times) that use each length as often as counts says, in as few sequences as were found.

    Depth-first: the largest piece left opens a sequence, its undominated fillings are the branches, first
    used as often as they can be, then once. A branch whose waste so far leaves no packing better than the
    incumbent is cut. The first incumbent is best-fit decreasing; the search ends at the lower bound, or after
    `nodes` nodes: the packing is whole then too, with the best incumbent that was met.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("lengths must be from 1 to the capacity")
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(t for _, t in best)
    budget = nodes

    # an explicit stack: (pieces left, patterns so far, sequences, waste)
    stack = [(counts, None, 0, 0)]
    while stack and best_n > bound and budget > 0:
        left, made, n, waste = stack.pop()
        slack = (best_n - 1) * capacity - total - waste
        if slack < 0:
            continue
        if not left:
            if n < best_n:
                best_n, best = n, []
                while made:
                    made, one = made
                    best.append(one)
            continue
        budget -= 1
        sizes = sorted(left, reverse=True)
        top = sizes[0]
        rest = {s: c for s, c in left.items() if s != top or c > 1}
        if top in rest:
            rest[top] = left[top] - 1
        branches = []
        for filling in fillings(sorted(rest, reverse=True), rest, capacity - top, slack):
            whole = (top, *filling)
            lost = capacity - sum(whole)
            most = _times(whole, left)
            for times in dict.fromkeys((most, 1)):
                if lost * times <= slack:
                    after = dict(left)
                    for s in whole:
                        after[s] -= times
                    branches.append(({s: c for s, c in after.items() if c}, (made, (whole, times)), n + times, waste + lost * times))
        stack += reversed(branches)
    return best


def _places(patterns: list[tuple[Filling, int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of places, the run's first sequence, and the place in a sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    first = 0
    for filling, times in patterns:
        at = 0
        for s in filling:
            runs.setdefault(s, []).append((given.get(s, 0), first, at))
            given[s] = given.get(s, 0) + times
            at += s
        first += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*r)) for s, r in runs.items()}


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32, [ids], and their rank among the task's pieces of that length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    end = packed([end_id])
    step = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident(("ids", path), lambda: Encoder(path, packed))
        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in tidied(batches):
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(encoder.of(value.as_py())) + end
                for i, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    n = len(own) // 4
                    rows.append((doc_id, i, at // 4, n, zlib.crc32(own), part, ranks[n], *([own] if with_ids else [])))
                    ranks[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(pieces, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there; with_ids adds the piece's ids as little-endian 32-bit numbers.

    The ranks are written with the pieces, so that a later loss of an executor cannot change them. A rank in
    the corpus is the rank in the task plus what earlier tasks have of that length; no rows of one length
    ever meet in one task.
    """
    spark = docs.sparkSession
    pieces = written(spark, cut(docs, path, capacity, end_id, text, with_ids), "pieces")
    short = F.col("length") < capacity
    by_part = pieces.where(short).groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    by_part = written(spark, by_part, "lengths")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer than `capacity` rows
    places = spark.sparkContext.broadcast(_places(pack_histogram(histogram, capacity), capacity))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before")), ["part", "length"], "left")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            n = np.asarray(batch["length"])
            rank = np.asarray(batch["rank"]) + np.asarray(batch["before"].fill_null(0))
            # a full piece is a sequence of its own, numbered below zero
            sequence = -1 - ((np.asarray(batch["part"]).astype(np.int64) << 40) + rank)
            offset = np.zeros(len(n), np.int64)
            for length in np.unique(n[n < capacity]):
                at = np.flatnonzero(n == length)
                starts, first, place = table[int(length)]
                run = np.searchsorted(starts, rank[at], "right") - 1
                sequence[at] = first[run] + rank[at] - starts[run]
                offset[at] = place[run]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            extra = ["ids"] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(sequence), pa.array(offset), *(batch[c] for c in extra)], [*keep, "sequence_id", "offset", *extra])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian 32-bit) of pack(..., with_ids=True); a group holds at most `capacity` tokens."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
