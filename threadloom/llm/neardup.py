"""Near-duplicates by an inverted join on MinHash coordinates.

1. One pass over the texts: each gives its shingle count, a 128-bit digest of its shingle set and COORDS
   minima. Texts with equal sets are one class from here on, so a group of copies costs one row.
2. Every class is posted under each (coordinate, value) pair. Pairs that one class alone has are dropped.
   Two classes at the threshold agree in at least `matches` coordinates (but for a chance of MISS), so the
   rarest COORDS - matches + 1 postings of a class are enough to meet: the prefix. The longest lists are
   skipped and only counted when a met pair is compared coordinate by coordinate, by a byte of each.
3. Within a list no all-pairs are made. Its most connected class, the hub, is compared with the others; what
   links is merged into components, and a list whose classes share a component is done. If at most HUBS classes
   lie outside the largest component, they are compared with the list, which is then done. Longer lists whose
   hubs are linked are one family, and so are families that share half of the smaller one's classes. In a family
   of at most PAIRED classes one task looks at all pairs by BITS parities of their sets, which never show more
   differences than there are, and only what they leave possible becomes a row. A larger family is centred on a
   set V, the shingles that most of SAMPLE of its classes have (any set gives right results, a good one short
   lists): x and y reach the threshold only if they differ in at most h shingles, so their differences from V
   have most shingles in common or are few. Each class is posted under those of its first h + 1 differences, the
   family's rarest first, that some partner may need, and a list counts if it holds one of the first h / 2 + 1
   of a class. All are compared with the class that has most room near V, which joins the pairs that share no
   difference. The new lists go the same way. After DEPTH centrings, HUBS classes of what is left of a list are
   compared with it a round. So components are whole, however large the group is, and copies with many edits
   each cost their own differences, not a comparison with all others.
4. A met pair with enough equal coordinates is confirmed on the full sets.

Components come from a forest of the links of each task; forests of at most ONE_TASK links are put together by
one task, larger ones by star steps. Tables are broadcast up to BROADCAST_ROWS counted rows, else shuffled.

Texts without words, and null texts, have an empty set and no links. Equal rows are one class. Rows with
equal doc_id are one node of the graph: their component is that of any of them. A row without doc_id joins
only by an equal set; its component is that set's smallest doc_id and it is not kept. Ties between hubs go to
the larger class number. Very long texts have large sets, which only their own pairs carry. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, discard, gram_hashes, mixed, odd_numbers, signed, texts_of, tidied, word_hashes, written

SHINGLE, PERCENT = 5, 80
COORDS, MISS = 32, 1e-6
#: Classes that are compared with a whole list in one round; centrings one after another; classes that make a centre.
HUBS, DEPTH, SAMPLE = 16, 8, 65
#: Classes of a list whose pairs one task looks at; bits of a set's parities, a multiple of 64.
PAIRED, BITS = 512, 1024
#: Links that one task puts together (16 bytes each); rows of a broadcast table (at most 40 bytes each).
ONE_TASK, BROADCAST_ROWS = 1_000_000, 250_000
#: Tasks among which the classes of one family are dealt.
SLOTS = 16
_ODD = odd_numbers(COORDS, 11)[:, None]
_XOR = odd_numbers(COORDS, 13)[:, None]
_AXIS = odd_numbers(COORDS, 17)
_SKETCH = [f"s{i}" for i in range(COORDS // 8)]
_CLASS = ["num", "weight", "comp", *_SKETCH]


def matches_for(percent: int, coords: int = COORDS, miss: float = MISS) -> int:
    """The largest number of equal coordinates that pairs at the threshold miss with at most that chance."""
    p, total, n = percent / 100, 0.0, 0
    while n < coords and (total := total + comb(coords, n) * p**n * (1 - p) ** (coords - n)) <= miss:
        n += 1
    return max(1, n)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; of all its words if they are fewer."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words))))


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        np.minimum(out, (((shingles[None, at : at + (1 << 12)] ^ _XOR) * _ODD)).min(axis=1), out=out)
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, cid (digest of the set), sig (minima), tkey (digest of the text) of every row."""

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            counts, keys, sigs = [], [], []
            for data in texts_of(batch.column(2)):
                s = shingle_set(data, k)
                counts.append(len(s))
                keys.append(_digest(s) if len(s) else None)
                sigs.append(minima(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), batch.column(1)], ["doc_id", "n_shingles", "cid", "sig", "tkey"])

    t = F.col(text).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text), t.alias("text"))
    return rows.mapInArrow(signed_rows, "doc_id long, n_shingles long, cid binary, sig binary, tkey binary")


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("tkey")


def _postings(classes: DataFrame) -> DataFrame:
    """(token, num) of every class and coordinate."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint64).reshape(-1, COORDS)
            tokens = (sig ^ _AXIS) * _AXIS  # a coordinate's values are moved by a bijection of its own
            yield pa.RecordBatch.from_arrays([pa.array(signed(tokens.ravel())), batch["num"].take(pa.array(np.repeat(np.arange(len(sig)), COORDS)))], ["token", "num"])

    return classes.select("num", "sig").mapInArrow(posted, "token long, num long")


def _sketched(classes: DataFrame) -> DataFrame:
    """num and a byte of each coordinate, eight in a number. Equal coordinates have equal bytes, so no pair is lost."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint64).reshape(-1, COORDS)
            sketch = np.ascontiguousarray((mixed(sig) >> np.uint64(56)).astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["num"], *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)], ["num", *_SKETCH])

    return classes.select("num", "sig").mapInArrow(made, "num long, " + ", ".join(f"{s} long" for s in _SKETCH))


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _equal_bytes(a: list[Column], b: list[Column]) -> Column:
    """How many bytes of the numbers a and b are equal: the bits of each byte's difference are drawn into its last."""

    def differing(x: Column) -> Column:
        for shift, high, low in ((4, 0xF0, 0x0F), (2, 0x0C, 0x03), (1, 0x02, 0x01)):
            of = lambda m: _signed(int.from_bytes(bytes([m]) * 8, "little"))  # noqa: B023, E731
            x = x.bitwiseOR(F.shiftrightunsigned(x.bitwiseAND(of(high)), shift)).bitwiseAND(of(low))
        return F.bit_count(x)

    return F.lit(8 * len(a)) - reduce(lambda x, y: x + y, (differing(x.bitwiseXOR(y)) for x, y in zip(a, b)))


def small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


class _Forest:
    """Union-find on numbers; the least of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = x
        while (to := self.up.get(at, at)) != at:
            at = to
        while (to := self.up.get(x, x)) != at:
            self.up[x] = at
            x = to
        return at

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forests(links: DataFrame, most: int = ONE_TASK, percent: int | None = None) -> DataFrame:
    """(id, comp): the links (a, b) of each task with those that follow from others left out; at most `most` are held at once.

    With percent, a link counts if its sets bx and by reach it; they are not compared where a and b are joined already.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for batch in batches:
            sets = repeat(None) if percent is None else _arrays(batch["bx"], batch["by"])
            for a, b, both in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), sets):
                if both is None or forest.root(a) != forest.root(b) and _reaches(*both, percent):
                    forest.add(a, b)
            if len(forest.up) >= most:
                yield packed(forest)
                forest = _Forest()
        yield packed(forest)

    def packed(forest: _Forest) -> pa.RecordBatch:
        ids = list(forest.up)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([forest.root(x) for x in ids], pa.int64())], ["id", "comp"])

    columns = ["a", "b"] if percent is None else ["a", "b", "bx", "by"]
    return links.select(*columns).mapInArrow(trees, "id long, comp long")


def components(spark: SparkSession, links: DataFrame, one_task: int = ONE_TASK, percent: int | None = None) -> tuple[DataFrame, int]:
    """(id, comp) of each node of the links (a, b) that is not the least of its component, with that least one; and the number of rows.

    With percent, only links whose sets bx and by reach it count.
    """
    trees = written(spark, _forests(links, percent=percent), "forests")
    n = trees.count()
    if not n:
        return trees, 0
    again = trees.select(F.col("id").alias("a"), F.col("comp").alias("b"))
    # each tree of a task has one root, and a node one row: what one task can hold, it can put together
    whole = written(spark, _forests(again.coalesce(1), 2 * one_task), "components") if n <= one_task else written(spark, star_components(spark, again), "components")
    discard(trees)
    return whole, n


def star_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """components() without a task that sees all: large-star and small-star steps in turn, written once a turn, until the links no longer change."""
    now = written(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        steps = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, written(spark, steps.union(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        discard(last)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        before = state


def _arrays(*columns: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    for values in zip(*columns):
        yield tuple(np.frombuffer(v.as_buffer(), np.uint64) for v in values)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    n = _common(x, y)
    return 100 * n >= percent * (len(x) + len(y) - n)


def _with_sets(pairs: DataFrame, rows: int, sets: DataFrame) -> DataFrame:
    """(a, b, bx, by): the components of the pairs (x, y, cx, cy) and the full sets; y: hubs, which many pairs share."""
    mine = sets.select(F.col("num").alias("x"), F.col("shingles").alias("bx")).join(small(pairs, rows), "x")
    hubs = sets.join(small(pairs.select(F.col("y").alias("num")).distinct(), rows), "num", "left_semi").select(F.col("num").alias("y"), F.col("shingles").alias("by"))
    return mine.join(hubs, "y").select(F.col("cx").alias("a"), F.col("cy").alias("b"), "bx", "by")


def differences(x: np.ndarray, counts: np.ndarray, percent: int) -> tuple[int, int, np.ndarray]:
    """How far x is from the centre (shingles that one of them lacks), h, and the first h + 1 of those shingles, the rarest first.

    No set that x reaches differs from it in more than h shingles. counts: see _centred.
    """
    sampled, (values, n) = counts[0], counts[1:].reshape(2, -1)
    common = 2 * n > sampled
    at = np.minimum(np.searchsorted(values, x), max(0, len(values) - 1))
    known = values[at] == x if len(values) else np.zeros(len(x), bool)
    lacked = common.copy()
    lacked[at[known]] = False
    own = ~known
    own[known] = ~common[at[known]]
    rarity = np.zeros(len(x), np.uint64)
    rarity[known] = n[at[known]]
    differing = np.concatenate((x[own], values[lacked]))
    order = np.lexsort((differing, np.concatenate((rarity[own], sampled - n[lacked]))))
    h = (100 - percent) * len(x) // percent
    return len(differing), h, differing[order[: h + 1]]


def parities(x: np.ndarray) -> bytes:
    """For each of BITS parts, whether it has an odd number of the shingles. Each shingle that only one of two sets has changes one bit."""
    odd = np.bincount((x >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _paired(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y, cx, cy) of the pairs of lists of at most PAIRED classes that the bits of parities() leave possible: none that reaches the threshold is lost."""

    @F.arrow_udf("array<struct<x:long,y:long,cx:long,cy:long>>")
    def possible(lists: pa.Array) -> pa.Array:
        out, ends = [], [0]  # arrays of x, y, cx, cy; where each list's pairs end
        for one in lists:
            num, comp, size = (one.values.field(c).to_numpy(zero_copy_only=False) for c in ("num", "comp", "size"))
            odd = np.frombuffer(b"".join(one.values.field("odd").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            total = ends[-1]
            for i in range(len(num) - 1):
                differing = np.bitwise_count(odd[i] ^ odd[i + 1 :]).sum(axis=1, dtype=np.int64)
                j = i + 1 + np.flatnonzero(((100 + percent) * differing <= (100 - percent) * (size[i] + size[i + 1 :])) & (comp[i + 1 :] != comp[i]))
                if len(j):
                    out.append((np.full(len(j), num[i]), num[j], np.full(len(j), comp[i]), comp[j]))
                    total += len(j)
            ends.append(total)
        columns = [pa.array(np.concatenate([o[c] for o in out]) if out else [], pa.int64()) for c in range(4)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["x", "y", "cx", "cy"]))

    known = lists.select("token", "num", "comp").join(sets.select("num", "size", "odd"), "num")
    groups = known.groupBy("token").agg(F.collect_list(F.struct("num", "comp", "size", "odd")).alias("g"))
    return groups.select(possible("g").alias("g")).select(F.explode("g").alias("h")).select("h.*")


def _slot(n: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("num"), F.lit(n)).alias("slot")


def _dealt(table: DataFrame) -> DataFrame:
    """A row for each slot, so that a family's classes meet it in SLOTS tasks."""
    return table.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))))


def _centred(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members (token, _CLASS) with size, far, h and posted, the shingles of differences().

    The centre is what most of a family's sample has. It goes with the sample's size, the shingles that several of the
    sample have, and how many have them; others count as the rarest.
    """

    @F.arrow_udf("binary")
    def counted(samples: pa.Array) -> pa.Array:
        out = []
        for own in samples:
            own = [np.frombuffer(v.as_buffer(), np.uint64) for v in own.values]
            values, n = np.unique(np.concatenate(own), return_counts=True)
            several = (n > 1) | (2 * n > len(own))
            out.append(np.concatenate((np.array([len(own)], np.uint64), values[several], n[several].astype(np.uint64))).tobytes())
        return pa.array(out, pa.binary())

    @F.arrow_udf("struct<size:int,far:int,h:int,posted:array<long>>")
    def parted(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [(len(x), *differences(x, v, percent)) for x, v in _arrays(a, b)]
        ints = [pa.array([o[i] for o in out], pa.int32()) for i in range(3)]
        return pa.StructArray.from_arrays([*ints, pa.array([signed(o[3]) for o in out], pa.list_(pa.int64()))], ["size", "far", "h", "posted"])

    sampled = members.groupBy("token", _slot(SAMPLE)).agg(F.min("num").alias("num"))
    centres = sampled.join(sets.select("num", "shingles"), "num").groupBy("token").agg(F.collect_list("shingles").alias("s")).select("token", counted("s").alias("centre"))
    both = members.withColumn("slot", _slot()).join(_dealt(centres), ["token", "slot"]).join(sets.select("num", "shingles"), "num")
    return both.select("token", *_CLASS, parted("shingles", "centre").alias("p")).select("token", *_CLASS, "p.*")


def _posted(families: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of _centred(): lists (token, _CLASS) in which any linked pair that shares a difference meets; and pairs (x, y, cx, cy) that join the others.

    If x and y are linked and x is not farther from the centre, the first difference that both have is at place h / 2
    of x at the last, and at (h + far - far of x) / 2 of y. Linked pairs that share none are near the centre: both are
    linked with the class that has most room, (100 - percent) * size - (100 + percent) * far.
    """
    room = (100 - percent) * F.col("size") - (100 + percent) * F.col("far")
    nearest = families.groupBy("token").agg(F.max_by(F.struct("num", "comp"), F.struct(room, "num")).alias("b"), F.min("far").alias("least"))
    met = families.withColumn("slot", _slot()).join(_dealt(nearest), ["token", "slot"])
    joined = met.where(F.col("comp") != F.col("b.comp")).select(F.col("num").alias("x"), F.col("b.num").alias("y"), F.col("comp").alias("cx"), F.col("b.comp").alias("cy"))
    last = F.floor((F.col("h") + F.least("h", F.col("far") - F.col("least"))) / 2).cast("int")
    posts = met.select(F.col("token").alias("f"), *_CLASS, "h", F.posexplode(F.slice("posted", F.lit(1), last + 1)).alias("at", "e"))
    posts = posts.select(F.xxhash64("f", "e").alias("token"), *_CLASS, (2 * F.col("at") <= F.col("h")).alias("first"))
    several = posts.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max("first").alias("first")).where("first and a <> b").select("token")
    return posts.select("token", *_CLASS).join(several, "token", "left_semi"), joined


def _hubs(rows: DataFrame) -> DataFrame:
    """(token, hubs): the classes of rows, at most HUBS a token, as an array."""
    return rows.groupBy("token").agg(F.collect_list(F.struct("num", "comp", *_SKETCH)).alias("hubs"))


def _first_hub(posts: DataFrame) -> DataFrame:
    """(token, hubs) of the most connected class of each list of two or more."""
    best = F.max_by(F.struct("num", "comp", *_SKETCH), F.struct("weight", "num"))
    return posts.groupBy("token").agg(F.count("*").alias("n"), best.alias("h")).where("n > 1").select("token", F.array("h").alias("hubs"))


def _some_hubs(lists: DataFrame) -> DataFrame:
    """(token, hubs) of HUBS classes outside each list's largest component."""
    best = F.max_by(F.struct("num", "comp", *_SKETCH), F.struct("weight", "num"))
    some = lists.where("comp <> most").groupBy("token", _slot(HUBS)).agg(best.alias("h"))
    return some.select("token", "h.*").groupBy("token").agg(F.collect_list(F.struct("num", "comp", *_SKETCH)).alias("hubs"))


def _met(posts: DataFrame, hubs: DataFrame, matches: int) -> DataFrame:
    """posts with the numbers of their list's hubs, and those of them that may be linked with the class."""
    both = posts.join(hubs, "token")
    first = lambda h: (h["num"] < F.col("num")) | ~F.exists("hubs", lambda g: g["num"] == F.col("num"))  # noqa: E731  (two hubs meet once)
    near = F.filter("hubs", lambda h: (h["num"] != F.col("num")) & first(h) & (h["comp"] != F.col("comp")) & (_equal_bytes([F.col(s) for s in _SKETCH], [h[s] for s in _SKETCH]) >= matches))
    return both.select("token", *_CLASS, F.transform("hubs", lambda h: h["num"]).alias("met"), F.transform(near, lambda h: F.struct(h["num"].alias("y"), h["comp"].alias("cy"))).alias("near"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.col("num").alias("x"), F.col("comp").alias("cx"), F.explode("near").alias("h")).select("x", "h.y", "cx", "h.cy")


def _renewed(rows: DataFrame, comps: DataFrame | None, n: int, column: str = "comp") -> DataFrame:
    """rows with the components that the newest links give."""
    if not n:
        return rows
    now = comps.select(F.col("id").alias(column), F.col("comp").alias("_now"))
    return rows.join(small(now, n), column, "left").withColumn(column, F.coalesce("_now", column)).drop("_now")


def _undone(lists: DataFrame) -> DataFrame:
    """lists that have several components, with the largest one (most) and how many classes lie outside it (minor).

    Of lists with the same classes one stays, as all of them would make the same pairs: a passage of many shingles
    gives each of its shingles the same list. Sameness is a matter of their number and 128 bits of their hashes.
    """
    folds = [F.bit_xor(F.xxhash64("num", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    sizes = lists.groupBy("token", "comp").agg(F.count("*").alias("c"), *folds).groupBy("token")
    sizes = sizes.agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.sum("c").alias("n"), F.max("c").alias("c"), *[F.bit_xor(x).alias(x) for x in ("x0", "x1")]).where("n > c")
    once = sizes.groupBy("n", "c", "most", "x0", "x1").agg(F.min("token").alias("token"))
    return lists.join(once.select("token", "most", (F.col("n") - F.col("c")).alias("minor")), "token")


def _merged(spark: SparkSession, families: DataFrame) -> DataFrame:
    """families (token, _CLASS), each made one with any larger one that holds half of its classes or more, as written.

    Classes that share a passage lie in a family for each of several coordinates; each would post them all anew.
    A class is in at most as many families as its prefix has postings, so its pairs of families are few.
    """
    families = written(spark, families, "families")
    sizes = _dealt(families.groupBy("token").agg(F.count("*").alias("n")))
    sized = families.select("token", "num", _slot()).join(sizes, ["token", "slot"])
    mine = sized.groupBy("num").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("f")).where(F.size("f") > 1)
    pairs = mine.select("f", F.posexplode("f").alias("i", "small")).select("small", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("large"))
    shared = pairs.groupBy(F.col("small.token").alias("a"), F.col("small.n").alias("n"), F.col("large.token").alias("b")).agg(F.count("*").alias("c"))
    comps, n = components(spark, shared.where("2 * c >= n"))
    if not n:
        return families
    whole = written(spark, _renewed(families, comps, n, "token").dropDuplicates(["token", "num"]), "families")
    discard(families)
    return whole


def _linked(spark: SparkSession, docs: DataFrame, rows: DataFrame, k: int, percent: int, text: str, tied: bool) -> DataFrame:
    """(cid, root, component) of every class; tied: rows of one doc_id link their classes."""
    matches = matches_for(percent)
    classes = rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = written(spark, classes.withColumn("num", F.monotonically_increasing_id()), "classes")
    links: list[DataFrame] = []
    if tied:  # a doc_id whose rows have different sets ties their classes
        several = rows.where("cid is not null and doc_id is not null").groupBy("doc_id").agg(F.min("cid").alias("cid"), F.max("cid").alias("last")).where("cid <> last").select("doc_id")
        if not (several := written(spark, several, "ties")).isEmpty():
            own = rows.join(several, "doc_id").select("doc_id", "cid").distinct().join(classes.select("cid", "num"), "cid")
            least = own.groupBy("doc_id").agg(F.min("num").alias("b"))
            links.append(own.join(least, "doc_id").select(F.col("num").alias("a"), "b"))
    named = classes.where("rep is not null")

    postings = _postings(named)
    common = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    rank = F.array_sort(F.collect_list(F.struct("n", "token")))  # at most COORDS a class
    mine = postings.join(common, "token").groupBy("num").agg(rank.alias("posts"), F.sum("n").alias("weight"))
    # unshared postings are the rarest and fill the prefix first
    room = F.lit(COORDS - matches + 1) - (COORDS - F.size("posts"))
    posts = mine.where(room > 0).join(_sketched(named), "num").select("num", "weight", F.col("num").alias("comp"), *_SKETCH, F.explode(F.slice("posts", 1, F.greatest(room, F.lit(1)))).alias("p")).select("p.token", *_CLASS)
    posts = written(spark, posts, "posts")
    hubs = written(spark, _first_hub(posts), "hubs")  # a join of two tables can be split where a list is long
    met = written(spark, _met(posts, hubs, matches), "met")
    discard(posts, hubs)
    sets = _sets(spark, docs, met.select("num").distinct().join(named.select("num", "cid", "rep"), "num"), k, text)

    extra: list[DataFrame] = []
    spent, used, old, step = None, [met], [met], 0
    lists = met.where(F.col("num") != F.col("met")[0]).select("token", *_CLASS, F.col("met")[0].alias("hub"))
    while old or extra:
        pairs = written(spark, reduce(DataFrame.union, [*map(_pairs, old), *extra]).distinct(), "pairs")
        discard(spent)
        extra, spent = [], None
        n = pairs.count()
        comps, c = components(spark, _with_sets(pairs, n, sets), percent=percent) if n else (None, 0)
        if c:
            links.append(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        if step == 0:  # lists whose hubs are linked are one family, as near copies share most of their lists
            lists = _renewed(lists, comps, c, "hub")
        undone = written(spark, _undone(_renewed(lists, comps, c)), "lists") if lists is not None else None
        discard(*used, pairs)
        used, old, lists = [undone], [], None
        if undone is None or undone.isEmpty():
            continue
        step += 1
        # what lies outside the largest component of these meets all: then they are done
        few, many = undone.where(F.col("minor") <= HUBS), undone.where(F.col("minor") > HUBS)
        old.append(_met(few.select("token", *_CLASS), _hubs(few.where("comp <> most")), matches))
        if many.isEmpty():
            continue
        if step == 1:
            many = _merged(spark, many.select(F.col("hub").alias("token"), *_CLASS).dropDuplicates(["token", "num"]))
            used.append(many)
        sizes = many.groupBy("token").agg(F.count("*").alias("n"))
        extra.append(_paired(many.join(sizes.where(F.col("n") <= PAIRED), "token"), sets, percent))
        many = many.join(sizes.where(F.col("n") > PAIRED).select("token"), "token")
        if many.isEmpty():
            continue
        if step <= DEPTH:
            spent = written(spark, _centred(many.select("token", *_CLASS), sets, percent), "centred")
            lists, joined = _posted(spent, percent)
            extra.append(joined)
            before = written(spark, lists, "own")
            hubs = _first_hub(before)
        else:
            before, hubs = many, _some_hubs(many)
        hubs = written(spark, hubs, "hubs")
        some = written(spark, _met(before.select("token", *_CLASS), hubs, matches), "met")
        discard(before, hubs)
        used.append(some)
        old.append(some)
        lists = some.where(~F.array_contains("met", F.col("num"))).select("token", *_CLASS)
    discard(sets, *used)
    whole, n = components(spark, reduce(DataFrame.union, links)) if links else (None, 0)
    return _named(classes, whole, n)


def _named(classes: DataFrame, comps: DataFrame | None, n: int) -> DataFrame:
    """(cid, root, component): the number of each class's component and its smallest doc_id."""
    if not n:
        return classes.select("cid", F.col("num").alias("root"), F.col("rep").alias("component"))
    nodes = comps.union(comps.select("comp", "comp").distinct())
    least = nodes.join(classes.select(F.col("num").alias("id"), "rep"), "id").groupBy("comp").agg(F.min("rep").alias("component"))
    nodes = nodes.join(least, "comp").select(F.col("id").alias("num"), F.col("comp").alias("root"), "component")
    out = classes.join(small(nodes, 2 * n), "num", "left")
    return out.select("cid", F.coalesce("root", "num").alias("root"), F.coalesce("component", "rep").alias("component"))


def _sets(spark: SparkSession, docs: DataFrame, active: DataFrame, k: int, text: str) -> DataFrame:
    """(num, size, odd, shingles) of the classes in active (num, cid, rep), from the text of one row each; odd: parities()."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            keys, sizes, odd, sets = [], [], [], []
            for num, cid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                s = shingle_set(data, k)
                if _digest(s) == cid:  # another row of that doc_id may have another set
                    keys.append(num)
                    sizes.append(len(s))
                    odd.append(parities(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(odd, pa.binary()), pa.array(sets, pa.binary())], ["num", "size", "odd", "shingles"])

    active = written(spark, active, "active")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    found = texts.join(small(active, active.count()), "rep").select("num", "cid", "text").mapInArrow(made, "num long, size long, odd binary, shingles binary")
    sets = written(spark, found, "sets")
    discard(active)
    if sets.groupBy("num").count().where("count > 1").isEmpty():
        return sets
    once = written(spark, sets.dropDuplicates(["num"]), "sets")  # rows are repeated
    discard(sets)
    return once


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = written(docs.sparkSession, signatures(docs, k, text), "signatures")
    named = _linked(docs.sparkSession, docs, rows, k, percent, text, tied=True)
    out = rows.where("cid is not null").select("doc_id", "n_shingles", "cid").join(named.select("cid", "component"), "cid", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.union(rows.where("cid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest doc_id, of its texts the one with the smaller digest, once.

    Here rows of one doc_id with unlike texts are not tied: each is judged by its own text. Rows without doc_id
    stay, as nothing names them; so do rows without words, once each.
    """
    spark = docs.sparkSession
    rows = written(spark, signatures(docs, k, text), "signatures")
    named = _linked(spark, docs, rows, k, percent, text, tied=False)
    judged = rows.where("cid is not null and doc_id is not null").join(named.select("cid", "root"), "cid").select("root", "doc_id", "tkey")
    first = judged.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tkey")).alias("w")).where("n > 1")
    gone = judged.join(first, "root").where((F.col("doc_id") != F.col("w.doc_id")) | (F.col("tkey") != F.col("w.tkey")))
    gone = written(spark, gone.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).distinct(), "gone")
    again = rows.where("doc_id is not null").groupBy("doc_id", "tkey").count().where("count > 1")
    again = written(spark, again.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")), "again")
    keyed = docs.withColumn("_tkey", text_key(text))
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_tkey") == F.col("_key"))
    left = keyed.join(small(gone, gone.count()), same, "left_anti")
    if n := again.count():
        one = left.join(small(again, n), same, "left_semi").dropDuplicates(["doc_id", "_tkey"])
        left = left.join(small(again, n), same, "left_anti").unionByName(one)
    return left.select(*docs.columns)
