"""Near-duplicates and decontamination against brute force."""

import random

import pytest
from corpus import WORDS, benchmark, components, documents, hits, prose
from pyspark.sql import functions as F

from threadloom.llm import decontam, neardup, queries


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op9_equals_all_pairs(spark, sf_dir):
    rows = queries.queries()["op9_minhash_near_dedup"](spark, sf_dir).collect()
    want = components([(r["doc_id"], r["text"]) for r in documents()], 3, 85)
    assert len(rows) == len(documents())
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == {(i, n, c) for i, (n, c) in want.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert len({c for _, c in want.values()}) < len(want) - 8


def test_chains_and_groups_of_copies(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for group in range(3):  # each text is near the next one only
        words = prose(rng, 150).split()
        for _ in range(40):
            for _ in range(4):
                words[rng.randrange(150)] = rng.choice(WORDS)
            rows.append((at, " ".join(words)))
            at += 1
    copy = prose(rng, 80)
    rows += [(at + i, copy) for i in range(60)]
    shared = prose(rng, 60)  # a passage that many texts share, none of them near another
    rows += [(at + 60 + i, shared + " " + prose(rng, 70)) for i in range(50)]
    rng.shuffle(rows)
    got = _by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    want = components(rows, 5, 80)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_null_ids_ties_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words are said here now"), (4, "other words are said here now"), (5, None), (None, "alone with no number at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).where("n_shingles > 0").collect() if r["component_id"] is not None)
    assert got == [(False, 3, 3, True), (False, 3, 3, True), (False, 4, 3, False), (True, 0, 3, False)]
    # both texts of doc_id 3 stay, as neither is a copy of the other; the copy of one, doc_id 4, goes
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep(df).collect()) == [(0, "a b c d e f"), (0, "alone with no number at all"), (3, "a b c d e f"), (3, "other words are said here now"), (5, "")]
    assert neardup.near_duplicates(df.where("false")).collect() == []


def test_matches_for_keeps_the_chance_of_a_miss():
    from math import comb

    for percent in (50, 80, 85, 95):
        m = neardup.matches_for(percent)
        p = percent / 100
        assert sum(comb(neardup.COORDS, n) * p**n * (1 - p) ** (neardup.COORDS - n) for n in range(m)) <= neardup.MISS
        assert 1 <= m <= neardup.COORDS


@pytest.mark.parametrize("bound", [decontam.BROADCAST_BYTES, 0])
def test_hits_equal_brute_force(spark, docs, bound):
    """Both ways of the join, with the columns of docs untouched."""
    tests = spark.createDataFrame(benchmark(), "item_id long, text string, key string, x long")
    found = decontam.find_hits(docs, tests, bound=bound)
    assert set(docs.columns) <= set(found.columns)
    items = [(i, t) for i, t, *_ in benchmark() if t is not None]
    want = sorted((r["doc_id"], *hits(r["text"], items)[:3]) for r in documents())
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["hit_items"])) for r in found.collect()) == want
    assert sum(x[2] > 0 for x in want) >= 5
    left = {r["doc_id"]: decontam.without_hits(r["text"], [(x["start"], x["end"]) for x in r["hit_spans"]]) for r in found.where("n_hit > 0").collect()}
    assert left == {r["doc_id"]: hits(r["text"], items)[3] for r in documents() if hits(r["text"], items)[1]}


def test_op7_digests(spark, sf_dir, empty_dir):
    import hashlib

    rows = queries.queries()["op7_benchmark_decontamination"](spark, sf_dir).collect()
    items = [(i, t) for i, t, *_ in benchmark() if t is not None]
    for r in rows:
        n, hit, ids, _ = hits(next(d["text"] for d in documents() if d["doc_id"] == r["doc_id"]), items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert queries.queries()["op7_benchmark_decontamination"](spark, empty_dir).collect() == []


def test_no_benchmark_and_every_shared_span(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, prose(rng, 60)) for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_hits(docs, none).agg(F.sum("n_hit")).first()[0] == 0
    for bound in (1 << 20, 0):  # any span of 13 words is found, wherever it lies
        texts = [r["text"].split() for r in docs.orderBy("doc_id").collect()]
        tests = spark.createDataFrame([(i, " ".join([*prose(rng, i).split(), *t[i : i + 13], *prose(rng, 9).split()])) for i, t in enumerate(texts)], "item_id long, text string")
        assert decontam.find_hits(docs, tests, bound=bound).where("n_hit >= 13").count() == 20


def test_components_by_one_task_and_by_stars(spark):
    """Paths, stars and rings whose links lie in several tasks, put together by one task and by steps over all."""
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (7, 8)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {200 + i: 200 for i in range(1, 9)}
    for one_task in (neardup.ONE_TASK, 0):
        found, n = neardup.components(spark, df, one_task)
        assert {r["id"]: r["comp"] for r in found.collect()} == want and n >= len(want)
    assert neardup.components(spark, df.where("a = b"))[1] == 0


def test_families_that_share_a_passage_are_centred(spark):
    """Texts of one long passage and a little of their own: all meet, few are linked, with and without broadcasts."""
    rng = random.Random(12)
    passage = prose(rng, 90)
    rows = [(i, passage + " " + prose(rng, 40)) for i in range(60)]
    rows += [(60 + i, " ".join([*rows[i][1].split()[:-3], *prose(rng, 3).split()])) for i in range(0, 60, 3)]
    got = _by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    want = components(rows, 5, 80)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert 1 < len({c for _, c in want.values()}) < len(want)


def test_equal_lists_and_overlapping_families_are_one(spark):
    rows = [(t, n, 1, n, *[0] * len(neardup._SKETCH)) for t, nums in {1: [1, 2, 3], 2: [1, 2, 3], 3: [2, 3, 4, 5], 4: [7, 8, 9]}.items() for n in nums]
    lists = spark.createDataFrame(rows, ["token", *neardup._CLASS])
    assert sorted((r["token"], r["num"]) for r in neardup._undone(lists).collect()) == [(1, 1), (1, 2), (1, 3), (3, 2), (3, 3), (3, 4), (3, 5), (4, 7), (4, 8), (4, 9)]
    merged = neardup._merged(spark, lists).select("token", "num").collect()
    assert sorted((r["token"], r["num"]) for r in merged) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (4, 7), (4, 8), (4, 9)]


def _edited(bases, variants, edits):
    """Texts of a few bases, each variant with edits of its own from a small vocabulary, and a near copy of every tenth."""
    rng = random.Random(21)
    shared = prose(rng, 80).split()
    rows = []
    for _ in range(bases):
        base = shared + prose(rng, 60).split()
        for i in range(variants):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append(" ".join(words))
            if i % 10 == 0:
                rows.append(" ".join([*words[:-1], f"own{i}"]))
    return list(enumerate(rows))


def test_the_classes_of_a_family_are_posted_once(spark, monkeypatch):
    """Its lists overlap, so that centring each of them anew made rows with the square of the family."""
    made, real = [], neardup.written

    def counted(spark, df, name, *more):
        out = real(spark, df, name, *more)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(neardup, "written", counted)
    rows = _edited(3, 60, 5)
    got = _by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == components(rows, 5, 80)
    assert sum(n for name, n in made if name == "centred") <= len(rows)


def test_centred_families_equal_all_pairs(spark, monkeypatch):
    """Every list is centred, none is looked at pair by pair."""
    monkeypatch.setattr(neardup, "PAIRED", 0, raising=False)
    rows = _edited(2, 40, 4)
    got = _by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    want = components(rows, 5, 80)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert 1 < len({c for _, c in want.values()}) < len(want)


def test_parities_never_show_more_differences_than_there_are():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for n in (0, 1, 40, 900, 4000):
        y = np.concatenate((x[n:], rng.integers(0, 1 << 63, n // 2).astype(np.uint64)))
        a, b = (np.frombuffer(neardup.parities(s), np.uint8) for s in (x, y))
        seen = int(np.bitwise_count(a ^ b).sum())
        assert seen <= n + n // 2 and (n > 40 or seen >= 0.9 * (n + n // 2))
