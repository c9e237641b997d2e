"""Packing, archives and sharding: exact round trips, and what their methods promise."""

import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pytest
from corpus import documents, pages

from threadloom.llm import packing, queries, sharding, warc

Q = queries.queries()


def _ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    return [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in documents()]


def test_op2_places_every_token(spark, sf_dir, empty_dir):
    rows = Q["op2_best_fit_packing"](spark, sf_dir).collect()
    want = []
    for doc_id, ids in _ids():
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            want.append((doc_id, piece, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 2048
    lengths = {}
    for r in rows:
        lengths[r["length"]] = lengths.get(r["length"], 0) + 1
    assert len(sequences) == packing.lower_bound(lengths, 2048)
    assert Q["op2_best_fit_packing"](spark, empty_dir).collect() == []


def test_sequences_hold_the_ids(spark, docs):
    packed = packing.pack(docs, queries.tokenizer_path(), with_ids=True)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed).collect()}
    want = dict(_ids())
    for r in packed.select("doc_id", "start", "length", "sequence_id", "offset").collect():
        assert list(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]) == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def _fewest(sizes, capacity):
    """Sequences of an optimal packing, by search over all dealings."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 11))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        patterns = packing.pack_histogram(counts, 60)
        used = {}
        for filling, times in patterns:
            assert sum(filling) <= 60
            for s in filling:
                used[s] = used.get(s, 0) + times
        assert used == counts
        n = sum(t for _, t in patterns)
        assert packing.lower_bound(counts, 60) <= _fewest(sizes, 60) == n


def test_dominance_and_bad_lengths():
    assert packing.dominates((7, 3), (6, 3)) and packing.dominates((9,), (5, 4)) and not packing.dominates((5, 4), (9,))
    assert packing.pack_histogram({}) == []
    with pytest.raises(ValueError):
        packing.pack_histogram({2049: 1})


def test_op3_round_trip(spark, sf_dir, empty_dir):
    rows = Q["op3_warc"](spark, sf_dir).collect()
    last = {}
    for i, _, html, *_ in pages():
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html, *_ in pages():
        data, to = (html or "").encode(), last[html or ""]
        want.append((i is None, i or 0, len(data), warc.digest_of(data), *(("response", -1) if i == to else ("revisit", to))))
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in rows) == sorted(want)
    assert Q["op3_warc"](spark, empty_dir).collect() == []


def test_archives_are_frames_behind_a_dictionary(spark, sf_dir, tmp_path):
    import struct

    import zstandard

    typed = warc.with_types(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=10)
    archives = warc.write_archives(typed, f"file://{tmp_path}/archives")
    assert sum(r["records"] for r in archives.collect()) == len(pages())
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, archives, with_payload=True).where("record_type = 'response'").collect()}
    last = max(i for i, _, html, *_ in pages() if html == pages()[4][2] and i is not None)
    assert payloads[last] == pages()[4][2].encode() and 4 not in payloads and payloads[0] == payloads[1] == b""  # below `least`
    data = open(archives.first()["archive"].removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert 0x184D2A50 <= magic <= 0x184D2A5F
    unpacker, at, n = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), 8 + size, 0
    while at < len(data):
        frame = unpacker.decompressobj()
        assert frame.decompress(data[at:]).startswith(b"WARC/1.1\r\n")
        at, n = len(data) - len(frame.unused_data), n + 1
    assert n == archives.first()["records"]


def test_damaged_archives_are_refused():
    records = [warc.record(i, "http://x", b"payload %d" % i, None) for i in range(40)]
    out = io.BytesIO()
    warc.write_frames(out, records, warc.dictionary(records))
    assert list(warc.read_frames(io.BytesIO(out.getvalue()), chunk=7)) == records
    for bad in (out.getvalue()[:-3], out.getvalue()[:5], out.getvalue()[:20]):
        with pytest.raises((warc.WarcError, Exception)):
            list(warc.read_frames(io.BytesIO(bad)))
    one = records[0]
    for bad in (one[:-1], one + b"x", one.replace(b"payload 0", b"payload 1"), one.replace(b"WARC/1.1", b"XARC/1.1"), one.replace(b"WARC-Date", b"WARC-Data"), one.replace(b"response\r\n", b"metadata\r\n", 1)):
        with pytest.raises(warc.WarcError):
            warc.parsed(bad)
    assert warc.parsed(one)["payload"] == b"payload 0" and warc.parsed(warc.record(None, None, b"", 5))["refers_to"] == 5
    assert list(warc.read_frames(io.BytesIO(b""))) == []


def test_op10_covers_all_rows(spark, sf_dir, empty_dir):
    rows = Q["op10_sharding"](spark, sf_dir).collect()
    data = lambda r: (r["text"] or "").encode()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((r["doc_id"], len(data(r)) + 8, zlib.crc32(data(r))) for r in documents())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Q["op10_sharding"](spark, empty_dir).collect() == []


def test_shards_are_near_equal_and_only_affected_ones_are_written(spark, tmp_path):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, "x" * rng.randint(0, 400)) for i in range(6000)], "doc_id long, text string").repartition(5)
    out = sharding.reshard(df, sharding.old_layout())
    sizes = {r[0]: r[1] for r in out.groupBy("shard").sum("size").collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 3 * 408
    stays, total = (x.groupBy().sum("size").first()[0] for x in (out.where("shard = old_shard"), out))
    assert stays > 0.64 * total  # 16 of 24 shards keep what they can hold
    there = sharding.rewrite(spark, out, str(tmp_path / "s"), affected=[1, 2])
    assert {r[0] for r in there.select("shard").distinct().collect()} == {1, 2}
    assert 0 in sharding.affected_shards(out)


def test_flow_moves_the_fewest():
    rng = random.Random(8)
    for _ in range(40):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        sizes = [rng.randint(0, 4) for _ in range(n)]
        capacities = [rng.randint(0, 5) for _ in range(m)]
        if sum(sizes) > sum(capacities):
            with pytest.raises(ValueError):
                sharding.min_cost_flow(sizes, capacities)
            continue
        flow = sharding.min_cost_flow(sizes, capacities)
        assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(n)] == sizes
        assert all(sum(x for (_, j), x in flow.items() if j == k) <= capacities[k] for k in range(m))
        moved = sum(x for (i, j), x in flow.items() if i != j)
        stay = max(sum(s) for s in itertools.product(*(range(min(sizes[k], capacities[k]) + 1) if k < m else (0,) for k in range(n))))
        assert moved == sum(sizes) - stay


def test_digest_is_base32():
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1().digest()) == 20
