"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Each task writes archives of its own into the shared folder, under a temporary name until they are whole, so
a task that runs again replaces what it wrote. A dictionary is trained on the task's first records (at most
SAMPLE_RECORDS and SAMPLE_BYTES). The reader loads the dictionary, decodes frame by frame with one record in
memory, and fails on a bad header, length, digest, a frame that is cut off or a record too few.

Of records with equal payloads of at least `least` bytes, those with the largest page_id are responses, the
others revisits of it; smaller payloads are all responses. Null html is an empty payload. A null page_id is
smaller than any other; it reads back as null. A null url gives no target header; line ends in urls are
percent-encoded. Equal rows are records each by itself, with equal type. Other columns are not read. An empty
table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

MAGIC = 0x184D2A5D
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 256, 1 << 20, 32 << 10, 3
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, first: bytes) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(first):
        raise WarcError("no header block")
    out = {}
    for line in data[:end].decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:80]}")
        out[name.strip().lower()] = value.strip()
    return out, end + 4


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise WarcError(f"not a record id: {urn[:80]}")
    return int(urn[10:-1]) if urn[10:-1] else None


def parsed(data: bytes) -> dict:
    """One record, checked: its headers, lengths and, where it has the payload, its digest."""
    head, at = _headers(data, b"WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"):
        if name not in head:
            raise WarcError(f"no {name}")
    length = int(head["content-length"])
    if len(data) != at + length + 4 or data[at + length :] != b"\r\n\r\n":
        raise WarcError("the block is not as long as its header says")
    block = data[at : at + length]
    http, start = _headers(block, b"HTTP/1.")
    payload, said, digest = block[start:], int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response":
        if len(payload) != said or digest_of(payload) != digest:
            raise WarcError("the payload is not what its headers say")
    elif kind != "revisit" or payload or "warc-refers-to" not in head:
        raise WarcError(f"not a response or revisit: {kind}")
    return {"page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": said, "payload_digest": digest, "record_type": kind, "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on samples; their last bytes where they are too few to train on; none without samples."""
    if sum(map(len, samples)) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_frames(out, records: Iterable[bytes], trained: zstandard.ZstdCompressionDict | None) -> int:
    n = 0
    if trained is not None:
        data = trained.as_bytes()
        n += out.write(struct.pack("<II", MAGIC, len(data)) + data) or 0
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    for one in records:
        frame = packer.compress(one)
        out.write(frame)
        n += len(frame)
    return n


def read_frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The content of each frame; stream: anything with read(n)."""
    head = stream.read(8)
    if not head:
        return
    if len(head) < 8:
        raise WarcError("the archive is cut off")
    trained = None
    magic, size = struct.unpack("<II", head)
    if magic == MAGIC:
        data = stream.read(size)
        if len(data) != size:
            raise WarcError("the dictionary is cut off")
        if data[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be a frame itself
            data = zstandard.ZstdDecompressor().decompress(data)
        trained, head = zstandard.ZstdCompressionDict(data), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=trained)
    rest = head
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        frame, out = unpacker.decompressobj(), io.BytesIO()
        while True:
            out.write(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(chunk)
            if not rest:
                raise WarcError("a frame is cut off")
        yield out.getvalue()


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to (null for responses). Only digests that more than one row has are joined."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    many = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1").select("sha", "last")
    return rows.join(many, "sha", "left").select("page_id", "url", "html", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archives(typed: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes typed rows to archives under path; (archive, records) of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        rows = (record(p, u, (h or "").encode(), r) for b in batches for p, u, h, r in zip(*(c.to_pylist() for c in b.columns)))
        done: list[tuple[str, int]] = []
        held: list[bytes] = []
        size, more = 0, True
        while more:
            more = False
            for one in rows:
                held.append(one)
                size += len(one)
                if len(held) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                    more = True
                    break
            if not held:
                break
            name = f"{root}/part-{part:06d}-{len(done):04d}.warc.zst"
            new, count = f"{name}.{uuid.uuid4().hex}", 0

            def several() -> Iterator[bytes]:
                nonlocal count, size, more
                total = 0
                for one in held:
                    count += 1
                    total += len(one)
                    yield one
                held.clear()
                while total < archive_bytes:
                    one = next(rows, None)
                    if one is None:
                        more = False
                        break
                    count += 1
                    total += len(one)
                    yield one
                size = 0

            trained = dictionary(held[:])
            with fs.open_output_stream(new, compression=None) as out:
                write_frames(out, several(), trained)
            fs.move(new, name)
            done.append((name.removeprefix(root), count))
        yield pa.RecordBatch.from_arrays([pa.array([path + n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["archive", "records"])

    return written(typed.sparkSession, typed.mapInArrow(write, "archive string, records long"), "archives")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The checked records of the archives, one archive a task; an archive that was cut off between frames has too few."""
    schema = _READ + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = pyarrow.fs.FileSystem.from_uri(archive)
                rows, size, n = [], 0, 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for data in read_frames(stream):
                        rows.append(parsed(data))
                        n += 1
                        size += len(data) if with_payload else 0
                        if len(rows) >= 5000 or size > 16 << 20:
                            yield batched(rows)
                            rows, size = [], 0
                if records is not None and n != records:
                    raise WarcError(f"{archive} has {n} records of {records}")
                if rows:
                    yield batched(rows)

    def batched(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[x.split()[1]]) for n, x in zip(names, schema.split(", "))], names)

    n = max(1, archives.count())
    return archives.select("archive", "records").repartition(n).mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of all pages hold when they are read back."""
    spark = pages.sparkSession
    archives = write_archives(with_types(pages), fresh_path(spark, "warc"))
    return read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
