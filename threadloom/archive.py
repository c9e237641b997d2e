"""A versioned archive of conversations: Parquet tables in buckets of conversations, and one manifest.

Tables are immutable. A run writes the buckets that it touches under a new version and then replaces the
manifest, which names the files of every bucket: until then nothing has changed, so a run is atomic, and a
reader keeps the version that it opened. One writer at a time holds the lock; a lock that a crash has left says
who held it since when, and unlock() removes it. What a run stages is removed at its end. The root may lie on any
file system that Hadoop knows.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import merge, normalize
from .sources.export import SCHEMA, read_exports
from .storage import Storage

VERSION = 2
BUCKETS, WRITERS = 16, 4
TABLES = ("conversations", "conversation_runs", "nodes", "node_children", "messages", "message_runs", "links", "attachments", "tool_calls", "tool_results", "message_index")


#: Schemas of the tables, as merge gives them.
_known: dict[str, StructType] = {}


class ArchiveError(RuntimeError):
    pass


def now_iso() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


class Archive:
    """root: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.store = Storage(spark, root)
        self.spark, self.root, self.buckets = spark, self.store.root, buckets

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/MANIFEST.json"

    def exists(self) -> bool:
        return self.store.exists(self.manifest_path)

    def manifest(self) -> dict:
        if not self.exists():
            return {"schema_version": VERSION, "version": 0, "buckets": self.buckets, "runs": [], "tables": {}}
        found = json.loads(self.store.read(self.manifest_path))
        if found.get("schema_version") != VERSION:
            raise ArchiveError(f"the archive has schema version {found.get('schema_version')}; this is {VERSION}")
        return found

    def _flip(self, manifest: dict) -> None:
        self.store.replace(self.manifest_path, json.dumps(manifest, indent=2, sort_keys=True))

    @contextlib.contextmanager
    def _lock(self):
        path = self.store.at("LOCK")
        try:
            self.store.create(path, json.dumps({"application": self.spark.sparkContext.applicationId, "since": now_iso()}))
        except FileExistsError as e:
            raise ArchiveError(f"another run is writing this archive: {self.store.read(path)}") from e
        try:
            yield
        finally:
            self.store.remove(path)

    def unlock(self) -> None:
        """Removes the lock of a run that has crashed; the archive is as it was before that run."""
        self.store.remove(self.store.at("LOCK"))

    def _schemas(self) -> dict:
        if not _known:
            snaps = normalize.snapshots(self.spark.createDataFrame([], SCHEMA), "")
            empty = self.spark.createDataFrame([], snaps.schema)
            _known.update({n: df.schema for n, df in merge.merge({}, normalize.entities(empty), "", "").items()})
        return _known

    def table(self, name: str, buckets: set[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The table as the manifest has it; buckets: only these."""
        if name == "runs":
            rows = [(r["run_id"], r["source"], r["started_at"], r["finished_at"], json.dumps(r["stats"], sort_keys=True)) for r in self.manifest()["runs"]]
            return self.spark.createDataFrame(rows, "run_id string, source string, started_at string, finished_at string, stats string")
        files = (manifest or self.manifest())["tables"].get(name, {})
        paths = [f"{self.root}/{p}" for b, p in files.items() if buckets is None or int(b) in buckets]
        schema = self._schemas()[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def tables(self) -> dict[str, DataFrame]:
        manifest = self.manifest()
        return {n: self.table(n, manifest=manifest) for n in TABLES}

    def bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.manifest()["buckets"])).cast("int")

    def bucket_of(self, conversation_id: str) -> set[int]:
        """The bucket that holds a conversation, found without reading any."""
        return {self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(conversation_id)), F.lit(self.manifest()["buckets"])).cast("int")).first()[0]}

    def write(self, tables: dict[str, DataFrame], buckets: set[int], run: dict | None, manifest: dict | None = None) -> None:
        """The tables' rows become those of the buckets, in one step; manifest: what they are added to, if not the present one."""
        manifest = manifest or self.manifest()
        version = manifest["version"] + 1
        known = self._schemas()
        folder = f"v={version}-{uuid.uuid4().hex[:8]}"

        def put(name: str) -> None:
            key = "id" if name == "conversations" else "conversation_id"
            rows = tables[name].select(*known[name].fieldNames(), F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])).cast("int").alias("_bucket"))
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}/{name}")

        with ThreadPoolExecutor(WRITERS) as pool:  # tables are independent jobs
            list(pool.map(put, tables))
        for name in tables:
            files = manifest["tables"].setdefault(name, {})
            for b in buckets:
                files.pop(str(b), None)
                if self.store.exists(f"{self.root}/{folder}/{name}/_bucket={b}"):
                    files[str(b)] = f"{folder}/{name}/_bucket={b}"
        if run:
            manifest["runs"].append(run)
        manifest["version"] = version
        self._flip(manifest)

    def ingest(self, sources: list[dict], run_id: str, streaming: bool = True) -> dict:
        """Merges the sources as one run; any error leaves the archive as it was. The result has status and counts."""
        with self._lock():
            manifest = self.manifest()
            if any(r["run_id"] == run_id for r in manifest["runs"]):
                return {"status": "skipped", "run_id": run_id, "errors": [], "stats": {}}
            return self._ingested(sources, run_id, streaming, manifest)

    def _ingested(self, sources: list[dict], run_id: str, streaming: bool, manifest: dict) -> dict:
        started = now_iso()
        staged = f"{self.root}/staging-{uuid.uuid4().hex}"
        try:
            read_exports(self.spark, sources, streaming).write.parquet(staged)  # exports are decoded once
            decoded = self.spark.read.schema(self.spark.createDataFrame([], SCHEMA).schema).parquet(staged)
            errors = [r.asDict() for r in decoded.where("error is not null").select("source_label", "ordinal", "error").orderBy("source_label", "ordinal").collect()]
            if errors:
                return {"status": "failed", "run_id": run_id, "errors": errors, "stats": {}}
            snaps = normalize.snapshots(decoded, run_id)
            snaps.write.parquet(f"{staged}-snapshots")  # each entity starts from these rows
            snaps = self.spark.read.schema(snaps.schema).parquet(f"{staged}-snapshots")
            new = normalize.entities(snaps)
            stats = merge.counts(new)
            touched = {r[0] for r in decoded.where("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(manifest["buckets"])).cast("int")).distinct().collect()}  # at most as many as there are buckets
            old = {n: self.table(n, touched, manifest) for n in TABLES} if manifest["tables"] else {}
            run = {"run_id": run_id, "source": ", ".join(s["path"] for s in sources), "started_at": started, "finished_at": now_iso(), "stats": stats}
            self.write(merge.merge(old, new, run_id, started, f"{staged}-folded"), touched, run)
            return {"status": "success", "run_id": run_id, "errors": [], "stats": stats}
        finally:
            for part in ("", "-snapshots", "-folded"):
                self.store.remove(staged + part)

    def dump(self, target: str) -> None:
        """A copy of the current version; the index is left out, as it follows from the messages."""
        to = Storage(self.spark, target)
        for name, df in self.tables().items():
            if name != "message_index":
                df.write.mode("error").parquet(to.at(name))
        to.create(to.at("META.json"), json.dumps({"schema_version": VERSION, "runs": self.manifest()["runs"]}, indent=2))

    @classmethod
    def restore(cls, spark: SparkSession, source: str, root: str, force: bool = False) -> Archive:
        archive, there = cls(spark, root), Storage(spark, source)
        meta = json.loads(there.read(there.at("META.json")))
        if meta["schema_version"] != VERSION:
            raise ArchiveError(f"the dump has schema version {meta['schema_version']}; this is {VERSION}")
        if archive.exists() and not force:
            raise ArchiveError("the target exists; use force to replace it")
        with archive._lock():
            known = archive._schemas()
            tables = {n: spark.read.schema(known[n]).parquet(there.at(n)) for n in TABLES if n != "message_index"}
            tables["message_index"] = merge.index(tables["messages"])
            version = archive.manifest()["version"] if archive.exists() else 0
            fresh = {"schema_version": VERSION, "version": version, "buckets": archive.buckets, "runs": meta["runs"], "tables": {}}
            archive.write(tables, set(range(archive.buckets)), None, fresh)  # until this ends, what was there stands
        return archive
