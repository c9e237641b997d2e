"""The library's surface: everything that can be asked of an archive."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .archive import TABLES, VERSION, Archive, ArchiveError
from .functions import first_truthy
from .operators import export
from .operators.check import integrity_errors
from .operators.profile import REPORT_VERSION, profile_export
from .operators.search import QuerySyntaxError, matches
from .sources.discovery import Inspection, discover

__all__ = ["Archive", "ArchiveError", "IngestError", "IngestResult", "QuerySyntaxError", "check", "contract", "conversation_detail", "conversations", "dump", "export_bundle", "export_conversation", "export_conversations", "ingest_exports", "inspect_inputs", "list_runs", "profile_export", "restore", "search", "session"]

CONTRACT_VERSION = 1
ORDER_COLUMNS = (
    "id", "title", "created_at", "updated_at", "earliest_message_at", "latest_message_at", "default_model", "is_archived", "is_starred", "message_count", "message_count_main_path",
    "user_message_count", "assistant_message_count", "system_message_count", "tool_message_count", "safe_url_count", "blocked_url_count",
)


@dataclass
class IngestResult:
    status: str
    run_id: str
    database: str
    inputs: list[str]
    mode: str = "skip_existing"
    streaming: bool = True
    sources: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    stats: dict[str, int] = field(default_factory=dict)
    started_at: str | None = None
    finished_at: str | None = None

    @property
    def ok(self) -> bool:
        return self.status in ("success", "skipped")


class IngestError(RuntimeError):
    def __init__(self, result: IngestResult):
        super().__init__(f"ingest {result.status}: {(result.errors or result.diagnostics)[:3]}")
        self.result = result


def session(app: str = "threadloom") -> SparkSession:
    """The active session, or a local one; times are UTC."""
    spark = SparkSession.builder.appName(app).config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


def inspect_inputs(inputs: list[str]) -> Inspection:
    return discover([os.path.abspath(os.fspath(p)) for p in inputs])


def ingest_exports(spark: SparkSession, inputs: list[str], database: str, *, run_id: str | None = None, streaming: bool = True, mode: str = "skip_existing", trace_path: str | None = None, raise_on_failure: bool = True) -> IngestResult:
    """Merges exports into the archive as one run. A run id that the archive has is skipped unread; any error leaves the archive as it was."""
    if not inputs:
        raise ValueError("there is nothing to ingest")
    if mode != "skip_existing":
        raise ValueError(f"not a mode: {mode}")
    paths = [os.path.abspath(os.fspath(p)) for p in inputs]
    run_id = run_id or datetime.now(UTC).strftime("%Y-%m-%dT%H-%M-%S-%fZ")
    found = discover(paths)
    result = IngestResult("failed", run_id, os.path.abspath(database), paths, mode, streaming, found.sources, found.diagnostics, started_at=_now())
    if found.can_ingest:
        done = Archive(spark, database).ingest(found.sources, run_id, streaming)
        result.status, result.errors, result.stats = done["status"], done["errors"], done["stats"]
    result.finished_at = _now()
    if trace_path:
        with open(trace_path, "w", encoding="utf-8") as f:
            json.dump(asdict(result), f, indent=2, sort_keys=True)
    if raise_on_failure and not result.ok:
        raise IngestError(result)
    return result


def order_columns(text: str | None) -> list:
    """`column [ASC|DESC]` as sort columns; descending unless said otherwise; nulls first going up, last going down."""
    words = (text or "").split()
    if not words:
        return [F.desc_nulls_last(_latest()), F.col("id")]
    if len(words) > 2 or words[0] not in ORDER_COLUMNS or words[1:] and words[1].upper() not in ("ASC", "DESC"):
        raise ValueError(f"cannot order by {text!r}")
    up = words[1:] and words[1].upper() == "ASC"
    return [F.asc_nulls_first(words[0]) if up else F.desc_nulls_last(words[0]), F.col("id")]


def _latest():
    return first_truthy(F.col("updated_at"), F.col("latest_message_at"), F.col("created_at"))


def conversations(archive: Archive, limit: int = 10, order_by: str | None = None) -> DataFrame:
    """The first conversations in that order; a negative limit gives all."""
    rows = archive.table("conversations").drop("notes").orderBy(*order_columns(order_by))
    return rows if limit < 0 else rows.limit(limit or 10)


def conversation_detail(archive: Archive, conversation_id: str, include_hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """The conversation and its messages in order; an unknown id gives two empty frames."""
    own = archive.bucket_of(conversation_id)
    one = archive.table("conversations", own).where(F.col("id") == conversation_id).drop("notes")
    said = archive.table("messages", own).where(F.col("conversation_id") == conversation_id)
    return one, export.visible(said, include_hidden).orderBy("time_index")


def search(archive: Archive, q: str, *, role: str | None = None, kind: str | None = None, conversation_id: str | None = None, run_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Hits, latest first. The index is filtered by the query first; only its hits are joined."""
    hits = archive.table("message_index").where(matches(q, {"role": F.col("role"), "text": F.col("text")}, are_tokens=True))
    if run_id is not None:
        hits = hits.where(F.col("run_id") == run_id)
    if conversation_id is not None:
        hits = hits.where(F.col("conversation_id") == conversation_id)
    m = archive.table("messages")
    for column, value in (("role", role), ("message_kind", kind), ("conversation_id", conversation_id)):
        if value is not None:
            m = m.where(F.col(column) == value)
    rows = m.withColumnRenamed("id", "message_id").join(hits.select("conversation_id", "message_id"), ["conversation_id", "message_id"])
    rows = rows.select("conversation_id", "message_id", "created_at", "role", "message_kind", "text").orderBy(F.desc_nulls_last("created_at"), "conversation_id", "message_id")
    return rows.offset(offset).limit(limit) if limit >= 0 else rows.offset(offset)


def _rendered(convs: DataFrame, messages: DataFrame, form: str, frontmatter: bool) -> DataFrame:
    return export.render_text(convs, messages) if form == "text" else export.render_markdown(convs, messages, frontmatter)


def _plain(row) -> dict:
    return {k: (list(v) if isinstance(v, list) else v) for k, v in row.asDict(recursive=True).items()}


def export_conversation(archive: Archive, conversation_id: str, form: str = "markdown", output: str | None = None, include_hidden: bool = False, frontmatter: bool = False) -> str | None:
    """One conversation as markdown, text or json; null if there is none of that id."""
    one, said = conversation_detail(archive, conversation_id, include_hidden)
    if (row := one.first()) is None:
        return None
    if form == "json":
        content = json.dumps({"conversation": _plain(row), "messages": [_plain(r) for r in said.collect()]}, indent=2, default=str)
    else:
        content = _rendered(one, said, form, frontmatter).first()["content"]
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(content)
    return content


def file_name(conversation_id: str, form: str) -> str:
    """Ids become file names without a way out of the folder."""
    safe = conversation_id if re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", conversation_id) else quote(conversation_id, safe="").replace(".", "%2E")
    return f"{safe}.{'md' if form == 'markdown' else 'txt'}"


def export_conversations(archive: Archive, output_dir: str, query: str | None = None, limit: int = 20, form: str = "markdown", include_hidden: bool = False, frontmatter: bool = False) -> list[str]:
    """A file for each of the first conversations (all hits of the query, by id, or the latest); names as written."""
    convs = archive.table("conversations")
    if query:
        hits = archive.table("message_index").where(matches(query, {"role": F.col("role"), "text": F.col("text")}, are_tokens=True)).select(F.col("conversation_id").alias("id")).distinct().orderBy("id").limit(limit)
        convs = convs.join(hits, "id", "left_semi")
    else:
        convs = convs.orderBy(*order_columns(None)).limit(limit)
    said = archive.table("messages").join(convs.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    os.makedirs(output_dir, exist_ok=True)
    names = []
    for row in _rendered(convs, export.visible(said, include_hidden), form, frontmatter).select("id", "content").toLocalIterator():
        names.append(file_name(row["id"], form))
        with open(os.path.join(output_dir, names[-1]), "w", encoding="utf-8") as f:
            f.write(row["content"])
    return sorted(names)


def export_bundle(archive: Archive, output: str, since_days: int = 9, today: str | None = None, include_hidden: bool = False) -> int:
    """One markdown file of the conversations since that day (by date, UTC); how many there are."""
    day = F.lit(today or datetime.now(UTC).strftime("%Y-%m-%d")).cast("date")
    at = F.coalesce("created_at", "updated_at", "latest_message_at")
    convs = archive.table("conversations").where(F.to_date(F.substring(at, 1, 10)) >= F.date_sub(day, since_days))
    said = archive.table("messages").join(convs.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    os.makedirs(os.path.dirname(output) or ".", exist_ok=True)
    n = 0
    with open(output, "w", encoding="utf-8") as f:
        f.write("# Conversation Bundle\n")
        for row in export.bundle(convs, export.visible(said, include_hidden)).toLocalIterator():
            f.write(f"\n{row['content']}\n\n\n---\n\n")
            n += 1
    return n


def check(archive: Archive) -> dict:
    errors = [_plain(r) for r in integrity_errors(archive.tables()).orderBy("type", "conversation_id", "entity_id").collect()]
    return {"ok": not errors, "errors": errors}


def list_runs(archive: Archive) -> DataFrame:
    return archive.table("runs").orderBy(F.desc_nulls_last("started_at"), "run_id")


def dump(archive: Archive, output: str) -> None:
    archive.dump(output)


def restore(spark: SparkSession, source: str, database: str, force: bool = False) -> Archive:
    return Archive.restore(spark, source, database, force)


def contract() -> dict:
    """What a client may rely on."""
    return {
        "implementation_id": "threadloom",
        "contract_version": CONTRACT_VERSION,
        "package_version": __version__,
        "canonical_schema_version": VERSION,
        "input_kinds": ["json_file", "export_folder", "zip_file"],
        "diagnostic_input_kinds": ["chat_html"],
        "structural_profile": {"report_version": REPORT_VERSION, "content_free": True},
        "ingest_semantics": {"atomic": True, "rejects_partial_runs": True, "structured_source_results": True},
        "name": "threadloom",
        "version": __version__,
        "schema_version": VERSION,
        "tables": [*TABLES, "runs"],
        "inputs": ["conversations.json and conversations-NNN.json in a folder", "the same in a zip at any depth", "any *.json file"],
        "observed_only": ["chat.html"],
        "modes": ["skip_existing"],
        "message_kinds": ["user_visible_user", "user_visible_assistant", "system_context", "internal_reasoning", "tool_call", "tool_result", "unknown"],
        "operations": ["inspect_inputs", "profile_export", "ingest_exports", "query", "search", "export_conversation", "export_conversations", "export_bundle", "check", "list_runs", "dump_db", "restore_db"],
        "commands": ["ingest", "query", "search", "export-conversation", "export-conversations", "export-bundle", "check", "list-runs", "dump-db", "restore-db", "contract", "inspect-inputs", "profile-input"],
        "atomic_runs": True,
    }
