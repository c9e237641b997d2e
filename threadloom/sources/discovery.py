"""Which files and zip members hold conversations, and what else lies beside them."""

from __future__ import annotations

import json
import os
import re
import zipfile
from dataclasses import dataclass, field

PAYLOAD = re.compile(r"conversations(?:-\d+)?\.json")
_MARK = "var jsonData = "


@dataclass
class Inspection:
    sources: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)

    @property
    def can_ingest(self) -> bool:
        return bool(self.sources)


def label(source: dict) -> str:
    return "::".join(x for x in (source["path"], source.get("member")) if x)


def inspect_html(path: str) -> dict:
    """What a rendered page embeds: its size, and how many conversations of which times. Never a source."""
    out = {"path": path, "kind": "chat_html", "status": "unsupported_for_canonical_ingest", "reason": "a rendered page lacks the ids, graph and metadata that an archive needs; use the conversations JSON"}
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            page = f.read()
        out["size_bytes"] = len(page.encode("utf-8", "ignore"))
        at = page.find(_MARK)
        out["has_embedded_json_data"] = at >= 0
        if at >= 0 and isinstance(data := json.JSONDecoder().raw_decode(page, at + len(_MARK))[0], list):
            out["embedded_conversation_count"] = len(data)
            if times := [c["create_time"] for c in data if isinstance(c, dict) and c.get("create_time") is not None]:
                out |= {"embedded_min_create_time": min(times), "embedded_max_create_time": max(times)}
    except (OSError, ValueError, TypeError) as e:
        out["inspection_error"] = str(e)
    return out


def _beside(names: list[str], path: str, kind: str, found: Inspection) -> None:
    for name in names:
        if os.path.basename(name) == "chat.html":
            where = os.path.join(path, name) if kind == "folder" else f"{path}::{name}"
            found.diagnostics.append({"path": where, "kind": "chat_html", "status": "observed_not_ingested", "reason": f"in a {kind} with its JSON beside it" if any(PAYLOAD.fullmatch(os.path.basename(n)) for n in names) else f"in a {kind} without conversations JSON"})


def discover(paths: list[str]) -> Inspection:
    """Sources in order: folders list their payload files by name, zips their members by name at any depth."""
    found = Inspection()
    for path in paths:
        try:
            if os.path.isdir(path):
                names = sorted(os.listdir(path))
                own = [n for n in names if PAYLOAD.fullmatch(n) and os.path.isfile(os.path.join(path, n))]
                found.sources += [{"kind": "json_file", "path": os.path.join(path, n), "member": None, "origin": path} for n in own]
                _beside(names, path, "folder", found)
            elif path.lower().endswith(".zip"):
                with zipfile.ZipFile(path) as z:
                    names = sorted(i.filename for i in z.infolist() if not i.is_dir())
                own = [n for n in names if PAYLOAD.fullmatch(n.rsplit("/", 1)[-1])]
                found.sources += [{"kind": "zip_member", "path": path, "member": n, "origin": path} for n in own]
                _beside(names, path, "zip", found)
            elif os.path.basename(path).lower().endswith(".html"):
                found.diagnostics.append(inspect_html(path))
                continue
            elif path.lower().endswith(".json"):
                found.sources.append({"kind": "json_file", "path": path, "member": None, "origin": path})
                continue
            else:
                found.diagnostics.append({"path": path, "kind": "unknown", "status": "unsupported_input", "reason": "not a folder, zip, JSON or HTML file"})
                continue
            if not own:
                found.diagnostics.append({"path": path, "kind": "container", "status": "no_conversation_json_files", "reason": "no conversations.json or conversations-NNN.json"})
        except (OSError, zipfile.BadZipFile) as e:
            found.diagnostics.append({"path": path, "kind": "container", "status": "discovery_error", "reason": str(e)})
    return found
