"""`python -m threadloom`: the library's operations as commands. The exit code is 1 when one fails."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import asdict

from . import api


def _flag(text: str) -> bool:
    return str(text).lower() in ("true", "1", "yes")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadloom", description="Archives of branching conversations on Spark")
    for name in ("--quiet", "--verbose", "--json"):
        p.add_argument(name, action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(*names: str, db: bool = True):
        c = sub.add_parser(names[0], aliases=list(names[1:]))
        if db:
            c.add_argument("--db", required=True)
        return c

    c = command("parse-and-ingest", "canonical-ingest")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--run-id")
    c.add_argument("--mode", default="skip_existing", choices=["skip_existing"])
    c.add_argument("--no-streaming", action="store_true")
    c.add_argument("--trace-run")
    c = command("query")
    c.add_argument("type", choices=["conversations", "conversation_detail"])
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--conversation-id")
    c.add_argument("--include-hidden", type=_flag, default=False)
    c.add_argument("--format", choices=["text", "json"], default="text")
    c.add_argument("--order-by")
    c = command("search")
    c.add_argument("--q", required=True)
    for name in ("--role", "--kind", "--conversation-id", "--run-id"):
        c.add_argument(name)
    c.add_argument("--limit", type=int, default=50)
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--format", choices=["text", "json"], default="json")
    c = command("export-conversation")
    c.add_argument("--conversation-id", required=True)
    c.add_argument("--format", choices=["markdown", "text", "json"], default="markdown")
    c.add_argument("--output")
    c.add_argument("--include-hidden", type=_flag, default=False)
    c.add_argument("--frontmatter", action="store_true")
    c = command("export-conversations")
    c.add_argument("--query")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--output-dir", default="./exports")
    c.add_argument("--format", choices=["markdown", "text"], default="markdown")
    c.add_argument("--include-hidden", type=_flag, default=False)
    c.add_argument("--frontmatter", action="store_true")
    c = command("export-bundle")
    c.add_argument("--since-days", type=int, default=9)
    c.add_argument("--output-markdown", default="./exports/recent_bundle.md")
    c.add_argument("--include-hidden", type=_flag, default=False)
    c = command("check")
    c.add_argument("--format", choices=["text", "json"], default="json")
    c = command("list-runs")
    c.add_argument("--format", choices=["text", "json"], default="text")
    command("dump-db").add_argument("--output", required=True)
    c = command("restore-db")
    c.add_argument("--input", required=True)
    c.add_argument("--force", action="store_true")
    command("contract", db=False)
    command("inspect-inputs", db=False).add_argument("inputs", nargs="+")
    c = command("profile-input", db=False)
    c.add_argument("input")
    c.add_argument("--label", default="input")
    c.add_argument("--acquired-on")
    return p


def _show(rows, form: str, line=None) -> None:
    rows = [api._plain(r) for r in rows]
    if form == "json":
        print(json.dumps(rows, indent=2, default=str, ensure_ascii=False))
    else:
        for r in rows:
            print(line(r) if line else json.dumps(r, default=str, ensure_ascii=False))


def run(a: argparse.Namespace) -> int:
    if a.command == "contract":
        print(json.dumps(api.contract(), indent=2))
        return 0
    if a.command == "inspect-inputs":
        found = api.inspect_inputs(a.inputs)
        print(json.dumps({**asdict(found), "can_ingest": found.can_ingest}, indent=2))
        return 0 if found.can_ingest else 1
    spark = api.session()
    if a.command == "profile-input":
        report = api.profile_export(spark, a.input, a.label, a.acquired_on)
        print(json.dumps(report, indent=2, sort_keys=True))
        return 0 if report["compatibility"] == "candidate_supported" else 1
    if a.command == "restore-db":
        api.restore(spark, a.input, a.db, a.force)
        return 0
    if a.command in ("parse-and-ingest", "canonical-ingest"):
        result = api.ingest_exports(spark, a.inputs, a.db, run_id=a.run_id, streaming=not a.no_streaming, mode=a.mode, trace_path=a.trace_run, raise_on_failure=False)
        print(json.dumps(asdict(result), indent=2) if a.json else f"{result.status}: run {result.run_id}, {result.stats}")
        return 0 if result.ok else 1
    archive = api.Archive(spark, a.db)
    if not archive.exists():
        logging.error("there is no archive at %s", a.db)
        return 1
    if a.command == "query" and a.type == "conversations":
        _show(api.conversations(archive, a.limit, a.order_by).collect(), a.format)
    elif a.command == "query":
        one, said = api.conversation_detail(archive, a.conversation_id or "", a.include_hidden)
        if (row := one.first()) is None:
            logging.error("there is no such conversation")
            return 1
        print(json.dumps({"conversation": api._plain(row), "messages": [api._plain(r) for r in said.collect()]}, indent=2, default=str, ensure_ascii=False))
    elif a.command == "search":
        hits = api.search(archive, a.q, role=a.role, kind=a.kind, conversation_id=a.conversation_id, run_id=a.run_id, limit=a.limit, offset=a.offset)
        _show(hits.collect(), a.format, lambda r: f"[{r['created_at']}] {r['conversation_id']} #{r['message_id']}: {r['text']}")
    elif a.command == "export-conversation":
        content = api.export_conversation(archive, a.conversation_id, a.format, a.output, a.include_hidden, a.frontmatter)
        if content is None:
            logging.error("there is no such conversation")
            return 1
        if not a.output:
            print(content)
    elif a.command == "export-conversations":
        print("\n".join(api.export_conversations(archive, a.output_dir, a.query, a.limit, a.format, a.include_hidden, a.frontmatter)))
    elif a.command == "export-bundle":
        print(f"{api.export_bundle(archive, a.output_markdown, a.since_days, include_hidden=a.include_hidden)} conversations")
    elif a.command == "check":
        result = api.check(archive)
        print(json.dumps(result, indent=2) if a.format == "json" else "\n".join(["ok" if result["ok"] else "errors", *map(str, result["errors"][:20])]))
        return 0 if result["ok"] else 1
    elif a.command == "list-runs":
        _show(api.list_runs(archive).collect(), a.format)
    elif a.command == "dump-db":
        api.dump(archive, a.output)
    return 0


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.ERROR if a.quiet else logging.DEBUG if a.verbose else logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        return run(a)
    except (ValueError, OSError, RuntimeError) as e:
        logging.error("%s", e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
