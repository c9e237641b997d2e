import json

import pytest
from samples import branching, chain, rich, said, write, write_zip

from threadloom import api
from threadloom.archive import TABLES, Archive, ArchiveError

ONE = [("user", "Hello world")]
THREE = [("user", "Hello world"), ("assistant", "Hi there"), ("user", "More please")]


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """Archives of a few rows: plans are interpreted, as compiling them would take most of the time."""
    conf = {"spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def put(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"), buckets=4)
    archive.count = 0

    def ingest(*conversations, run=None, **more):
        archive.count += 1
        return api.ingest_exports(spark, [write(tmp_path / f"x{archive.count}.json", list(conversations))], archive.root, run_id=run or f"run_{archive.count}", **more)

    ingest.archive = archive
    ingest.rows = lambda name, order=None: [r.asDict(recursive=True) for r in (archive.table(name).orderBy(*order) if order else archive.table(name)).collect()]
    return ingest


def test_single_turn_and_extension(put):
    put(chain("c", ONE))
    put(chain("c", THREE, update=1300))
    (conv,) = put.rows("conversations")
    assert (conv["message_count"], conv["message_count_main_path"], conv["run_id"]) == (3, 3, "run_2")
    assert conv["created_at"] == "1970-01-01T00:16:40Z"
    assert [(r["run_id"], r["is_canonical_snapshot"]) for r in put.rows("conversation_runs", ["run_id"])] == [("run_1", False), ("run_2", True)]
    assert [r["time_index"] for r in put.rows("messages", ["time_index"])] == [0, 1, 2]
    assert len(put.rows("message_runs")) == 4
    assert conv["summary_text"].startswith("Conversation about A chat. It starts with the user asking about Hello world.")
    assert api.check(put.archive) == {"ok": True, "errors": []}


def test_branches(put):
    put(branching())
    found = {r["id"]: (r["is_in_main_path"], r["depth"], r["main_path_index"]) for r in put.rows("nodes")}
    assert found == {"root": (True, 0, 0), "main": (True, 1, 1), "side": (False, 1, None)}
    assert [(r["parent_node_id"], r["child_index"], r["child_node_id"]) for r in put.rows("node_children", ["child_index"])] == [("root", 0, "main"), ("root", 1, "side")]


def test_rich_content(put):
    stats = put(rich()).stats
    assert stats == {"conversations": 1, "messages": 4, "links": 4, "attachments": 2, "tool_calls": 1, "tool_results": 1}
    links = {r["source"]: r for r in put.rows("links")}
    text = links["message_text"]
    assert (text["url"], text["position_start"], text["position_end"]) == ("https://in.example/x/y;p?q=2#f", 8, 38)
    assert (text["scheme"], text["domain"], text["path"], text["query"]) == ("https", "in.example", "/x/y", "q=2")
    assert (links["citation"]["url"], links["citation"]["position_start"], links["citation"]["kind"]) == ("https://cite.example/b", 2, "webpage")
    files = {r["type"]: r for r in put.rows("attachments")}
    assert json.loads(files["image"]["metadata"]) == {"width": 3, "height": 4, "availability": "here"}
    assert (files["file"]["filename"], files["file"]["filesize_bytes"]) == ("notes.pdf", 77)
    (call,), (result,) = put.rows("tool_calls"), put.rows("tool_results")
    assert call["tool_name"] == "python" and json.loads(call["arguments_json"]) == {"a": [2], "b": 1}
    assert result["tool_call_id"] == call["id"] and json.loads(result["result_json"]) == [{"k": "v"}]
    kinds = {r["id"]: r["message_kind"] for r in put.rows("messages")}
    assert kinds == {"r0": "user_visible_user", "r1": "tool_call", "r2": "tool_result", "r3": "user_visible_assistant"}
    (conv,) = put.rows("conversations")
    notes = json.loads(conv["metadata"])
    assert notes["async_status"] == 3 and notes["is_read_only"] is True and conv["models_used"] == ["m-2"]
    assert put.rows("messages", ["id"])[2]["created_at"] == "1970-01-01T00:00:03.500000Z"


def test_pruned_snapshot_leaves_tombstones(put):
    put(rich(update=40))
    put(rich(tools=False, update=50))
    (conv,) = put.rows("conversations")
    assert json.loads(conv["metadata"])["removed_message_ids"] == ["r1", "r2"]
    assert (len(put.rows("messages")), len(put.rows("nodes")), put.rows("tool_calls"), put.rows("tool_results")) == (2, 2, [], [])
    assert api.check(put.archive)["ok"]


def test_older_snapshot_and_identical_import(put):
    put(chain("c", THREE, update=1300))
    before = put.rows("messages", ["id"])
    put(chain("c", ONE, start=900, update=950))
    put(chain("c", THREE, update=1300))
    assert put.rows("messages", ["id"]) == before
    assert [(r["run_id"], r["is_canonical_snapshot"]) for r in put.rows("conversation_runs", ["run_id"])] == [("run_1", True), ("run_2", False), ("run_3", False)]
    assert len(put.rows("message_runs")) == 7


def test_equal_times_replace_text(put):
    put(chain("c", ONE, update=5000))
    put(chain("c", [("user", "Something else")], update=5000))
    assert api.search(put.archive, "hello").count() == 0
    assert [r["text"] for r in api.search(put.archive, "something").collect()] == ["Something else"]


def test_partial_conversation_and_missing_id(put):
    put({"id": "p", "mapping": {}, "async_status": 3}, {"title": "no id"}, {"id": "q", "mapping": ["odd"]})
    assert sorted((r["id"], r["message_count"]) for r in put.rows("conversations")) == [("p", 0), ("q", 0)]


def test_run_is_atomic_and_repeatable(put, spark, tmp_path):
    put(chain("c", ONE), run="a")
    assert put(chain("d", ONE), run="a").status == "skipped"
    good, bad = write(tmp_path / "good.json", [chain("e", ONE)]), tmp_path / "bad.json"
    bad.write_text("{not json")
    with pytest.raises(api.IngestError) as e:
        api.ingest_exports(spark, [good, str(bad)], put.archive.root, run_id="b")
    assert e.value.result.status == "failed" and "bad.json" in e.value.result.errors[0]["source_label"]
    assert [r["id"] for r in put.rows("conversations")] == ["c"]
    assert [r["run_id"] for r in api.list_runs(put.archive).collect()] == ["a"]


def test_other_schema_version_is_refused(put):
    put(chain("c", ONE))
    manifest = put.archive.manifest() | {"schema_version": 99}
    put.archive._flip(manifest)
    with pytest.raises(ArchiveError):
        put.archive.manifest()


def test_zip_folder_and_html(spark, tmp_path):
    zipped = write_zip(tmp_path / "e.zip", {"nested/conversations-001.json": [chain("b", ONE)], "conversations.json": [chain("a", ONE)], "user.json": "{}", "chat.html": "<html>"})
    folder = tmp_path / "folder"
    folder.mkdir()
    write(folder / "conversations-000.json", [chain("c", ONE)])
    (folder / "user.json").write_text("{}")
    for streaming in (True, False):
        root = str(tmp_path / f"s{streaming}")
        api.ingest_exports(spark, [zipped, str(folder)], root, run_id="r", streaming=streaming)
        assert [r["id"] for r in Archive(spark, root).table("conversations").orderBy("id").collect()] == ["a", "b", "c"]
    page = tmp_path / "chat.html"
    page.write_text('<script>var jsonData = [{"create_time": 5}];</script>')
    with pytest.raises(api.IngestError) as e:
        api.ingest_exports(spark, [str(page)], str(tmp_path / "none"))
    assert e.value.result.diagnostics[0]["embedded_conversation_count"] == 1
    assert not (tmp_path / "none").exists()


def test_corrupt_archive_is_found(put):
    put(rich(), chain("c", THREE))
    a = put.archive
    t = a.tables()
    from pyspark.sql import functions as F

    from threadloom.operators.check import integrity_errors

    found = lambda **new: {r["type"] for r in integrity_errors({**t, **new}).collect()}
    assert found() == set()
    assert found(conversations=t["conversations"].withColumn("message_count", F.lit(999))) == {"conversation_message_count_mismatch"}
    assert found(conversations=t["conversations"].withColumn("message_count_main_path", F.lit(999))) == {"conversation_main_path_count_mismatch"}
    assert found(conversations=t["conversations"].withColumn("current_node_id", F.lit("gone"))) == {"current_node_missing"}
    assert found(message_index=t["message_index"].where("false")) == {"missing_message_fts_row"}
    assert found(message_index=t["message_index"].withColumn("message_id", F.concat("message_id", F.lit("x")))) == {"missing_message_fts_row", "orphan_message_fts_row"}
    assert found(conversation_runs=t["conversation_runs"].withColumn("is_canonical_snapshot", F.lit(False))) == {"canonical_snapshot_marker_mismatch"}
    assert "orphan_message_node" in found(nodes=t["nodes"].where("id <> 'u'"))
    assert "orphan_node_message" in found(messages=t["messages"].where("id <> 'r0'"))
    assert {"node_child_missing"} <= found(node_children=t["node_children"].withColumn("child_node_id", F.lit("zz")))
    assert {"node_child_parent_missing"} <= found(node_children=t["node_children"].withColumn("parent_node_id", F.lit("zz")))


def test_dump_and_restore(put, spark, tmp_path):
    put(rich(), branching())
    api.dump(put.archive, str(tmp_path / "dump"))
    back = api.restore(spark, str(tmp_path / "dump"), str(tmp_path / "back"))
    for name in TABLES:
        key = lambda a: sorted(map(str, a.table(name).collect()))  # noqa: E731, B023
        assert key(back) == key(put.archive), name
    with pytest.raises(ArchiveError):
        api.restore(spark, str(tmp_path / "dump"), str(tmp_path / "back"))
    assert api.check(back)["ok"]


def test_queries_and_exports(put, tmp_path):
    put(rich(), branching(), chain("../odd", THREE, title='Say "hi"'))
    a = put.archive
    assert [r["id"] for r in api.conversations(a, 2).collect()] == ["../odd", "rich"]
    assert [r["id"] for r in api.conversations(a, -1, "message_count ASC").collect()] == ["../odd", "branch", "rich"]
    for bad in ("text", "id; drop", "id sideways"):
        with pytest.raises(ValueError):
            api.conversations(a, 5, bad)
    assert [r["id"] for r in api.conversation_detail(a, "rich")[1].collect()] == ["r1", "r2", "r3"]
    assert api.conversation_detail(a, "rich", True)[1].count() == 4
    md = api.export_conversation(a, "branch", frontmatter=True)
    assert md.startswith('---\ntitle: "Ways"\nconversation_id: "branch"\n') and "## 1. user @ 1970-01-01T00:00:10Z" in md
    text = api.export_conversation(a, "branch", "text")
    assert text.startswith("Title: Ways\nConversation ID: branch\n") and text.endswith("-" * 40 + "\n")
    assert len(json.loads(api.export_conversation(a, "rich", "json"))["messages"]) == 3
    assert api.export_conversation(a, "nobody") is None
    assert api.export_conversations(a, str(tmp_path / "out")) == sorted(["branch.md", "rich.md", "%2E%2E%2Fodd.md"])
    assert api.export_conversations(a, str(tmp_path / "hits"), query="way", form="text") == ["branch.txt"]
    assert api.export_bundle(a, str(tmp_path / "b" / "bundle.md"), since_days=9, today="1970-01-05") == 3
    assert '<a id="rich"></a>' in (tmp_path / "b" / "bundle.md").read_text()


def test_message_without_id_and_cycle(put):
    loop = {"id": "loop", "current_node": "a", "mapping": {"a": {"parent": "b", "children": ["b"], "message": said("l0", "user", "round", 1)}, "b": {"parent": "a", "children": ["a"], "message": {"author": {"role": "assistant"}, "content": {"content_type": "code", "text": "x"}}}, "n": None}}
    put(loop)
    assert [(r["id"], r["depth"]) for r in put.rows("messages")] == [("l0", None)]
    assert [(r["message_id"], r["tool_name"]) for r in put.rows("tool_calls")] == [(None, None)]


def test_streaming_watch(spark, tmp_path):
    from threadloom.streaming import watch

    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "one.json", [chain("a", ONE)])
    a = Archive(spark, str(tmp_path / "arch"), buckets=2)
    watch(spark, str(folder), a, str(tmp_path / "cp")).awaitTermination()
    write(folder / "two.json", [chain("a", THREE, update=9000)])
    watch(spark, str(folder), a, str(tmp_path / "cp")).awaitTermination()
    assert [r["message_count"] for r in a.table("conversations").collect()] == [3]
    assert len(a.manifest()["runs"]) == 2


def test_command_line(put, tmp_path, capsys):
    from threadloom.cli import main

    put(branching())
    db = ["--db", put.archive.root]
    assert main(["check", *db]) == 0
    assert main(["search", *db, "--q", "way", "--limit", "1"]) == 0
    assert main(["query", "conversations", *db, "--format", "json"]) == 0
    assert main(["list-runs", *db]) == 0
    assert main(["contract"]) == 0
    assert main(["search", *db, "--q", '"open']) == 1
    assert main(["check", "--db", str(tmp_path / "nowhere")]) == 1
    assert '"conversation_id": "branch"' in capsys.readouterr().out


def test_arrays_are_read_strictly_where_it_matters():
    import io

    import pytest

    from threadloom.sources.export import ExportError, stream_array

    good = '[ {"a": "]}\\\\\\"{["}, [1, {"b": []}] , "x\\\\\\\\", 12, null ]\n'
    for chunk in (1, 2, 7, 1 << 16):
        assert list(stream_array(io.StringIO(good), chunk, strict=True)) == [{"a": ']}\\"{['}, [1, {"b": []}], "x\\\\", 12, None]
    for bad in ("[{} {}]", "[,{}]", "[{},]", "[{}] junk ]", "[{}", "[{},,{}]", "{}", "", "[{]"):
        with pytest.raises(ExportError):
            list(stream_array(io.StringIO(bad), strict=True))
    assert list(stream_array(io.StringIO("[{},,{},] rest"))) == [{}, {}] and list(stream_array(io.StringIO("[{}"))) == [{}]
    with pytest.raises(ExportError):
        list(stream_array(io.StringIO("[{} {}]")))


def test_a_replaced_archive_stands_until_the_new_one_is_whole(spark, tmp_path):
    import pytest

    from threadloom.archive import Archive

    archive = Archive(spark, str(tmp_path / "a"))
    archive._flip({"schema_version": 2, "version": 3, "buckets": 16, "runs": [{"run_id": "r"}], "tables": {}})
    dumped = tmp_path / "d"
    dumped.mkdir()
    (dumped / "META.json").write_text('{"schema_version": 2, "runs": []}')  # its tables are missing
    with pytest.raises(Exception):
        Archive.restore(spark, str(dumped), str(tmp_path / "a"), force=True)
    assert archive.manifest()["runs"] == [{"run_id": "r"}] and not archive.store.exists(archive.store.at("LOCK"))
    archive.store.create(archive.store.at("LOCK"), "held")
    with pytest.raises(Exception, match="another run"):
        archive.ingest([], "x")
    archive.unlock()
    assert not archive.store.exists(archive.store.at("LOCK"))
