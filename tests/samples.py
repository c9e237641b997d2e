"""Conversations as exports hold them."""

import json
import zipfile


def node(i, parent, children, message=None):
    return {"id": i, "parent": parent, "children": children, "message": message}


def said(i, role, text, at, **more):
    return {"id": i, "author": {"role": role}, "create_time": at, "content": {"content_type": "text", "parts": [text]}, **more}


def chain(conv, texts, *, title="A chat", start=1000, update=None, **more):
    """texts: (role, text) in turn; message ids follow the place."""
    mapping = {}
    for i, (role, text) in enumerate(texts):
        parent = f"n{i - 1}" if i else None
        mapping[f"n{i}"] = node(f"n{i}", parent, [f"n{i + 1}"] if i + 1 < len(texts) else [], said(f"{conv}-m{i}", role, text, start + 100 * i))
    return {"id": conv, "title": title, "create_time": start, "update_time": update or start + 100, "current_node": f"n{len(texts) - 1}" if texts else None, "mapping": mapping, **more}


def branching(conv="branch"):
    mapping = {
        "root": node("root", None, ["main", "side"], said("b0", "user", "Which way?", 10)),
        "main": node("main", "root", [], said("b1", "assistant", "This way", 20)),
        "side": node("side", "root", [], said("b2", "assistant", "That way", 30)),
    }
    return {"id": conv, "title": "Ways", "create_time": 10, "update_time": 40, "current_node": "main", "mapping": mapping}


def rich(conv="rich", *, tools=True, update=100):
    refs = {
        "content_references": [{"type": "webpage", "url": "https://ref.example/a?x=1", "title": "A page"}],
        "citations": [{"start_ix": 2, "end_ix": 9, "metadata": {"type": "webpage", "url": " https://cite.example/b ", "title": "B page"}}],
        "attachments": [{"id": "file-1", "name": "notes.pdf", "mime_type": "application/pdf", "size": 77}],
        "model_slug": "m-2",
    }
    image = {"content_type": "image_asset_pointer", "asset_pointer": "file-service://img", "size_bytes": 5, "width": 3, "height": 4, "metadata": {"availability": "here"}}
    mapping = {
        "u": node("u", None, ["c"], said("r0", "user", "Look at https://in.example/x/y;p?q=2#f). Thanks", 1, metadata={"is_visually_hidden_from_conversation": True})),
        "c": node("c", "u", ["t"], {"id": "r1", "author": {"role": "assistant"}, "recipient": "python", "create_time": 2, "content": {"content_type": "code", "text": '{"b": 1, "a": [2]}'}, "metadata": ["not", "an", "object"]}),
        "t": node("t", "c", ["a"], {"id": "r2", "author": {"role": "tool", "name": "python"}, "create_time": 3.5, "content": {"content_type": "execution_output", "text": '[{"k": "v"}]'}}),
        "a": node("a", "t", [], {"id": "r3", "author": {"role": "assistant"}, "create_time": 4, "content": {"content_type": "multimodal_text", "parts": ["An image", image]}, "metadata": refs}),
    }
    if not tools:
        mapping = {"u": {**mapping["u"], "children": ["a"]}, "a": {**mapping["a"], "parent": "u"}}
    return {"id": conv, "title": "Rich", "create_time": 1, "update_time": update, "current_node": "a", "mapping": mapping, "safe_urls": ["https://safe.example/"], "blocked_urls": ["http://bad.example"], "async_status": 3, "is_read_only": True}


def write(path, conversations):
    path.write_text(json.dumps(conversations), encoding="utf-8")
    return str(path)


def write_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, conversations in members.items():
            z.writestr(name, conversations if isinstance(conversations, str) else json.dumps(conversations))
    return str(path)
