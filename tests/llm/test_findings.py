"""Where an operator once did less than its whole job."""

from pyspark.sql import functions as F

from threadloom.llm import licenses, quality, queries, tokencount, urls


def test_a_common_line_of_a_large_host_is_cut_out(spark):
    """30 of 400 texts hold the line: over 20, under a tenth. Texts that are little else are rejected."""
    word = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))  # noqa: E731  (numbers are one word to the rule)
    rows = [(i, " ".join(f"w{word(i)}x{word(k)}" for k in range(30)) + ("\nsubscribe to our daily letter" if i < 30 else "")) for i in range(400)]
    rows += [(i, "\n".join([*(f"subscribe to our daily letter {k}" for k in "abcdefgh"), f"own {word(i)}"])) for i in range(400, 425)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("h.example"))
    left = {r["doc_id"]: r["text"] for r in quality.keep(df).collect()}
    assert sorted(left) == list(range(401))
    assert [i for i, t in left.items() if i < 400 and "letter" in t] == [0]


def _rejected(spark, rows):
    df = spark.createDataFrame([(u, x) for u, x in rows], "url string, label int")
    host, path = urls.split_url(F.col("url"))
    return sorted(r["shape"] for r in urls.judged_templates(df.select(host.alias("host"), urls.general(path).alias("shape"), "label")).collect())


def test_deep_segments_become_wildcards(spark):
    """Slugs in the fourth and in the sixth segment: the unlabelled ones go with their siblings."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"http://h.x/shop/a/b/{c}", 1 if i < 24 else None) for i, c in enumerate(letters)]
    rows += [(f"http://h.x/blog/a/b/c/d/{c}/e", 1 if i < 24 else None) for i, c in enumerate(letters)]
    rows += [(f"http://h.x/read/a/b/{c}", 0) for c in letters] + [("http://h.x/read/a/c/d/e/f", None), ("http://h.x", None)]
    assert _rejected(spark, rows) == sorted([f"/shop/a/b/{c}" for c in letters] + [f"/blog/a/b/c/d/{c}/e" for c in letters])


def test_deep_branches_merge_from_the_leaves_up(spark):
    """Too few labels in each parent of leaves, enough in the branch of the second segment."""
    rows = [(f"http://h.x/shop/a/{p}/{q}/z", 1) for p in "bcde" for q in "uv" for _ in range(4)] + [("http://h.x/shop/b/c/d/e", 0)]
    assert _rejected(spark, rows) == sorted(f"/shop/a/{p}/{q}/z" for p in "bcde" for q in "uv")


UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>"


def test_usual_licences_are_known(spark):
    """Long licences are digests only: one by its text, the others by the table; usual titles and lists of short ones."""
    body = {k: b for k, (_, b) in licenses.KNOWN.items()}
    stars = body["BSD-3-Clause"].replace(" 1. ", "\n\n* ").replace(" 2. ", "\n\n* ").replace(" 3. ", "\n\n* ")
    texts = [UNLICENSE, "The Unlicense\n\n" + UNLICENSE, "The MIT License (MIT)\n\nCopyright (c) 2015 A\n\n" + body["MIT"], stars, "3-Clause BSD License\n" + stars, "The ISC License\n\n" + body["ISC"], UNLICENSE + " And more.", "The MIT License (MIT)"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in rows] == ["Unlicense", "Unlicense", "MIT", "BSD-3-Clause", "BSD-3-Clause", "ISC", None, None]
    known = dict(licenses.all_digests())
    assert set(licenses.known_digests()) <= set(known.items()) and {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSL-1.0"} <= set(known.values())


def test_token_table_is_of_all_partitions(spark):
    """The first partition is one hot text; the words of the others are more frequent over the corpus."""
    hot = spark.createDataFrame([(i, "alpha " * 400) for i in range(5)], "doc_id long, text string").coalesce(1)
    rest = spark.createDataFrame([(i, "beta " * 300) for i in range(5, 65)], "doc_id long, text string").repartition(3)
    table = tokencount._frequent(hot.union(rest), queries.tokenizer_path(), "text", 1000, 1)
    assert list(table) == ["beta"]


def test_what_a_cut_brings_together_is_cut_too(spark):
    """The item's own window hits; without it the words around it are another item."""
    from threadloom.llm import decontam

    words = lambda tag, n: [f"{tag}{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(n)]
    left, right, hit, own = words("l", 7), words("r", 6), words("h", 13), [f"own{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    docs = spark.createDataFrame([(1, " ".join([*own, *left, *hit, *right, *own])), (2, " ".join(own)), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(hit)), (2, " ".join(left + right))], "item_id long, text string")
    out = decontam.clean(docs, items)
    assert {r["doc_id"]: (r["text"] or "").split() for r in out.collect()} == {1: own + own, 2: own, 3: []}
    assert decontam.find_hits(out, items).where("n_hit > 0").isEmpty()


def test_the_stage_looks_at_a_text_in_one_python_worker(spark, sf_dir):
    """Filters on a hit ran the judging function again, each time in a worker of its own; rounds are joined by shuffles beyond the bound only."""
    from threadloom.llm import decontam

    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.withColumn("n_hit", F.lit("own"))
    once, rounds = decontam.clean(docs, items), decontam.clean(docs, items, bound=0)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
    rows = lambda df: sorted((r["doc_id"], r["text"] or "", r["n_hit"]) for r in df.collect())
    got = rows(once)
    assert once.columns == docs.columns and 0 < len(got) < docs.count() and {x[2] for x in got} == {"own"}
    assert [x[:2] for x in got] == [x[:2] for x in rows(rounds)]
    assert decontam.find_hits(once, items).where("n_hit > 0").isEmpty()


def test_an_archive_cut_between_frames_is_refused(spark, tmp_path):
    import pytest

    from threadloom.llm import warc

    pages = spark.createDataFrame([(i, "http://x", f"<p>{i}</p>") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(warc.with_types(pages), f"file://{tmp_path}/a")
    assert warc.read_archives(spark, archives).count() == 40
    for r in archives.collect():
        path = r["archive"].removeprefix("file://").removeprefix("file:")
        with open(path, "rb") as f:
            whole = f.read()
        cuts = [i for i in range(len(whole)) if whole[i : i + 4] == b"\x28\xb5\x2f\xfd"]
        with open(path, "wb") as f:
            f.write(whole[: cuts[-1]])
    with pytest.raises(Exception, match="records of"):
        warc.read_archives(spark, archives).count()
