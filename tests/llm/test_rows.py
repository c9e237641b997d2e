"""Operators on single texts, with their counts over the corpus, against SQL and brute force."""

import hashlib

import pytest
from corpus import base_spans, documents, lowered, measured, quality, redacted, secret_spans, spelt
from pyspark.sql import functions as F

from threadloom.llm import licenses, quality as rules, queries, secrets, tokencount, urls
from threadloom.llm.tokenization import Encoder

Q, SQL = queries.queries(), queries.oracle_sql()
TRIPLES = [(r["doc_id"], r["text"], r["source"]) for r in documents()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, sf_dir, empty_dir, held, name):
    held(Q[name](spark, sf_dir), SQL[name], sf_dir)
    assert Q[name](spark, empty_dir).collect() == []


def test_op1_equals_brute_force(spark, sf_dir):
    got = sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in Q["op1_secret_scans"](spark, sf_dir).collect())
    want = []
    for i, text, base, every in secret_spans(TRIPLES):
        counts = [len(x) for x in base_spans(text).values()]
        want.append((i, *counts, hashlib.sha256(spelt(base).encode()).hexdigest(), spelt(every)))
    assert got == sorted(want)
    assert any("live" in w[5] for w in want) and sum(w[5] != "" for w in want) >= 3


def test_widely_copied_values_are_examples(spark, docs):
    rows = {r["doc_id"]: r for r in secrets.verdicts(docs).collect()}
    shared = [i for i, t, _ in TRIPLES if t and "Xy12" in t]
    alone = [i for i, t, _ in TRIPLES if t and "Lone7" in t]
    assert len(shared) >= 6 and all(rows[i]["spans"] == "" for i in shared)
    assert alone and all(rows[i]["spans"].startswith("live:") and rows[i]["n_live"] == 1 for i in alone)


def test_redaction_keeps_rows_and_columns(spark, docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    spans = {i: s for i, _, _, s in secret_spans(TRIPLES)}
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == sorted((i, redacted(t or "", spans[i])) for i, t, _ in TRIPLES)


def test_op4_equals_brute_force(spark, sf_dir):
    got = sorted((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["base_failed"], r["kept"]) for r in Q["op4_quality_rules"](spark, sf_dir).collect())
    want = sorted(x[:4] for x in quality(TRIPLES))
    assert got == want
    assert any(not f and not k for _, _, f, k in want)


def test_common_lines_are_cut_out(spark, docs):
    out = rules.keep(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted((i, t) for i, _, _, kept, t in quality(TRIPLES) if kept)


def test_measures_of_odd_texts(spark):
    texts = [None, "", "\n\n", "a\na\na", "w " * 7, "w " * 9, "# $ | < > & % *", "é é x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    got = [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.measures(df).orderBy("doc_id").collect()]
    assert got == [measured(t) for t in texts]


def test_op5_rules(spark, sf_dir):
    rows = {r["page_id"]: r for r in Q["op5_url_filters"](spark, sf_dir).collect() if r["page_id"] is not None}
    told = {i: (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) for i in range(15)}
    assert told == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("example.com", "", None), 5: ("example.com", "/en/7/x", "example.com/en/7"), 6: ("example.com", "/en/8", "com/en/"),
        7: ("a.b.example.com", "/en/7", "example.com/en/7"), 8: ("notexample.com", "/en/1", "com/en/"), 9: ("example.net", "/de/8", "example.net/de/8"), 10: ("sub.example.net", "/de/9", "net/de/"),
        11: ("x.org", "/es/1", "org/es/"), 12: ("x.org", "", None), 13: ("b:", "//c/en/", None), 14: ("é.com", "/en/ü", "com/en/"),
    }
    assert rows[5]["verdict"] == "allow" and rows[6]["verdict"] == "block" and rows[0]["verdict"] == "allow"


def test_templates_become_wildcards_and_are_rejected(spark):
    """More than CHILDREN different segments are one template; its labels count together."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"http://h.x/{c}/buy", 1 if i < 24 else None) for i, c in enumerate(letters)] + [(i + 40, f"http://h.x/{c}/read", 0) for i, c in enumerate(letters)]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    host, path = urls.split_url(F.col("url"))
    bad = urls.judged_templates(df.select(host.alias("host"), urls.general(path).alias("shape"), "label"))
    assert sorted(r["shape"] for r in bad.collect()) == sorted(f"/{c}/buy" for c in letters)


def test_op6_known_licenses_in_other_spellings(spark):
    title, body = licenses.KNOWN["MIT"]
    texts = [body, f"The {title}", f"{title.upper()}\n\nCopyright (c) 2020 Someone\n\n" + body.replace(". ", ".\n"), "Copyright © 1999-2003, A. Person\n" + body.replace("software", "soft-ware"), body + " And more.", None, "", body.replace(",", " ;").lower()]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in rows] == ["MIT", None, "MIT", None, None, None, None, "MIT"]
    assert len({d for d, _ in licenses.known_digests()}) == 2 * len(licenses.KNOWN)


def test_op8_counts_as_the_library_does(spark, sf_dir, empty_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in TRIPLES)
    assert sorted(tuple(r) for r in Q["op8_token_counts"](spark, sf_dir).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    assert any(w[3] for w in want) and Q["op8_token_counts"](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, rng = Tokenizer.from_file(path), random.Random(4)
    encoder = Encoder(path, list, limit=500)  # so small that it is emptied again and again
    odd = ["é", "É", "ß", "ẞ", "İ", "ı", "ſ", "K", "Å", "ﬁ", "é", "日", "本", "👍🏽", "‍", "­", " ", " ", "\x85", "\x1c", "\x00", "﻿", "²", "½", "٣", "'s", "'LL", "’", "<|endoftext|>", "<|", "|>", "\n", "\t", "_", "9", "99", "...", "Ǆ", "ŉ", "º", "ª", "µ"]
    for _ in range(800):
        text = "".join(rng.choice(odd) if rng.random() < 0.3 else rng.choice(["a", "B", "the", "Word", " ", "  ", "-", "!?"]) for _ in range(rng.randint(0, 40)))
        ids = [x for part in encoder.of(text) for x in part]
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_table_only_saves_work(spark, docs):
    path = queries.tokenizer_path()
    few, many = (tokencount.token_lengths(docs, path, sample=n, words=m) for n, m in ((5, 1), (100_000, 5000)))
    assert docs.select("doc_id", few.alias("n")).exceptAll(docs.select("doc_id", many.alias("n"))).isEmpty()


def test_lowered_is_ascii_only():
    assert lowered("ÀAİZz") == "ÀaİzZ".replace("Z", "z")
