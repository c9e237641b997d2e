"""The pipeline's stages, each against brute force on its own input, and its guard."""

import os
import subprocess
import sys

import corpus_pipeline
from corpus import benchmark, components, hits, quality, redacted, secret_spans
from pyspark.sql import functions as F

ITEMS = [(i, t) for i, t, *_ in benchmark() if t is not None]


def _triples(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_equal_brute_force(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "secret_scans", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    at = 0

    def stage(name):
        nonlocal docs, at
        before = _triples(docs)
        at += 1
        stages[name](spark, docs, sf_dir).write.mode("overwrite").parquet(f"{sf_dir}/stage{at}.parquet")
        docs = spark.read.parquet(f"{sf_dir}/stage{at}.parquet")
        return before, _triples(docs)

    before, after = stage("quality_rules")
    assert sorted(x[:2] for x in after) == sorted((i, t) for i, _, _, kept, t in quality(before) if kept)
    assert docs.columns == columns and docs.where(F.col("n_chars") != F.length("text")).isEmpty()

    before, after = stage("near_dedup")
    comp = components([x[:2] for x in before], 5, 80)
    assert sorted(i for i, *_ in after) == sorted(i for i, (_, c) in comp.items() if i == c)
    assert docs.columns == columns

    before, after = stage("decontamination")
    want = []
    for i, t, _ in before:
        n, hit, _, left = hits(t, ITEMS)
        if not (hit and 20 * hit >= n):
            want.append((i, left if hit else t))
    assert sorted(x[:2] for x in after) == sorted(want) and len(want) < len(before)
    assert docs.columns == columns

    before, after = stage("secret_scans")
    assert sorted(x[:2] for x in after) == sorted((i, redacted(t, spans)) for i, t, _, spans in secret_spans(before))
    assert docs.columns == columns

    stages["best_fit_packing"](spark, docs, sf_dir).write.parquet(f"{sf_dir}/stage9.parquet")
    pieces = spark.read.parquet(f"{sf_dir}/stage9.parquet")
    assert {r[0] for r in pieces.select("doc_id").collect()} == {x[0] for x in after}
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()

    ran = corpus_pipeline.run(spark, sf_dir)
    shape = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert shape(ran) == shape(pieces)


def test_no_documents(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def test_the_rest_stands_without_this_folder(tmp_path):
    """The entry and the archive's queries, with corpus_pipeline.py and the subpackage deleted."""
    import shutil

    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(repo, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
