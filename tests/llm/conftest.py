import pytest
from corpus import BENCHMARK, DOCUMENTS, PAGES, documents


@pytest.fixture(scope="session")
def docs(spark):
    """The documents, in several partitions and with columns whose names clash with those that operators make."""
    return spark.createDataFrame([tuple(r.values()) for r in documents()], DOCUMENTS).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory):
    """A folder of the tables."""
    from corpus import benchmark, pages

    d = tmp_path_factory.mktemp("sf")
    docs.coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(benchmark(), BENCHMARK).coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(pages(), PAGES).coalesce(1).write.parquet(f"{d}/pages.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCUMENTS), ("benchmark", BENCHMARK), ("pages", PAGES)):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.fixture(scope="session")
def held():
    """A query's rows against its SQL in DuckDB, over a folder of tables."""
    import glob

    import duckdb

    def compare(df, sql, folder):
        con = duckdb.connect()
        for name in ("documents", "benchmark", "pages"):
            assert glob.glob(f"{folder}/{name}.parquet/*.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(map(repr, cursor.fetchall()))
        got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
        assert got == want

    return compare
