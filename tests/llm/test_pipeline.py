import duckdb
import pytest

import corpus_pipeline
from labelloom.llm import oracle, queries
from llm_helpers import docs_table, long_text


def rows():
    en = "the and of to that was is with for this from are the and of to in it "
    good = [(i, en * 3 + long_text(40, i), "en", f"s{i % 3}") for i in range(1, 60)]
    copies = [(100 + i, good[0][1], "en", "s1") for i in range(5)]
    return good + copies + [(200, None, None, None), (201, "12 34", "en", "s1"), (None, good[5][1], "en", "s2")]


def test_stages(spark, tmp_path):
    """Every stage keeps the columns of documents, and its decisions take effect."""
    from labelloom.session import store_table

    benchmark = spark.createDataFrame([(0, long_text(40, 7))], "item_id long, text string")
    benchmark.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, seen = docs_table(spark, rows()), {}
    for name, stage in corpus_pipeline.STAGES:
        out = store_table(stage(spark, docs, f"file://{tmp_path}"))
        if name != "encode":
            assert out.columns == docs.columns
            docs = out
        seen[name] = [r["doc_id"] for r in out.collect()]
    assert set(seen["language_id"]) == {r[0] for r in rows()} - {200, 201}
    assert set(seen["near_copies"]) == set(range(1, 60)) | {None}
    assert set(seen["near_copies"]) - set(seen["benchmark_overlap"]) == {7}
    assert sorted(seen["encode"], key=str) == sorted(seen["mix"], key=str)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and 100 < out.count() < 400


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.named()[name](spark, sf_dir)
    names = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({oracle.statements()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(expected, key=str)
