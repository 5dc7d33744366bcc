"""Queries against their SQL twins, and the pipeline's stages against what they are given."""

import collections
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402
from tidemark.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, note = compare(spark, con, name, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, note


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.withColumnRenamed("n_chars", "n_chars")
    seen, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file:{tmp_path}/{name}")
        docs = spark.read.parquet(f"file:{tmp_path}/{name}")
        seen.append((name, docs.count()))
        if name != "token_output":
            assert docs.columns == columns
    rows = dict(seen)
    assert start.count() > rows["quality_rules"] > rows["minhash_near_dedup"] > rows["benchmark_decontamination"]
    assert rows["token_output"] == rows["temperature_mixing"] >= rows["benchmark_decontamination"]
    mixed = spark.read.parquet(f"file:{tmp_path}/temperature_mixing")
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in spark.read.parquet(f"file:{tmp_path}/benchmark_decontamination").collect()}
    last = sorted(docs.collect(), key=lambda r: r.start)
    ids = collections.Counter(r.doc_id for r in last)
    assert ids == collections.Counter(r.doc_id for r in mixed.collect()) and [r.doc_id for r in last] == sorted(ids.elements())


def test_pipeline_odd_tables(spark):
    labels = "doc_id long, quality int, toxic int"
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a " * 90, None, None, 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    from tidemark.llm import decontaminate, mixing, near_dup, quality
    from tidemark.llm.tables import drop_ids

    for rows in (docs, docs.limit(0)):
        one = quality.accepted(rows, quality.train(rows, spark.createDataFrame([], labels)))
        assert one.count() == 0
        two = near_dup.deduplicated(rows)
        assert two.count() == (3 if rows is docs else 0)
        three = drop_ids(two, decontaminate.contaminated(two, spark.createDataFrame([(1, "x")], "item_id long, text string")))
        assert mixing.mixed(three).count() == two.count()
