"""The registered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barforge.llm import queries

from .test_operators import plain_components, plain_shard

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table, key = ("pages", "page_id") if "page_id" in out.columns else ("embeddings", "vec_id") if "vec_id" in out.columns else ("documents", "doc_id")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    if name.startswith(("op11_", "op12_")):  # several rows for each
        each, rows = (out.select(F.col("query_id").alias(key)), rows.where("vec_id % 50 = 0")) if "query_id" in out.columns else (out, rows)
        out = each.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == (5 if name.startswith("op11_") else 16))
    if name.startswith("op1_"):
        assert out.join(rows, key, "left_semi").count() == out.count() > 0
    else:
        assert out.select(key).exceptAll(rows.select(key)).count() == 0 == rows.select(key).exceptAll(out.select(key)).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    want = c.sql(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_stages_against_plain_versions(spark):
    """Rules as their SQL has them, one document of each group that all pairs give, copies within the mix's bound, shards from plain hashes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = corpus_pipeline.keep_good(spark, docs, SF).collect()
    assert ids(good) == sorted(r[0] for r in c.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op10_quality_rules']}) WHERE kept").fetchall())
    single = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(good, docs.schema), SF).collect()
    assert ids(single) == sorted(set(plain_components([(r["doc_id"], r["text"]) for r in good], 5, 80).values()))
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(single, docs.schema), SF).collect()
    assert {r["doc_id"] for r in mixed} <= set(ids(single)) and max(ids(mixed).count(i) for i in set(ids(mixed))) <= 2
    dealt = corpus_pipeline.to_shards(spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    assert ids(dealt) == ids(mixed) and all(r["shard"] == plain_shard(r["doc_id"], 40) for r in dealt)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, docs.withColumn("kept", F.lit(1)), SF).collect()
        last = i == len(corpus_pipeline.STAGES) - 1
        assert rows and ([c for c in rows[0].asDict()][: len(columns)] == columns) and (last or len(rows[0]) == len(columns))
        assert all(seen[r["doc_id"]] == r["text"] for r in rows), name
        docs = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], docs.schema)
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
    nothing = spark.createDataFrame([], docs.schema)
    assert all(stage(spark, nothing, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
