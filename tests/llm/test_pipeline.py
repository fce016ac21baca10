"""The pipeline by stages, the registered queries on small tables, and the SQL that repeats them."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quillweave.llm import fm_quality, jaccard_join, mixing_fill, queries
from tools.check_oracles import as_rows

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables here")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@needs_tables
def test_stages(spark, documents, word_file):
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == documents.columns
        kept.append(docs.toPandas())
        docs = spark.createDataFrame(kept[-1], documents.schema)
    good, single, mixed = kept
    machine = fm_quality.fit(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in fm_quality.score(documents, machine).collect()}
    assert set(good.doc_id) == {k for k, p in scores.items() if p} and len(good) < len(scores)
    groups = jaccard_join.linked(spark.createDataFrame(good, documents.schema)).collect()
    assert sorted(single.doc_id) == sorted({r["component"] for r in groups}) and len(single) < len(good)
    times = mixed.doc_id.value_counts()
    for r in mixing_fill.mix(spark.createDataFrame(single, documents.schema)).collect():
        assert abs(times.get(r["doc_id"], 0) - (r["taken"] / r["size"] if r["size"] else 1)) <= 0.5
    assert times.max() <= 3
    library = Tokenizer.from_file(word_file)
    texts = dict(zip(mixed.doc_id, mixed.text))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len(out) == len(mixed)
    for r in out[:50]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(memoryview(bytes(r["ids"])).cast("I")) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_on_odd_rows(spark, odd_documents):
    for docs in (odd_documents, odd_documents.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            n = docs.count()
            docs = stage(spark, docs, FOLDER)
            assert docs.count() <= 3 * n


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(entry.oracle_sql()) <= set(names)


@needs_tables
@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, FOLDER)
    mine = as_rows(df.columns, [tuple(r) for r in df.collect()])
    assert mine
    if name in queries.ORACLES:
        con = duckdb.connect()
        for path in Path(FOLDER).glob("*.parquet"):
            con.sql(f"create view {path.stem} as select * from '{path}'")
        result = con.sql(queries.ORACLES[name])
        assert sorted(df.columns) == sorted(result.columns)
        assert mine == as_rows(result.columns, result.fetchall())


@needs_tables
def test_held_out_accuracy(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = queries.op5_fm_quality(spark, FOLDER).join(labels, "doc_id").filter("held_out")
    right = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.9
