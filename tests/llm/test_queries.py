"""Registered queries and the pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline
from checks import compare
from tests.llm.conftest import documents, prose
from tidemark.llm.common import stored
from tidemark.llm.queries import QUERIES
from tidemark.llm.sql import TWINS

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@here
@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, name):
    con = compare.connect(SMALL)
    got = QUERIES[name](spark, SMALL)
    want = con.sql(TWINS[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert compare.rows_of(got.columns, [tuple(r) for r in got.collect()]) == compare.rows_of(want.columns, want.fetchall())


@here
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    n = QUERIES[name](spark, SMALL).count()
    table = spark.read.parquet(f"{SMALL}/{'pages' if name.startswith('op10') else 'documents'}.parquet").count()
    if name.startswith("op11"):
        assert n == 600 * spark.read.parquet(f"{SMALL}/documents.parquet").select("lang").distinct().count()
        return
    assert n >= table if name.startswith("op5") else n > 0 if name.startswith("op1_") else n == table


def stages(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""))
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_and_do_their_work(spark):
    clean = [(i, prose(i, 120), f"s{i % 3}") for i in range(60)]
    rows = clean + [(100, prose(3, 120), "s0"), (101, "too short", "s1"), (102, "a b c\n" * 80, "s1"),
                    (103, prose(103, 60) + " mail x1@y2.example.com", "s2"), (104, None, "s2")]
    docs = documents(spark, rows, clashes=True)
    got = dict(stages(spark, docs))
    for name in list(got)[:-1]:
        assert got[name].columns == docs.columns
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in got.items()}
    assert ids["quality"] == set(range(60)) | {100, 103}
    assert ids["near_duplicates"] == set(range(60)) | {103}
    masked = {r["doc_id"]: r["text"] for r in got["personal_data"].collect()}
    assert masked[103].endswith("mail [EMAIL]") and all(masked[i] == t for i, t, _ in clean)
    assert ids["mix"] <= ids["personal_data"] and ids["pack"] == ids["mix"]


def test_pipeline_of_an_empty_table(spark):
    assert all(df.count() == 0 for _, df in stages(spark, documents(spark, [])))
