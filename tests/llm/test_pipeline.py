import hashlib
import os
import random

import pytest

import corpus_pipeline
from tests import oracle
from wardstone.llm.queries import QUERIES, SQL


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, name):
    oracle.same(spark, QUERIES[name], SQL[name])


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, oracle.DATA)
        assert out.columns == docs.columns, name
        assert out.count() <= before.count()
    rows = corpus_pipeline.run(spark, oracle.DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in out.collect()) and len({r.doc_id for r in rows}) == len(rows) > 0


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and very long texts, rows given twice, ids given twice, clashing columns."""
    r = random.Random(2)
    text = lambda n: " ".join(r.choice("the and of this with lorem ipsum dolor sit amet elit sed".split()) + str(r.randint(0, 99)) for _ in range(n)) + "."
    rows = [(i, text(60), "en", "s") for i in range(80)]
    rows += [(80, rows[0][1], "en", None), (81, rows[1][1].replace(".", " end."), None, "s"), rows[2], (3, text(60), "en", "s")]
    rows += [(None, text(60), "en", "s"), (None, rows[4][1], "en", "s"), (90, None, "en", "s"), (91, "", "en", "s"), (92, text(40_000), "en", "s"), (93, "12 34", None, None)]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'k' AS keep_id", "1 AS rate", "2L AS mx_row", "true AS kept", "'d' AS domain")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, 0) for i in range(0, 80, 2)] + [(None, 0, 0), (5, None, None), (81, 0, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [g.doc_id for g in got]
    assert {*range(80), 92} <= set(ids) and not {80, 81, 90, 91, 93} & set(ids) and ids.count(None) == 1 and ids.count(2) == 1 and ids.count(3) == 2
    of = {g.doc_id: g for g in got}
    assert all(of[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in rows[:2] + [rows[-2]] if i in of and i != 3)


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
