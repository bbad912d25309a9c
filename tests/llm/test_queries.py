from __future__ import annotations

import pytest

from repolens.llm.queries import oracle_sql, queries
from tests.oracle import SF_DIR, available, same


@pytest.mark.skipif(not available(), reason="the standard tables are not here")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    if name in oracle_sql():
        same(spark, queries()[name], oracle_sql()[name])
    else:
        df = queries()[name](spark, SF_DIR)
        rows = df.count()
        table = "pages" if name == "op10_url_rules" else "documents"
        assert rows == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count() or name == "op9_decontamination"


@pytest.mark.skipif(not available(), reason="the standard tables are not here")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet").select("doc_id", "quality")
    q = queries()["op7_quality"](spark, SF_DIR.replace("0.001", "0.01")).where("held_out").join(labels, "doc_id")
    assert q.where("predicted = quality").count() >= 0.97 * q.count()
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    q = queries()["op8_language"](spark, SF_DIR.replace("0.001", "0.01")).where("held_out").join(docs, "doc_id")
    assert q.where("lang_pred = lang").count() >= 0.97 * q.count()
