"""Registered corpus queries and the pipeline on the smallest test data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.verify import compare
from swathe.llm import queries
from swathe.llm.decontaminate import terms_of
from tests.conftest import SF


def test_registration():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in entry.queries()) == 1 for n in names)
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, SF), con, queries.SQL[name]) == ""


def test_stages(spark):
    """Every stage keeps the columns, drops only what it is for and passes the rest on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
    assert len(clean & set(kept["quality"])) >= 0.95 * len(clean)
    assert set(kept["near_duplicates"]) <= set(kept["quality"])
    items = [" ".join(terms_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, r in kept["near_duplicates"].items()
             if any(t in " ".join(terms_of(r.text)) for t in items)}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == leaks
    assert set(kept["secrets"]) == set(kept["decontamination"]) == set(kept["packing"])
    assert not any("token = \"" in r.text for r in kept["secrets"].values())
