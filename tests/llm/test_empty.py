"""Every corpus query on empty tables."""

import pytest

import corpus_pipeline
from siltstone.llm import queries
from siltstone.llm.scratch import Scratch


@pytest.fixture(scope="module")
def nothing(spark, data):
    own = Scratch(spark, "empty")
    for name in ("documents", "labels", "benchmark", "pages"):
        own.keep(spark.read.parquet(f"{data}/{name}.parquet").limit(0), f"{name}.parquet")
    return own.root


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_nothing_gives_nothing(spark, nothing, data, name):
    query = (queries.QUERIES | corpus_pipeline.QUERIES)[name]
    frame = query(spark, nothing)
    assert frame.collect() == [] and len(frame.columns) > 3
