"""Queries over all rows of their tables; test_oracle holds them against their SQL."""

import unicodedata

import pytest

from siltstone.plans import catalog
from siltstone.sources.tables import table


def keys(spark, data, name, column):
    return sorted(r[0] for r in table(spark, data, name).select(column).collect())


@pytest.mark.parametrize(
    ("name", "source", "key", "found"),
    [
        ("asof_lookup", "orders", "o_orderkey", "fact"),
        ("name_cascade", "part", "p_partkey", "id"),
        ("slug_then_name", "part", "p_partkey", "id"),
        ("regex_key_join", "orders", "o_orderkey", "o_orderkey"),
        ("reconcile_copies", "orders", "o_orderkey", "o_orderkey"),
    ],
)
def test_every_row_is_resolved(spark, data, name, source, key, found):
    rows = catalog.QUERIES[name](spark, data).select(found).collect()
    assert sorted(r[0] for r in rows) == keys(spark, data, source, key)


def test_joins_take_all_rows(spark, data):
    of = lambda name, column: {r[0] for r in catalog.QUERIES[name](spark, data).select(column).collect()}
    assert of("or_condition_join", "id") == set(keys(spark, data, "part", "p_partkey"))
    assert {k for k in keys(spark, data, "customer", "c_custkey") if k % 4 != 2} <= of("replace_by_source", "k")


@pytest.mark.parametrize("name", ["json_object_rows", "local_to_utc", "json_build_and_read", "rss_items"])
def test_every_event_is_read(name, spark, data):
    rows = catalog.QUERIES[name](spark, data).select("event_id").collect()
    assert sorted(r[0] for r in rows) == keys(spark, data, "events", "event_id")


def test_every_customer_has_handles(spark, data):
    rows = catalog.QUERIES["handle_candidates"](spark, data).collect()
    assert {r["c_custkey"] for r in rows} == set(keys(spark, data, "customer", "c_custkey"))


def test_whole_texts_are_folded(spark, data):
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
    docs = table(spark, data, "documents").select("doc_id", "text", "lang").collect()
    assert any(r["lang"] == "de" for r in docs) and any(len(r["text"]) > 200 for r in docs)
    rows = catalog.QUERIES["accent_fold"](spark, data).collect()
    assert {r["doc_id"]: r["folded"] for r in rows} == {r["doc_id"]: fold(r["text"]) for r in docs}
