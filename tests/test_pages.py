"""Pages read once: stages and entities with bounded work and memory."""

import datetime as dt

import duckdb
import pyarrow as pa
import pytest

from siltstone.functions import strings
from siltstone.operators import chunks
from siltstone.plans import catalog


def test_stages_read_items_once_and_are_shuffled_once(spark):
    row = "<tr><td>{}</td><td>{}</td></tr>".format
    pages = [(1, row("First Reading", "2024-03-05") + row("Committee", "no day") + "<li>no stage 2024-03-06</li>" + row("Royal Assent", "March 7, 2024")), (1, row("First Reading", "2024-03-05")), (2, None), (3, row("Second Reading", "2024-02-30"))]
    found = chunks.stage_events(spark.createDataFrame(pages, "id int, html string"), "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("regexp_extract_all") == 1
    assert [tuple(r) for r in found.orderBy("sequence").collect()] == [(1, 0, "first_reading", dt.date(2024, 3, 5)), (1, 1, "royal_assent", dt.date(2024, 3, 7))]


def test_entities_are_decoded_a_few_texts_at_a_time(spark, monkeypatch):
    batch = pa.array(["a" * 700_000, "b" * 700_000, None, "", *["&eacute;"] * 3000, "c" * 3_000_000, "d"])
    sizes = [len(some) for some in strings.few(batch)]
    assert sum(sizes) == len(batch) and max(sizes) == 1000 and sizes[0] == 1
    assert pa.concat_arrays(list(strings.few(batch))).equals(batch) and list(strings.few(batch[:0])) == []
    rows = spark.createDataFrame([(k, None if k == 5 else f"{k} &eacute;&#x1F600; &no;") for k in range(2500)], "id int, t string").coalesce(1)
    assert {r["id"]: r["d"] for r in rows.select("id", strings.decoded("t").alias("d")).collect()} == {k: None if k == 5 else f"{k} é😀 &no;" for k in range(2500)}


CUT = ["<h1>token = &quot</h1><p>token = &quot;9c&quot;</p>", "a &copy 2024 &copyright &middotb", "x &amp y &ampquot; &amp;amp; &ampamp &am", "&amp;copy;&amp;quot &", "no entity", None]


def test_entities_without_their_semicolon_are_as_in_the_sql(spark, tmp_path):
    pages = spark.createDataFrame(list(enumerate(CUT)), "page_id long, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = {r["page_id"]: r["body"] for r in catalog.QUERIES["page_text"](spark, str(tmp_path)).collect()}
    assert found == dict(con.sql(catalog.ORACLE_SQL["page_text"]).fetchall())


@pytest.mark.parametrize("text, plain", [("&notin;&not &notit; &#233 &#233;&#x1F600;&eacute", "∉¬ ¬it; &#233 é😀&eacute"), ("&amp;lt; &no; &#0;&#128;", "&lt; &no; \ufffd€")])
def test_bare_names_are_read_and_no_others(text, plain):
    assert strings.unescaped_closed(text, ("not",)) == plain
