"""Operator 11 against regular expressions over code points."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import arrays, fill_middle, queries

PIECES = ["<P>", "<S>", "<M>", "<", ">", "P", "S", "M", "a", "Zz", " ", "\n", "é", "日本", "😀", "́", "1", "<P", "P>", "<<M>>"]


def brute(doc_id, text):
    """A row of the contract by a plain reading of it."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_no_state_reaches_back_further_than_a_lane_starts_early():
    for word in itertools.product(range(10), repeat=fill_middle.EARLY - 1):
        ends = set()
        for state in range(7):
            for kind in word:
                state = fill_middle.STEP[state, kind]
            ends.add(int(state))
        assert len(ends) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=5), st.integers(1, 9))
def test_scan_of_any_texts(texts, lane):
    data, offsets = arrays.utf8(pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()))
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    found = fill_middle.scan(data, offsets, lane)
    for k, text in enumerate(texts):
        starts = found.units[found.unit_rows[k] : found.unit_rows[k + 1]] - offsets[k]
        assert starts.tolist() == [len(text[: m.start()].encode()) for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        ends = found.sentinels[found.sentinel_rows[k] : found.sentinel_rows[k + 1]] - offsets[k] + 1
        assert ends.tolist() == [len(text[: m.end()].encode()) for m in re.finditer("<[PSM]>", text)]
        assert found.point_sums[offsets[k + 1]] - found.point_sums[offsets[k]] == len(text)


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def held(docs):
    made = fill_middle.restore(fill_middle.transform(docs)).collect()
    assert order((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made) == order(brute(r["doc_id"], r["text"]) for r in docs.collect())
    assert all(r["restored"] == (r["text"] or "") for r in made)
    return made


def test_forms_of_odd_texts(odd_docs, no_docs):
    made = held(odd_docs)
    assert set(made[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output", "restored"}
    assert held(no_docs) == []


def test_forms_of_many_texts(spark):
    rnd = random.Random(5)
    rows = [(k, "".join(rnd.choice(PIECES[3:] if k % 3 else PIECES) for _ in range(rnd.randint(0, 40)))) for k in range(3000)]
    made = held(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    forms = {f: sum(r["form"] == f for r in made) for f in ("plain", "psm", "spm")}
    assert min(forms.values()) > 100


def test_names_that_clash(odd_docs):
    clashing = odd_docs.withColumnRenamed("source", "FORM").withColumnRenamed("lang", "_text").withColumnRenamed("text", "output")
    made = fill_middle.restore(fill_middle.transform(clashing, text_col="output"), to="_kept0")
    assert made.columns == ["doc_id", "_text", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output", "_kept0"]
    texts = sorted(r["text"] or "" for r in odd_docs.collect())
    assert sorted(r["_kept0"] for r in made.collect()) == texts


def test_texts_of_many_lanes():
    text = ("<" * 511 + "P>" + "é" * 700 + "日" * 900 + "a" * 2000 + "😀" * 513) * 3
    data, offsets = arrays.utf8(pa.array(["", text, "x", text, ""]))
    found = fill_middle.scan(data, offsets)
    n = len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
    assert np.diff(found.unit_rows).tolist() == [0, n, 1, n, 0] and np.diff(found.sentinel_rows).tolist() == [0, 3, 0, 3, 0]


def test_an_output_without_its_sentinels_is_refused(spark):
    rows = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="sentinels"):
        fill_middle.restore(rows).collect()


def test_query_on_whole_table(spark, data):
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        row, text = brute(r["doc_id"], r["text"]), r["text"] or ""
        want.append((*row[:5], hashlib.sha256(row[5].encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = queries.QUERIES["op11_fill_in_middle"](spark, data)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert order(found.collect()) == order(want) and found.where(F.col("form") != "plain").count() > 100
