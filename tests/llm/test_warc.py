"""Operator 13: round trips, revisits, and payloads that look like records."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from siltstone.llm import queries, warc
from siltstone.llm.scratch import Scratch

SCHEMA = "page_id bigint, url string, html string, extra string"


def brute(rows, least=1000):
    groups = {}
    for i, _, html, _ in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        ids.sort(key=lambda i: (i is not None, i or 0))
        revisits = len(ids) - 1 if len(raw) >= least else 0
        out += [(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if k < revisits else "response", ids[-1] if k < revisits else None) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def fake(payload):
    """A whole record, as a payload may hold it."""
    return warc._record("=99", "2020-01-01T00:00:00Z", "http://fake.example/", payload.encode(), hashlib.sha1(payload.encode()).hexdigest(), "urn:x-row:0:=99:0", None).decode()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    page = "<p>one page ümlaut 日本</p>" * 60
    out = [(k, f"http://a.example/{k}?q=ä b\r\nWARC-Type: x", page, None) for k in range(90)]  # a third of all rows
    out += [(100 + k, None if k % 5 == 0 else f"http://b.example/{k}", "".join(rnd.choice("ab<>é\r\n") for _ in range(rnd.choice([0, 10, 999, 1000, 1001, 3000]))), "x") for k in range(60)]
    out += [(200 + k, "", None if k % 2 else "", None) for k in range(6)]
    out += [(300, "u", "WARC/1.1\r\n" * 400, None), (301, "u", fake("inner " * 300), None), (302, "u", "".join(fake(f"inner {k}") for k in range(30)), None)]
    out += [(303, "u", fake("x" * 5000)[:600], None), (304, "u", "WARC/1.0\r\nContent-Length: 7\r\n\r\n" + "\r\n" * 3000, None), (305, "u", "long " * 20_000, None), (306, "u", "WARC/1.1\r\nA: " + "b" * 9000, None)]
    out += [(400, "u", "twice the same id " * 80, None)] * 3 + [(399, "u", "twice the same id " * 80, None)]
    out += [(None, "u", "no id " * 300, None)] * 2 + [(None, None, "no id, and one with " * 100, None), (-5, None, "no id, and one with " * 100, None)]
    out += [(500 + k, "u", f"pair {k // 2} " * 200, None) for k in range(40)]
    rnd.shuffle(out)
    return out


def read(spark, path, **how):
    return warc.read_warc(spark, path, **how)


def kinds(found):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr)


@pytest.mark.parametrize("block_bytes, file_bytes, broadcast_groups", [(16 << 20, 64 << 20, 1000), (700, 20_000, 1000), (4096, 1 << 20, 0), (97, 3000, 1000)])
def test_round_trip(spark, rows, block_bytes, file_bytes, broadcast_groups, monkeypatch):
    monkeypatch.setattr(warc, "HEAD_BYTES", 200)
    path = Scratch(spark, "t").root
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    files = warc.write_warc(pages, path, file_bytes=file_bytes, broadcast_groups=broadcast_groups)
    assert files.agg({"records": "sum"}).first()[0] == len(rows)
    found = read(spark, path, block_bytes=block_bytes).collect()
    assert kinds(found) == brute(rows)
    html = {(r[0], hashlib.sha1((r[2] or "").encode()).hexdigest()): (r[2] or "").encode() for r in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"], r["payload_digest"]] for r in found if r["record_type"] == "response")
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")
    assert Counter(r["url"] for r in found)[None] == sum(not r[1] for r in rows)
    assert {r["url"] for r in found if r["page_id"] == 3} == {"http://a.example/3?q=%C3%A4%20b%0D%0AWARC-Type:%20x"}


def test_candidates_in_payloads_are_met_and_left(spark, rows):
    path, own = Scratch(spark, "t").root, Scratch(spark, "t")
    files = warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(2), path)
    candidates = own.keep(warc.chain_candidates(files, path, 4096), "c")
    assert candidates.count() > len(rows) + 30
    entered = warc.reached(files, candidates, own, 4096)
    true = {(r["file"], r["offset"]) for r in read(spark, path).collect()}
    sizes = {(r["name"], r["bytes"]) for r in files.collect()}
    assert {tuple(r) for r in entered.collect()} <= true | sizes


def test_jumps_inside_a_block():
    rnd = random.Random(7)
    for _ in range(200):
        offsets = np.unique([rnd.randrange(1000) for _ in range(rnd.randint(1, 60))])
        following = offsets + np.array([rnd.randint(1, 300) for _ in offsets])
        then = dict(zip(offsets.tolist(), following.tolist(), strict=True))

        def walk(at):
            at = then[at]
            while at in then and at < 1000:
                at = then[at]
            return at

        assert warc._left_at(offsets, following, 1000).tolist() == [walk(k) for k in offsets.tolist()]


def damaged(spark, rows, change):
    path = Scratch(spark, "t").root
    files = warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    file = Path(path.removeprefix("file://")) / files.first()["name"]
    raw = file.read_bytes()
    file.write_bytes(change(raw))
    return path


def test_damage_raises(spark, rows):
    plain = [(1, "u", "first page " * 200, None), (2, "u", "second page " * 200, None)]
    with pytest.raises(Exception, match="follow each other"):
        read(spark, damaged(spark, plain, lambda raw: raw.replace(b"WARC/1.1", b"XARC/1.1"))).collect()
    with pytest.raises(Exception, match="isn't what"):
        read(spark, damaged(spark, plain, lambda raw: raw.replace(b"first page", b"FIRST page"))).collect()
    with pytest.raises(Exception, match="has no end"):
        read(spark, damaged(spark, plain, lambda raw: raw[:-2] + b"xx")).collect()


def test_no_rows_and_other_names(spark):
    path = Scratch(spark, "t").root
    warc.write_warc(spark.createDataFrame([], SCHEMA), path)
    assert read(spark, path).collect() == []
    other = Scratch(spark, "t").root
    pages = spark.createDataFrame([("a:b %", "x", "body", "same"), (None, "y", "body", "place")], "key string, group string, body string, payload string")
    warc.write_warc(pages, other, id_col="key", url_col="group", payload_col="body", least_revisit=1)
    found = read(spark, other, id_type="string").collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in found), key=repr) == [("a:b %", "response", None), (None, "revisit", "a:b %")]


def test_query_on_whole_table(spark, data):
    pages = [tuple(r) + (None,) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    found = queries.QUERIES["op13_warc_round_trip"](spark, data)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(pages)
