"""Operators on hand-made tables: nulls, ties, order, and what must not happen."""

import datetime as dt
import http.server
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import markup
from siltstone.operators import changes, chunks, geo, intervals, outputs, resolve, retrieval, rollups, search, upserts
from siltstone.operators.filters import SearchFilter, require_something
from siltstone.sources import paged, tables


def day(text):
    return dt.datetime.fromisoformat(text) if text else None


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_filter_guards(spark):
    with pytest.raises(ValueError):
        require_something(" ", SearchFilter())
    require_something(None, SearchFilter(language="en"))
    with pytest.raises(ValueError):
        SearchFilter(entities=tuple(range(11))).conditions()


def test_scan_changes(spark):
    rows = [
        (1, 1, "CA", "a", "p", 1, None, ["1", "2"]),
        (1, 2, "CA", "a", "p", 2, None, ["2", "1"]),
        (1, 3, "US", "a", None, 4, "", ["3"]),
        (2, 1, None, None, None, None, None, None),
    ]
    scans = frame(spark, rows, "site_id int, scanned_at int, country string, city string, provider string, tier int, cdn string, ips array<string>")
    got = {(r["scanned_at"], r["kind"], r["severity"]) for r in changes.scan_changes(scans).collect()}
    assert got == {(2, "tier_changed", "notable"), (3, "country_changed", "major"), (3, "provider_changed", "major"), (3, "tier_changed", "major"), (3, "ip_changed", "info")}


def test_roster_changes(spark):
    before = frame(spark, [(1, "A", "x"), (2, "B", ""), (3, "C", "y")], "id int, name string, party string")
    after = frame(spark, [(1, "A ", "z"), (2, "B", None), (4, "D", "x")], "id int, name string, party string")
    fields = {"name": ("name_changed", "info"), "party": ("party_switch", "notable")}
    got = {(r["id"], r["kind"]) for r in changes.roster_changes(before, after, "id", fields).collect()}
    assert got == {(1, "party_switch"), (3, "retired"), (4, "newly_elected")}
    assert not changes.roster_changes(before, before, "id", fields).collect()
    partial = {r["kind"] for r in changes.roster_changes(before, after, "id", fields, complete=False).collect()}
    assert "retired" not in partial


def test_half_open_terms(spark):
    terms = frame(spark, [("x", "a", day("2020-01-01"), day("2021-01-01")), ("x", "b", day("2021-01-01"), None), ("x", "c", day("2021-06-01"), None)], "role string, holder string, s timestamp_ntz, e timestamp_ntz")
    facts = frame(spark, [(1, "x", day("2020-12-31")), (2, "x", day("2021-01-01")), (3, "x", day("2021-07-01")), (4, "x", day("2019-01-01")), (5, "x", None), (6, "y", day("2020-02-02"))], "id int, role string, d timestamp_ntz")
    got = {r["id"]: r["holder"] for r in intervals.holder_at(facts, terms, "d", "s", "e", ["role"], "id").collect()}
    assert got == {1: "a", 2: "b", 3: "b", 4: None, 5: None, 6: None}


def test_ambiguous_names_stay_open(spark):
    people = frame(spark, [(1, "ann tall", "tall"), (2, "bob tall", "tall"), (3, "cy low", "low")], "k int, full string, last string")
    said = frame(spark, [(10, "ann tall", "tall"), (11, "tall", "tall"), (12, "dr low", "low"), (13, None, None)], "id int, name string, last string")
    out = resolve.cascade(said, people, "id", "k", [("name", "full", 1.0), ("last", "last", 0.9)])
    assert {r["id"]: (r["k"], r["confidence"]) for r in out.collect()} == {10: (1, 1.0), 11: (None, None), 12: (3, 0.9), 13: (None, None)}


def test_upserts(spark):
    schema = "k int, v string, conf double, src string"
    old = frame(spark, [(1, "a", 0.9, "o"), (2, "", 0.2, "o"), (None, "n", 0.1, "o")], schema)
    new = frame(spark, [(1, "b", 0.5, "n"), (2, "c", 0.8, "n"), (3, "d", 0.3, "n"), (None, "m", 0.4, "n")], schema)
    rows = lambda df: {r["k"]: tuple(r)[1:] for r in df.collect()}
    assert rows(upserts.upsert(old, new, ["k"])) == {1: ("b", 0.5, "n"), 2: ("c", 0.8, "n"), 3: ("d", 0.3, "n"), None: ("m", 0.4, "n")}
    assert rows(upserts.upsert_if_surer(old, new, ["k"], "conf", ["src"]))[1] == ("b", 0.9, "o")
    assert rows(upserts.insert_absent(old, new, ["k"])) == {1: ("a", 0.9, "o"), 2: ("", 0.2, "o"), None: ("n", 0.1, "o"), 3: ("d", 0.3, "n")}
    assert rows(upserts.fill_blanks(old, new, ["k"]))[2] == ("c", 0.2, "o")
    assert rows(upserts.fill_blanks(old, new, ["k"]))[1] == ("a", 0.9, "o")


def test_map_merge(spark):
    out = spark.range(1).select(upserts.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first()["m"]
    assert out == {"a": "1", "b": "3"}


def chunks_of(spark, texts):
    rows = chunks.chunked(frame(spark, list(enumerate(texts)), "id int, text string"), "id").orderBy("id", "chunk_index").collect()
    return [[r for r in rows if r["id"] == k] for k in range(len(texts))]


def test_chunks(spark):
    cases = [(None, 0), ("", 0), (" \n ", 0), ("a" * 26, 0), ("a" * 27, 1), ("a" * 1680, 1), ("b" * 4000, 1), ("\n".join(["c" * 700] * 5), 3), ("D" * 900 + ". " + "E" * 900 + ".", 2)]
    assert [len(c) for c in chunks_of(spark, [t for t, _ in cases])] == [n for _, n in cases]


def test_chunks_are_parts_of_their_text(spark):
    rnd = random.Random(4)
    sentence = lambda: "Ab" + "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(5, 400))).strip() + rnd.choice(".!?")
    texts = ["  \n" + rnd.choice(["\n", "\n\n", "\n \n", " "]).join(sentence() for _ in range(rnd.randint(1, 40))) + " \n" for _ in range(40)]
    for text, found in zip(texts, chunks_of(spark, texts), strict=True):
        assert found or len(text.strip()) < 27
        for r in found:
            assert text[r["char_start"] : r["char_end"]] == r["chunk"] == r["chunk"].strip()
            assert r["token_count"] == max(1, round(len(r["chunk"]) / 3.5))
        for a, b in zip(found, found[1:], strict=False):
            # A chunk begins with the end of the one before, and no text is left out.
            assert a["char_start"] <= b["char_start"] <= a["char_end"] < b["char_end"]
            assert a["char_end"] - b["char_start"] <= 175
        if len(found) > 1:
            assert found[0]["char_start"] == len(text) - len(text.lstrip())


def test_chunk_overlap_is_kept(spark):
    found = chunks_of(spark, ["\n".join(chr(97 + k) * 700 for k in range(5))])[0]
    assert len(found) == 3 and all(b["chunk"].startswith(a["chunk"][-175:]) for a, b in zip(found, found[1:], strict=False))


def test_line_turns(spark):
    text = "ORDERS OF THE DAY\n10:05\nThe Speaker: Order.\nMr. Tall: I rise: today\n  to speak.\nANOTHER HEADING\nlost line\n11:00 a.m.\nMs. Low: Thanks."
    rows = chunks.line_turns(frame(spark, [(1, text), (2, None)], "id int, text string"), "id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "The Speaker", "Order.", "10:05"), (1, 1, "Mr. Tall", "I rise: today\nto speak.", "10:05"), (1, 2, "Ms. Low", "Thanks.", "11:00")]


def test_stage_events(spark):
    html = "<table><tr><td>First Reading</td><td>2024-03-05</td></tr><tr><td>Second reading, referred to committee</td><td>March 7, 2024</td></tr><tr><td>no date</td></tr></table><li>Royal Assent: May 30 2024</li><li>Royal Assent: May 30 2024</li>"
    rows = chunks.stage_events(frame(spark, [(1, html), (2, None)], "id int, html string"), "id").collect()
    assert [(r["sequence"], r["stage"], str(r["day"])) for r in rows] == [(0, "first_reading", "2024-03-05"), (1, "committee", "2024-03-07"), (2, "royal_assent", "2024-05-30")]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a <b>b</b></p>", "<p>a b</p>"),
        ("<a href=javascript:alert(1)>x</a>", "<a>x</a>"),
        ('<a/onclick=alert(1) href="https://e.org/?a=1&amp;b=2">x</a>', '<a href="https://e.org/?a=1&amp;b=2">x</a>'),
        ('<a href="java&#115;cript:alert(1)">x</a>', "<a>x</a>"),
        ('<a href="java\tscript:alert(1)">x</a><a href=" JAVASCRIPT:x">y</a>', "<a>x</a><a>y</a>"),
        ("<script>bad()</script>ok<style>p{}</style>", "ok"),
        ("<p>1 < 2 &lt;script&gt;", "<p>1 &lt; 2 &lt;script&gt;</p>"),
        ("<ul><li>a</ul>b", "<ul><li>a</li></ul>b"),
        ("<iframe src=x><p>in</p></iframe>out", "out"),
        ("<svg onload=alert(1)>x</svg><img src=x onerror=y>z", "z"),
        ('<a href="/speeches/1#c">in</a><a href="data:text/html,x">out</a>', '<a href="/speeches/1#c">in</a><a>out</a>'),
        (None, None),
    ],
)
def test_sanitised(spark, html, want):
    assert frame(spark, [(html,)], "h string").select(markup.sanitised(F.col("h")).alias("h")).first()["h"] == want


def test_only_links_of_a_prefix_stay(spark):
    html = '<a href="/speeches/1">a</a><a href="https://e.org">b</a>'
    out = frame(spark, [(html,)], "h string").select(markup.sanitised(F.col("h"), prefix="/speeches/").alias("h")).first()["h"]
    assert out == '<a href="/speeches/1">a</a><a>b</a>'


@pytest.mark.parametrize(
    ("link", "stays"),
    [("/speeches/1", True), (" /speeches/1#c", True), ("//evil.example/x", False), ("/\\evil.example/x", False), ("/\t/evil.example", False), ("/speeches/../x", False), ("/speeches/%2e%2e/x", False), ("/%2Fevil.example", False), ("/other/1", False), ("speeches/1", False)],
)
def test_links_of_another_host_go(spark, link, stays):
    for prefix in ("/speeches/", "/"):
        out = markup.clean(f'<a href="{link}">a</a>', prefix=prefix)
        assert ("href" in out) == (stays or (prefix == "/" and link == "/other/1"))


def test_text_behind_void_tags_stays(spark):
    assert markup.clean("a<embed src=x>the rest<p>b") == "athe rest<p>b</p>"
    assert markup.clean("a<object><embed src=x>in</object>out") == "aout"


def test_shared_slugs_decide_nothing(spark):
    entities = frame(spark, [(1, "a", "Ann"), (2, "a", "Bob"), (3, "c", "Cy"), (4, None, "Di")], "k int, slug string, name string")
    rows = frame(spark, [(10, "a", "Ann"), (11, "a", "none"), (12, "c", "Ann"), (13, None, "Di"), (14, "x", "Cy")], "id int, slug string, name string")
    got = sorted(tuple(r) for r in resolve.by_key_then_name(rows, entities, "id", "k", "slug", "name").select("id", "k", "learned").collect())
    assert got == [(10, 1, False), (11, None, False), (12, 3, False), (13, 4, True), (14, 3, True)]


def test_merges_follow_chains(spark):
    pairs = [(1, 2), (2, 3), (3, 9), (5, 6), (5, 7), (8, 8), (None, 1)] + [(k, k + 1) for k in range(100, 140)]
    mapping = frame(spark, pairs, "loser int, winner int")
    got = {tuple(r) for r in upserts.last_winners(mapping).collect()}
    assert got == {(1, 9), (2, 9), (3, 9), (5, 6)} | {(k, 140) for k in range(100, 140)}
    rows = frame(spark, [(1, "x"), (3, "x"), (4, "y"), (5, "z"), (120, "q")], "who int, what string")
    assert sorted(tuple(r) for r in upserts.merge_entities(rows, mapping, "who", ["who", "what"]).collect()) == [(4, "y"), (6, "z"), (9, "x"), (140, "q")]
    for circle in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (7, 1)]):
        with pytest.raises(ValueError, match="circle"):
            upserts.last_winners(frame(spark, circle, "loser int, winner int"))


def test_readers_that_raise(spark, tmp_path):
    from siltstone.sources.tables import binary_pages

    for name, raw in (("a.pdf", b"good"), ("b.pdf", b"bad"), ("c.pdf", b"other")):
        (tmp_path / name).write_bytes(raw)

    def reader(raw):
        return {b"good": lambda: "text", b"bad": lambda: 1 / 0}[raw]()

    got = {r["url"].rsplit("/", 1)[1]: r["text"] for r in binary_pages(spark, str(tmp_path), reader).collect()}
    assert got == {"a.pdf": "text", "b.pdf": None, "c.pdf": None}


def test_gap_matrix_takes_a_short_list(spark):
    from siltstone.operators import rollups

    people, kinds, have = frame(spark, [(1,), (2,)], "p int"), frame(spark, [("x",), ("y",), ("x",)], "k string"), frame(spark, [(1, "x")], "p int, k string")
    assert sorted(tuple(r) for r in rollups.gap_matrix(people, kinds, have, "p", "k").collect()) == [(1, "y"), (2, "x"), (2, "y")]
    assert rollups.gap_matrix(people, kinds.limit(0), have, "p", "k").count() == 0
    with pytest.raises(ValueError, match="at most"):
        rollups.gap_matrix(people, kinds, have, "p", "k", most=1)


def test_shared_folders_go(spark):
    from siltstone.sources import shared

    kept = set(shared._owned)
    shared._owned.clear()
    own, other = shared.Workspace(spark, "t"), shared.Workspace(spark, "t")
    for w in (own, other):
        w.keep(spark.range(3), "x")
    own.drop()
    assert shared._owned == {other.root}
    shared.sweep(spark)
    assert not shared._owned and not any((lambda f: f[0].exists(f[1]))(shared.file_system(spark, w.root)) for w in (own, other))
    shared._owned.update(kept)


def test_rewritten_links(spark):
    one, two = "0a1b2c3d-0000-4000-8000-00000000000a", "0a1b2c3d-0000-4000-8000-00000000000b"
    html = f"""<a href="CHUNK:{one}">x</a> <a href='chunk:{two}'>y</a> <a href="https://e.org">z</a>"""
    targets = F.create_map(F.lit(one), F.lit("/speeches/7#chunk-ab-1"))
    out = frame(spark, [(html,)], "h string").select(markup.rewritten_links(F.col("h"), targets).alias("h")).first()["h"]
    assert out == """<a href="/speeches/7#chunk-ab-1">x</a> <a >y</a> <a href="https://e.org">z</a>"""


def test_intervals_have_no_last_year(spark):
    spans = frame(spark, [("a", day("1990-05-01"), None), ("b", day("2150-01-01"), day("2150-12-31")), ("c", None, None), ("d", day("2000-01-01"), day("1999-01-01"))], "name string, s timestamp_ntz, e timestamp_ntz")
    facts = frame(spark, [(1, day("2101-03-01")), (2, day("2150-12-31")), (3, day("1890-01-01")), (4, None), (5, day("1990-05-01"))], "id int, d timestamp_ntz")
    got = {(r["id"], r["name"]) for r in intervals.interval_join(facts, spans, "d", "s", "e").collect()}
    assert got == {(1, "a"), (2, "a"), (2, "b"), (5, "a")}
    left = intervals.interval_join(facts, spans, "d", "s", "e", how="left", bin_days=7).collect()
    assert {(r["id"], r["name"]) for r in left} == got | {(3, None), (4, None)}
    assert intervals.interval_join(facts.limit(0), spans, "d", "s", "e").count() == 0


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    rows = []
    for k in range(120):
        s = start + dt.timedelta(days=rnd.randint(0, 400))
        e = None if rnd.random() < 0.1 else s + dt.timedelta(days=rnd.choice([0, 1, 5, 30, 200, -3]))
        rows.append((k, rnd.choice("xy"), None if rnd.random() < 0.05 else s, e))
    a = frame(spark, rows, "i int, p string, s timestamp_ntz, e timestamp_ntz")
    b = a.toDF("j", "p", "t", "u")
    late = dt.datetime(9999, 1, 1)
    ok = [r for r in rows if r[2] and (r[3] is None or r[3] >= r[2])]
    want = {(x[0], y[0]) for x in ok for y in ok if x[1] == y[1] and x[2] <= (y[3] or late) and y[2] <= (x[3] or late)}
    for bin_days in (1, 31, 1000):
        found = intervals.overlapping(a, b, ["p"], ("s", "e"), ("t", "u"), bin_days).select("i", "j").collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_equal_terms_have_one_holder(spark):
    terms = frame(spark, [("x", h, day("2020-01-01"), None) for h in "cab"], "role string, holder string, s timestamp_ntz, e timestamp_ntz")
    facts = frame(spark, [(1, "x", day("2020-06-01"))], "id int, role string, d timestamp_ntz")
    assert [r["holder"] for r in intervals.holder_at(facts, terms, "d", "s", "e", ["role"], "id").collect()] == ["a"]


def test_repeated_keys_count_once(spark):
    schema = "k int, v string, conf double, src string"
    old = frame(spark, [(1, "a", 0.9, "o")], schema)
    new = frame(spark, [(1, "b", 0.5, "n"), (1, "c", 0.95, "m"), (2, "d", 0.3, "n"), (2, "e", 0.3, "n")], schema)
    rows = lambda df: sorted(tuple(r)[:2] for r in df.collect())
    assert rows(upserts.upsert(old, new, ["k"])) == [(1, "c"), (2, "e")]
    assert rows(upserts.upsert_if_surer(old, new, ["k"], "conf", ["src"])) == [(1, "c"), (2, "e")]
    assert rows(upserts.insert_absent(old, new, ["k"])) == [(1, "a"), (2, "e")]
    assert rows(upserts.fill_blanks(old.withColumn("v", F.lit("")), new, ["k"])) == [(1, "c")]
    assert rows(upserts.apply_batch(old, [1, 1], ["z", None], "k", "v")) == [(1, None)]


def test_scan_changes_of_all_kinds(spark):
    rows = [(1, 1, "WP", "A", 2, ["1", "2"]), (1, 2, "Ghost", "B", 2, ["2", "3"])]
    scans = frame(spark, rows, "site_id int, scanned_at int, cms string, tls_issuer string, tier int, ips array<string>")
    got = {r["kind"]: (r["severity"], r["added"], r["removed"]) for r in changes.scan_changes(scans).collect()}
    assert got == {"cms_changed": ("info", None, None), "tls_issuer_changed": ("info", None, None), "ip_changed": ("info", ["3"], ["1"])}


def test_index_percentiles(spark):
    rnd = random.Random(5)
    rows = [("big", rnd.choice([1.0, 2.0, rnd.random()])) for _ in range(3000)] + [("one", 7.0), (None, 1.0), (None, 2.0), ("gone", None)]
    found = rollups.index_percentiles(frame(spark, rows, "k string, v double").repartition(5), ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    at = lambda xs, q: sorted(xs)[min(int(len(xs) * q), len(xs) - 1)]
    assert {tuple(r) for r in found} == {(k, *(at(xs, q) for q in (0, 0.5, 0.95, 1))) for k, xs in want.items()}


def test_party_report(spark):
    members = frame(spark, [("A", 1), ("A", 2), ("A", 3), ("B", 4), ("C", 5)], "party string, id int")
    sites = frame(spark, [("A", 1, "h", 1, 1, 2), ("A", 2, "h", 2, 2, 4), ("A", 1, "g", 1, 3, 1), ("B", 4, "k", 1, 4, None)], "party string, id int, host string, at int, n int, tier int")
    rows = {r["party"]: tuple(r)[1:] for r in rollups.party_report(members, sites, "party", "id", "host", "at", "n", "tier").collect()}
    assert rows == {"A": (3, 2, 1, 0, 1, 0, 1, 50, "C"), "B": (1, 1, 0, 0, 0, 0, 0, 0, "F"), "C": (1, 0, 0, 0, 0, 0, 1, 0, "F")}
    own = {r["id"]: (r["worst"], r["best"], r["home"], [s["host"] for s in r["sites"]]) for r in rollups.member_sites(sites, "id", "tier", "n", ["host"]).collect()}
    assert own == {1: (2, 1, 2, ["h", "g"]), 2: (4, 4, 0, ["h"]), 4: (6, 6, 0, ["k"])}
    assert [tuple(r) for r in rollups.top_values(sites.withColumn("p", F.lit("X")), "party", "host", "at", "n", "p").orderBy("party").collect()] == [("A", "X", 2), ("B", "X", 1)]


def test_presiding_names(spark):
    people = frame(spark, [(1, "jean augustine", "augustine"), (2, "ann tall", "tall"), (3, "bob tall", "tall")], "k int, full string, last string")
    said = frame(spark, [(10, "The Deputy Speaker (Hon. Jean Augustine)"), (11, "The Acting Speaker (Mr. Augustine)"), (12, "The Chair (Mr. Tall)"), (13, "The Speaker"), (14, None)], "id int, line string")
    out = resolve.presiding(said, people, "id", "k", "line", "full", "last").collect()
    assert {r["id"]: (r["k"], r["confidence"]) for r in out} == {10: (1, 1.0), 11: (1, 0.9), 12: (None, None), 13: (None, None), 14: (None, None)}


def test_pairs_of_known_ids(spark):
    pairs = frame(spark, [(1, 2), (2, 1), (1, 1), (1, 9), (3, 2)], "a int, b int")
    known = frame(spark, [(1,), (2,), (3,), (3,)], "id int")
    assert sorted(map(tuple, resolve.valid_pairs(pairs, "a", "b", known, "id").collect())) == [(1, 2), (2, 3)]


def test_quality_means(spark):
    quality = frame(spark, [(1, 0.5, 1.0), (2, 0.0, 0.5), (3, 1.0, 0.0)], "q int, ndcg double, recall double")
    asked = frame(spark, [(1, "A", "en", "en"), (2, "A", "en", "fr"), (3, None, "fr", None)], "q int, category string, language string, target_language string")
    got = {r["category"]: tuple(r)[1:] for r in retrieval.quality_means(quality, asked, "q", "category").collect()}
    assert got == {"A": (2, 0.25, 0.75), "_uncat": (1, 1.0, 0.0), "*": (3, 0.5, 0.5)}
    ranking = frame(spark, [(2, "a", 1), (2, "b", 11)], "q int, item string, r int")
    wanted = frame(spark, [(1, "z"), (2, "a"), (2, "b")], "q int, item string")
    assert tuple(retrieval.cross_lingual_recall(ranking, wanted, asked, "q", "item", "r").first()) == (1, 0.5)


def test_nearest_of_each_equals_brute_force(spark):
    rnd = np.random.default_rng(2)
    vectors = [rnd.integers(-2, 3, 4).astype(float).tolist() for _ in range(60)] + [None, [0.0] * 4]
    rows = frame(spark, list(enumerate(vectors)), "id int, embedding array<double>").repartition(4)
    asked = rows.where("id % 10 = 0").selectExpr("id AS qid", "embedding AS q")
    found = search.nearest_of_each(rows, asked, "id", "qid", 3).collect()

    def sim(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b) if a and b else 0
        return round(float(np.dot(a, b) / size), 6) if size else None

    want = set()
    for q in range(0, len(vectors), 10):
        ranked = sorted((-s, k) for k, v in enumerate(vectors) if (s := sim(v, vectors[q])) is not None)
        want |= {(q, k, -s) for s, k in ranked[:3]}
    assert {(r["qid"], r["id"], round(r["sim"], 6)) for r in found} == want
    one = search.with_similarity(rows, frame(spark, [([1.0, 0.0, 0.0, 0.0],)], "q array<double>"))
    assert {r["id"]: r["sim"] for r in one.collect()} == {k: sim(v, [1.0, 0, 0, 0]) for k, v in enumerate(vectors)}
    assert search.with_similarity(rows, frame(spark, [], "q array<double>")).where("sim IS NOT NULL").count() == 0


def test_facets_keep_the_largest(spark):
    pool = frame(spark, [(k % 3, float(k)) for k in range(7)] + [(None, 1.0)], "g int, sim double")
    rows = search.facets(pool, {"g": F.col("g"), "all": F.lit("x")}, most={"g": 2}).collect()
    assert {(r["facet"], r["value"], r["n"]) for r in rows} == {("g", "0", 3), ("g", "1", 2), ("all", "x", 8)}


def test_turns(spark):
    html = '<p class="TimeStamp">1000</p><p class="SpeakerBegins">Ann: one</p><p class="SpeakerContinues">two</p><p class="SubjectHeading">H</p><p class="SpeakerContinues">lost</p><p class="SpeakerBegins">Bob: three</p>'
    rows = chunks.turns(frame(spark, [(1, html)], "id int, html string"), "id").orderBy("sequence").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "Ann", "one\ntwo", "1000"), (1, 1, "Bob", "three", "1000")]


def test_ranking_quality(spark):
    ranking = frame(spark, [(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q int, item string, r int")
    wanted = frame(spark, [(1, "a"), (1, "c"), (2, "z")], "q int, item string")
    got = {r["q"]: (r["ndcg"], r["recall"]) for r in retrieval.ranking_quality(ranking, wanted, "q", "item", "r").collect()}
    assert got == {1: (round((1 + 0.5) / (1 + 1 / 1.5849625007), 6), 1.0), 2: (0.0, 0.0)}


def test_sample_adds_up(spark):
    rows = frame(spark, [(k, "a" if k < 66 else "b" if k < 89 else "c") for k in range(100)], "id int, s string")
    drawn = retrieval.stratified_sample(rows, ["s"], "id", 10, seed=1).collect()
    assert len(drawn) == 10 and {r["s"] for r in drawn} == {"a", "b", "c"}
    again = retrieval.stratified_sample(rows, ["s"], "id", 10, seed=1).collect()
    assert sorted(drawn) == sorted(again)


def test_boundaries(spark):
    square = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}'
    rows = frame(spark, [(1, square), (2, None), (3, '{"type":"Point","coordinates":[1,2]}')], "id int, g string")
    out = {r["id"]: r["geo"] for r in geo.with_facts(rows, "g").collect()}
    assert abs(out[1]["area_km2"] - 12364) < 30 and (out[1]["lng"], out[1]["lat"]) == (0.5, 0.5)
    assert out[2]["area_km2"] is None and out[3]["area_km2"] is None
    assert geo.simplified(rows, "g").where("simple IS NOT NULL").count() == 1
    assert geo.collected(rows.where("id = 1").union(rows.where("id = 1")), [], "g").first()["outline"].count("[[[0.0") == 2


def test_borders_between_polygons_go(spark):
    cell = lambda x, y, turned: json.dumps({"type": "Polygon", "coordinates": [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]][:: -1 if turned else 1]]})
    # A ring of eight cells around a hole, in both directions, and one cell apart.
    cells = [("a", cell(x, y, (x + y) % 2)) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [("a", cell(10, 10, False)), ("b", cell(0, 0, True))]
    rows = {r["k"]: json.loads(r["outline"])["coordinates"] for r in geo.dissolved(frame(spark, cells, "k string, g string"), ["k"], "g").collect()}
    assert [len(p) for p in rows["a"]] == [2, 1] and len(rows["a"][0][0]) == 13 and len(rows["a"][0][1]) == 5
    facts = geo.with_facts(frame(spark, [(json.dumps({"type": "MultiPolygon", "coordinates": rows["a"]}),)], "g string"), "g").first()["geo"]
    parts = geo.with_facts(frame(spark, [c for c in cells if c[0] == "a"], "k string, g string"), "g").agg(F.sum("geo.area_km2")).first()[0]
    assert abs(facts["area_km2"] - parts) < 1 and len(rows["b"]) == 1


def test_outlines_in_two_steps(spark):
    """Overlaps, T-junctions and nested polygons, in blocks of a few points as in one."""
    rnd = random.Random(3)
    boxes = [(k % 2, rnd.randint(0, 20), rnd.randint(0, 20), rnd.randint(1, 6), rnd.randint(1, 6)) for k in range(120)] + [(2, 0, 0, 0, 3), (3, 0, 0, 1, 1)]
    shape = lambda x, y, w, h: json.dumps({"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]})
    rows = frame(spark, [(k, shape(*b)) for k, *b in boxes] + [(4, None), (3, '{"type":"Point","coordinates":[1,2]}')], "k int, g string")
    cells = {k: {(x + i, y + j) for q, x, y, w, h in boxes if q == k for i in range(w) for j in range(h)} for k in range(4)}
    for block in (20_000, 30):
        found = {r["k"]: r["a"] for r in geo.dissolved(rows, ["k"], "g", block_points=block).select("k", geo.planar_area("outline").alias("a")).collect()}
        assert {k: round(a, 6) for k, a in found.items() if a is not None} == {k: len(c) for k, c in cells.items() if c}


def test_common_borders_are_simplified_once(spark):
    wave = [[5 + 0.01 * (-1) ** k, k] for k in range(1, 10)]  # the border between two neighbours
    left = [[0, 0], [5, 0], *wave, [5, 10], [0, 10], [0, 0]]
    right = [[5, 0], [9, 0], [9, 10], [5, 10], *wave[::-1], [5, 0]]
    island = [[20, 0], [21, 0.001], [22, 0], [22, 2], [20, 2], [20, 0]]
    rows = frame(spark, [(n, json.dumps({"type": "Polygon", "coordinates": [r]})) for n, r in (("l", left), ("r", right), ("i", island))] + [("x", None)], "n string, g string")
    for tolerance in (0.5, 0.001):
        out = {r["n"]: json.loads(r["simple"])["coordinates"][0][0] for r in geo.simplified_together(rows, "n", "g", tolerance).collect()}
        assert set(out) == {"l", "r", "i"}
        border = lambda ring: {tuple(p) for p in ring if 4 < p[0] < 6}
        assert border(out["l"]) == border(out["r"]) and len(border(out["l"])) == (2 if tolerance == 0.5 else 11)
    assert len(out["i"]) == 5


def test_simplified_rings_do_not_cross_themselves(spark):
    # A thin tongue: without its own points the two sides of it would cross the far bank.
    ring = [[0, 0], [10, 0], [10, 4], [5, 0.2], [0, 4], [0, 0]]
    bumpy = [[0, 0], [4.9, 0], [5, 0.3], [5.1, 0], [10, 0], [10, 4], [5, 0.2], [0, 4], [0, 0]]
    assert geo._crosses_itself(np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]], float)) and not geo._crosses_itself(np.array(ring, float))
    rows = frame(spark, [(json.dumps({"type": "Polygon", "coordinates": [r]}),) for r in (ring, bumpy)], "g string")
    for r in geo.simplified(rows, "g", tolerance=0.5).collect():
        for polygon in json.loads(r["simple"])["coordinates"]:
            assert not geo._crosses_itself(np.array(polygon[0])) or polygon[0] == bumpy


def test_geo_lookup(spark):
    nets = frame(spark, [(16777216, 16777471, "AU"), (3232235520, 3232301055, "home")], "first long, last long, country string")
    asked = frame(spark, [("1.0.0.7",), ("192.168.3.4",), ("9.9.9.9",), ("no",), (None,)], "ip string")
    got = {r["ip"]: r["country"] for r in tables.geo_lookup(asked, nets, "ip").collect()}
    assert got == {"1.0.0.7": "AU", "192.168.3.4": "home", "9.9.9.9": None, "no": None, None: None}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "urls": ["x", "y"]}\nnot json\n{"id": 2, "urls": []}\n')
    rows = tables.json_lines(spark, str(tmp_path / "a.jsonl"), "id int, urls array<string>", explode="urls")
    assert sorted(map(tuple, rows.collect())) == [(1, "x"), (1, "y")]
    (tmp_path / "p.json").write_text('{"objects": [{"a": 1}, {"a": 2}], "next_url": null}')
    assert tables.json_pages(spark, str(tmp_path / "p.json")).count() == 2
    (tmp_path / "f.csv").write_text('id,name\n1,"a,b"\n')
    assert tables.csv_feed(spark, str(tmp_path / "f.csv"), "id int, name string").first()["name"] == "a,b"
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>T</title></item><item><title>U</title></item></channel></rss>")
    assert tables.xml_feed(spark, str(tmp_path / "r.xml")).count() == 2
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"n": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}')
    assert tables.geojson_features(spark, str(tmp_path / "g.json")).first()["properties"] == {"n": "x"}
    (tmp_path / "q.json").write_text('{"data": {"nodes": [{"id": 5}, {"id": 6}]}}')
    assert tables.graphql_nodes(spark, str(tmp_path / "q.json"), "data.nodes", "id int").count() == 2


def test_networks_that_overlap_give_one_row(spark):
    nets = frame(spark, [(16777216, 16777471, "wide"), (16777220, 16777230, "narrow")], "first long, last long, name string")
    asked = frame(spark, [("1.0.0.7",), ("1.0.0.200",), ("1.0.0.7",)], "ip string")
    assert sorted(r["name"] for r in tables.geo_lookup(asked, nets, "ip").collect()) == ["narrow", "narrow", "wide"]


def test_more_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"results": {"bindings": [{"q": {"type": "uri", "value": "Q1"}}, {"q": {"type": "uri", "value": "Q2"}, "x": {"type": "literal", "value": "y"}}]}}')
    assert sorted(map(tuple, tables.sparql_rows(spark, str(tmp_path / "s.json"), ["q", "x"]).collect()), key=repr) == [("Q1", None), ("Q2", "y")]
    (tmp_path / "a.pdf").write_bytes(b"%text of a page")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.html").write_text("<p>x</p>")

    def to_text(raw):
        if not raw.startswith(b"%"):
            raise ValueError("no page")
        return raw[1:].decode()

    assert {r["text"] for r in tables.binary_pages(spark, str(tmp_path), to_text).collect()} == {"text of a page", None}
    assert tables.html_pages(spark, str(tmp_path / "c.html")).first()["html"] == "<p>x</p>"
    assert tables.newest(frame(spark, [(1,), (3,), (None,)], "at int"), "at").first()["seen_to"] == 3


def test_pages_follow_their_links(spark):
    failed = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            page = int(self.path.rsplit("=", 1)[1])
            if page == 2 and not failed:
                failed.append(page)
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"objects": [{"n": page * 10 + k} for k in range(2)], "next_url": f"/?page={page + 1}" if page < 3 else None}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        first = f"http://127.0.0.1:{server.server_port}/?page="
        rows = paged.paged_json(spark, [first + "1", first + "3"], wait=0.01).select(F.get_json_object("value", "$.n").cast("int").alias("n")).collect()
        assert sorted(r["n"] for r in rows) == [10, 11, 20, 21, 30, 30, 31, 31] and failed
    finally:
        server.shutdown()


def test_outputs(spark, tmp_path):
    rows = frame(spark, [(1, "a,\"b\""), (2, None)], "id int, name string")
    outputs.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.csv_feed(spark, str(tmp_path / "csv"), "id int, name string").collect()), key=repr) == [(1, 'a,"b"'), (2, None)]
    outputs.write_json_lines(rows, str(tmp_path / "json"))
    assert tables.json_lines(spark, str(tmp_path / "json"), "id int, name string").count() == 2
    for wanted in (rows, rows.where("id = 1")):
        assert outputs.refresh(wanted, str(tmp_path / "view")).count() == wanted.count()
    items = frame(spark, [(k, f"<item>{k}</item>") for k in range(5)], "at int, item string")
    assert outputs.rss_channel(items, "A & B", "https://e.org", "d", "at", most=2).first()["feed"].endswith("<title>A &amp; B</title><link>https://e.org</link><description>d</description><item>4</item><item>3</item></channel></rss>")
    assert outputs.touched(rows, F.lit("now")).columns == ["id", "name", "updated_at"]


def test_socials_of_pages(spark):
    html = '<a href="https://twitter.com/ann">a</a><a href="https://x.com/ann">b</a><a href="https://bsky.app/profile/ann.b">c</a><a href="https://other.org/x">d</a><a href="https://twitter.com/login">e</a>'
    rows = chunks.page_socials(frame(spark, [(1, "https://own.org", html)], "id int, url string, html string"), "id").collect()
    assert {tuple(r) for r in rows} == {(1, "twitter", "ann"), (1, "bluesky", "ann.b")}


def test_candidates_of_platforms(spark):
    people = frame(spark, [(1, ["Ann", "Tall"])], "id int, words array<string>")
    rows = {(r["platform"], r["handle"]) for r in chunks.platform_candidates(people, "id", "words").collect()}
    assert {("twitter", "ann_tall"), ("bluesky", "anntall.bsky.social"), ("mastodon", "@talla@mastodon.social")} - rows == {("mastodon", "@talla@mastodon.social")}
    assert ("twitter", "ann.tall") not in rows and ("instagram", "ann.tall") in rows


def test_counts_come_with_the_write(spark, tmp_path):
    rows, seen = upserts.counted(frame(spark, [(1, "a"), (2, None), (3, "b")], "id int, v string"), "step", blank=F.col("v").isNull())
    rows.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 3, "blank": 1}


def test_mapped_report(spark):
    rows = frame(spark, [(k, f"t{k}") for k in range(25)], "id int, text string")
    mapper, known = lambda body: f"{len(body.split())}", "0a1b2c3d-0000-4000-8000-00000000000a"
    reducer = lambda answers: f'<p>{"+".join(answers)} <a href="CHUNK:{known}">in</a><a href="CHUNK:{known[::-1]}">none</a><script>x</script></p>'
    out = rollups.mapped_report(rows, [F.col("id")], "text", mapper, reducer, {known: "/speeches/1#ab"}, size=10, most=22).collect()
    assert [r["report"] for r in out] == ['<p>10+10+2 <a href="/speeches/1#ab">in</a><a>none</a></p>']
