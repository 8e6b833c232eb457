"""Streams across batches, restarts and failures."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.plans import stream_plans
from siltstone.streaming import feeds, percolator, timed
from siltstone.streaming.percolator import Percolator
from tests.test_postings import answer

START = dt.datetime(2024, 1, 1)


def files(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return feeds.file_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)


def brute_changes(rows):
    last, out = {}, set()
    for key, at, tie, value in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in last and last[key] != value:
            out.add((key, tie, last[key], value))
        last[key] = value
    return out


SCHEMA = "k int, at timestamp, tie int, v string"


def found(frame):
    rows = frame.collect()
    out = {(r["k"], r["tie"], r["old"], r["new"]) for r in rows}
    assert len(rows) == len(out)
    return out


def test_changes_across_batches_out_of_order(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(k % 5, START + dt.timedelta(minutes=k, microseconds=k * 7), k, rnd.choice("abc")) for k in range(300)]
    late = [(r, r[2] + rnd.randint(0, 50)) for r in rows]
    batches = [[r for r, n in late if n // 90 == b] for b in range(4)]
    work = lambda: timed.StateChanges(str(tmp_path / "state"), "k", "at", "tie", "v", late="1 hour")
    stream = files(spark, str(tmp_path / "in"), batches[:2], SCHEMA)
    first = work().drain(stream, str(tmp_path / "checkpoint"))
    assert found(first) < brute_changes(rows) and found(first)
    # The next run takes the other files and goes on where the first one stopped; with nothing new it writes nothing.
    stream = files(spark, str(tmp_path / "in"), batches[2:], SCHEMA)
    assert found(work().drain(stream, str(tmp_path / "checkpoint"))) < brute_changes(rows)
    again = work()
    assert found(again.drain(stream, str(tmp_path / "checkpoint"), complete=True)) == brute_changes(rows)
    too_late = files(spark, str(tmp_path / "in"), [[(0, START, 999, "z")]], SCHEMA)
    assert again.dropped == 0
    assert found(again.drain(too_late, str(tmp_path / "checkpoint"))) == brute_changes(rows) and again.dropped == 1


def test_keys_that_did_not_come_are_not_written(spark, tmp_path):
    """The state that a batch writes is that of its own keys and of those whose timers fire."""
    minutes = lambda m: START + dt.timedelta(minutes=m)
    batches = [[(k, minutes(0), k, "a") for k in range(50)], [(0, minutes(300), 100, "b")], [(0, minutes(600), 101, "c")], [(1, minutes(900), 102, "c")]]
    stream = files(spark, str(tmp_path / "in"), batches, SCHEMA)
    work = timed.StateChanges(str(tmp_path / "state"), "k", "at", "tie", "v", late="1 minute")
    got = work.drain(stream, str(tmp_path / "checkpoint"))
    assert found(got) == {(0, 100, "a", "b"), (0, 101, "b", "c")}  # the last row can still be overtaken
    written = [r["stateOperators"][0]["numRowsUpdated"] for r in work.progress]
    assert max(written[3:]) <= 4  # once all first timers have fired


def test_a_key_is_written_once_in_a_batch(spark, tmp_path):
    """Whatever number of rows a key has waiting, its state is written once; its changes leave Python in parts."""
    rnd = random.Random(3)
    rows = [(n % 4, START + dt.timedelta(minutes=n), n, rnd.choice("ab")) for n in range(9000)]
    stream = files(spark, str(tmp_path / "in"), [rows[:8400], rows[8400:8700], rows[8700:]], SCHEMA)
    work, written = timed.StateChanges(str(tmp_path / "state"), "k", "at", "tie", "v", late="1 hour"), []
    run = work._run
    work._run = lambda *a, **k: (run(*a, **k), written.extend(p["stateOperators"][0]["numRowsUpdated"] for p in work.progress))
    assert found(work.drain(stream, str(tmp_path / "checkpoint"), complete=True)) == brute_changes(rows)
    assert len(written) >= 4 and max(written) <= 4


def test_keys_of_a_bucket_are_written_as_one(spark, tmp_path):
    """However many keys come, a bucket is read and written once in a batch; not a number and both zeros are a key each."""
    rnd = random.Random(4)
    keys = [float("nan"), 0.0, -0.0, None, *(float(k) for k in range(1, 60))]
    rows = [(keys[n % 63], START + dt.timedelta(minutes=n), n, rnd.choice("ab")) for n in range(1200)]
    schema = SCHEMA.replace("k int", "k double")
    work, written = timed.StateChanges(str(tmp_path / "state"), "k", "at", "tie", "v", late="1 day", forget="10 days", buckets=1), []
    run = work._run
    work._run = lambda *a, **k: (run(*a, **k), written.extend(p["stateOperators"][0]["numRowsUpdated"] for p in work.progress))
    stream = files(spark, str(tmp_path / "in"), [rows[1::2], rows[::2]], schema)
    got = work.drain(stream, str(tmp_path / "checkpoint"), complete=True)
    name = lambda k: "0.0" if k == 0 else str(k)
    assert {(name(k), *rest) for k, *rest in found(got)} == brute_changes([(name(k), *rest) for k, *rest in rows])
    assert len(written) >= 3 and max(written) <= 1


def test_a_silent_key_is_forgotten(spark, tmp_path):
    day = lambda d: START + dt.timedelta(days=d)
    batches = [[(1, day(0), 1, "a"), (2, day(0), 2, "a")], [(2, day(3), 3, "b")], [(2, day(8), 4, "c"), (3, day(20), 5, "x")], [(1, day(21), 6, "b"), (2, day(22), 7, "d")]]
    stream = files(spark, str(tmp_path / "in"), batches, SCHEMA)
    work = timed.StateChanges(str(tmp_path / "state"), "k", "at", "tie", "v", late="1 hour", forget="7 days")
    # Key 1 was silent for twenty days and key 2 for fourteen: what comes then is no change.
    assert found(work.drain(stream, str(tmp_path / "checkpoint"), complete=True)) == {(2, 3, "a", "b"), (2, 4, "b", "c")}


def test_nulls_and_equal_times(spark, tmp_path):
    rows = [(1, START, 2, "b"), (1, START, 1, "a"), (1, None, 3, "x"), (1, START + dt.timedelta(hours=1), 4, None), (1, START + dt.timedelta(hours=2), 5, "b"), (None, START, 6, "a"), (None, START + dt.timedelta(hours=1), 7, "b")]
    work = timed.StateChanges(str(tmp_path / "state"), "k", "at", "tie", "v")
    assert found(work.drain(files(spark, str(tmp_path / "in"), [rows], SCHEMA), str(tmp_path / "checkpoint"), complete=True)) == {(1, 2, "a", "b"), (None, 7, "a", "b")}
    nothing = timed.StateChanges(str(tmp_path / "other"), "k", "at", "tie", "v")
    (tmp_path / "none").mkdir()
    assert nothing.drain(feeds.file_stream(spark, str(tmp_path / "none"), spark.createDataFrame([], SCHEMA).schema), str(tmp_path / "c2")).count() == 0


def test_keys_are_remembered_as_long_as_asked(spark, tmp_path):
    schema = "id int, at timestamp"
    days = [[(k, START + dt.timedelta(days=d)) for k in keys] for d, keys in ((0, (0, 1, 2)), (5, (0, 1, 2)), (20, (7,)), (21, (7,)), (40, (0, 1, 2)), (0, (9,)))]
    folder = str(tmp_path / "in")
    stream = lambda rows: files(spark, folder, rows, schema)
    assert feeds.drain(feeds.first_of_key(stream(days), "id", "at"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).count() == 7
    assert feeds.drain(feeds.first_of_key(stream([]), "id", "at", within=None), str(tmp_path / "out2"), str(tmp_path / "checkpoint2")).count() == 5


def standing(spark, folder, deliver, rows, late="1 hour", most=10):
    saved = spark.createDataFrame([(i, {"kind": [k]}, since) for i, k, since in rows], "search_id int, filters map<string,array<string>>, last_checked_at timestamp_ntz")
    return feeds.StandingQueries(Percolator(saved, ["kind"], "at", "id"), deliver, folder, late=late, most=most)


def test_watermarks_outlive_the_driver_and_failures(spark, tmp_path):
    schema = "id int, kind string, at timestamp_ntz"
    delivered = []

    def deliver(found, number):
        rows = {(r["search_id"], r["id"]) for r in found.collect()}
        if number == 1:
            raise OSError("the mail server is away")
        delivered.append((number, rows))
        return [2] if number == 0 else []

    def queries():
        return standing(spark, str(tmp_path), deliver, [(1, "a", None), (2, "b", None)])

    at = lambda day: dt.datetime(2024, 1, day)
    batches = [[(1, "a", at(1)), (2, "b", at(1))], [(3, "a", at(2))], [(4, "a", at(4)), (5, "a", dt.datetime(2023, 12, 31))]]
    for number, rows in enumerate(batches):
        queries()(spark.createDataFrame(rows, schema), number)  # a new driver each time
    # Search 2 failed at first and all failed in the second batch: both come again; row 5 is not new for search 1.
    assert delivered == [(0, {(1, 1), (2, 2)}), (2, {(1, 3), (1, 4), (2, 2)})]
    late = dt.timedelta(hours=1)
    assert {r["search_id"]: r["last_checked_at"] for r in queries().watermarks(spark).collect()} == {1: at(4) - late, 2: at(4) - late}
    assert queries().failures(spark) == [(1, "OSError: the mail server is away")]


def test_late_matches_are_delivered_once(spark, tmp_path):
    schema = "id int, kind string, at timestamp_ntz"
    delivered = []
    work = standing(spark, str(tmp_path), lambda found, n: delivered.append(sorted(r["id"] for r in found.collect())), [(1, "a", None)], late="2 hours")
    at = lambda hours: dt.datetime(2024, 1, 2) + dt.timedelta(hours=hours)
    batches = [[(1, "a", at(0))], [(2, "a", at(-1)), (1, "a", at(0))], [(3, "a", at(-3))], [(4, "a", at(6)), (2, "a", at(-1))], [(5, "a", at(3)), (4, "a", at(6)), (6, "a", at(4.5))], []]
    for number, rows in enumerate(batches):
        work(spark.createDataFrame(rows, schema), number)
    assert delivered == [[1], [2], [], [4], [6], []]
    kept = [r["id"] for r in work._before(spark, "delivered", 99).collect()]
    assert sorted(kept) == [4, 6]  # ids that the watermark has passed aren't kept


def brute_matches(searches, rows, most):
    """Every search against every row."""
    out = []
    for s in searches:
        hits = []
        for r in rows:
            ok = r["at"] is not None and (s["since"] is None or r["at"] > s["since"])
            ok = ok and all(str(r[f]) in allowed for f, allowed in s["filters"].items()) and (not s["search"] or answer(r["text"], s["search"]))
            distance = None
            if s["q"] is not None:
                sim = None if r["v"] is None or not np.any(r["v"]) else round(float(np.dot(r["v"], s["q"]) / np.linalg.norm(r["v"]) / np.linalg.norm(s["q"])), 6)
                ok = ok and sim is not None and (s["floor"] is None or sim >= s["floor"])
                distance = None if sim is None else round(1 - sim, 6)
            if ok:
                hits.append((distance is None, distance or 0, -(r["at"] - START).total_seconds() if distance is None else 0, r["id"]))
        out += [(s["search_id"], h[3]) for h in sorted(hits)[:most]]
    return sorted(out)


def many(rnd, n_searches, n_rows):
    words, kinds = "a b c d e f".split(), ["x", "y", "z"]
    vector = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    rows = [{"id": k, "kind": rnd.choice([*kinds, None]), "n": k % 3, "at": START + dt.timedelta(minutes=rnd.randint(0, 50)) if k % 9 else None, "text": " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) if k % 7 else None, "v": vector() if k % 5 else None} for k in range(n_rows)]
    searches = []
    while len(searches) < n_searches:
        filters = rnd.choice([{}, {"kind": rnd.sample(kinds, 2)}, {"n": ["1"], "kind": ["x"]}, {"n": ["0"]}])
        text = rnd.choice([None, "a", "a b or c", '"a b" -c', '"d e f"', "-a b", "f or -b"])
        q = vector() if rnd.random() < 0.5 else None
        positive = text and text != "f or -b" or filters
        if positive or (q and not text):
            searches.append({"search_id": len(searches), "filters": filters, "search": text, "q": q, "floor": rnd.choice([None, 0.2]), "since": rnd.choice([None, START + dt.timedelta(minutes=20)])})
    return searches, rows


def test_percolator_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(percolator, "BLOCK_SEARCHES", 7)
    monkeypatch.setattr(percolator, "BLOCK_ROWS", 20)
    searches, rows = many(random.Random(5), 120, 90)
    saved = spark.createDataFrame([(s["search_id"], s["filters"], s["search"], s["q"], s["floor"], s["since"]) for s in searches], "search_id int, filters map<string,array<string>>, search string, q array<float>, floor double, last_checked_at timestamp_ntz")
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, kind string, n int, at timestamp_ntz, text string, v array<float>")
    floats = lambda v: None if v is None else np.array(v, np.float32).astype(float)
    want = brute_matches([s | {"q": floats(s["q"])} for s in searches], [r | {"v": floats(r["v"])} for r in rows], 3)
    for sample in (None, batch):
        known = Percolator(saved, ["kind", "n"], "at", "id", "text", "v", sample=sample)
        found = known.matches(batch, known.searches.select("search_id", "last_checked_at"), F.lit("0001-01-01").cast("timestamp_ntz"), 3)
        assert sorted((r["search_id"], r["id"]) for r in found.collect()) == want and len(want) > 100


def test_ten_thousand_searches_meet_rows_by_keys(spark):
    searches = spark.range(10_000).select(F.col("id").cast("int").alias("search_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("w"), F.col("id"), F.lit(" common"))).alias("search"), F.when(F.col("id") % 2 == 1, F.create_map(F.lit("kind"), F.array(F.concat(F.lit("k"), F.col("id"))))).alias("filters"))
    batch = spark.range(2000).select("id", F.concat(F.lit("k"), F.col("id") % 500).alias("kind"), F.lit(START).cast("timestamp_ntz").alias("at"), F.concat(F.lit("common w"), F.col("id") * 7).alias("text"))
    known = Percolator(searches, ["kind"], "at", "id", "text", sample=batch)
    assert known.keys.where("key = 't:common'").count() == 0  # the rare word is the key
    found = known.matches(batch, known.searches.select("search_id", "last_checked_at"), F.lit("0001-01-01").cast("timestamp_ntz"), 10)
    got = {(r["search_id"], r["id"]) for r in found.collect()}
    want = {(7 * k, k) for k in range(2000) if 7 * k < 10_000 and 7 * k % 2 == 0} | {(s, k) for s in range(1, 500, 2) for k in range(s, 2000, 500)}
    plan = found._jdf.queryExecution().toString()
    assert got == want and "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_join_carries_a_text(spark):
    """Of texts only the asked terms' places are kept, and matches by these need no text."""
    schema, at = "id int, kind string, at timestamp_ntz, text string", START
    batch = spark.createDataFrame([(1, "x", at, "a long b text"), (2, "x", at, "b a and so on"), (3, "y", at, "no more"), (4, "x", at, None)], schema)
    saved = spark.createDataFrame([(1, "a -c", None), (2, '"b a"', None), (3, None, {"kind": ["x"]})], "search_id int, search string, filters map<string,array<string>>")
    known = Percolator(saved, ["kind"], "at", "id", "text", sample=batch)
    read = known.with_terms(batch).drop("text")
    assert {r["id"]: r["__at"] for r in read.collect()} == {1: {"a": [0], "b": [2]}, 2: {"b": [0], "a": [1]}, 3: {}, 4: {}}
    marks, first = known.searches.select("search_id", "last_checked_at"), F.lit("0001-01-01").cast("timestamp_ntz")
    for rows in (read, batch):
        found = known.matches(rows, marks, first, 10)
        assert found.columns == ["search_id", *[c for c in rows.columns if c != "__at"], "distance"]
        assert sorted((r["search_id"], r["id"]) for r in found.collect()) == [(1, 1), (1, 2), (2, 2), (3, 1), (3, 2), (3, 4)]


def test_a_search_for_nothing_raises(spark):
    for search in ("", "-a", None):
        with pytest.raises(ValueError, match="asks for"):
            Percolator(spark.createDataFrame([(1, search)], "search_id int, search string"), [], "at", "id", "text")


def test_a_part_is_one_batch_of_several_files(spark, tmp_path, monkeypatch):
    """Parts are written by several tasks, and a batch takes all files of one part and no others."""
    monkeypatch.setattr(stream_plans, "FILE_ROWS", 100)
    sizes = {0: 450, 1: 2, 2: 0, 3: 120}
    rows = spark.createDataFrame([(n, p) for p, size in sizes.items() for n in range(size)], "n int, p int")
    stream, seen = stream_plans._in_files(spark, rows, F.col("p"), 4, "parts"), {}

    def take(batch, number):
        seen[number] = ({r["p"]: r["count"] for r in batch.groupBy("p").count().collect()}, batch.select(F.input_file_name()).distinct().count())

    stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert [seen[k][0] for k in range(4)] == [{0: 450}, {1: 2}, {}, {3: 120}] and seen[0][1] == seen[3][1] == 5


def test_windows_and_sessions(spark, tmp_path):
    schema = "k int, at timestamp"
    rows = [(1, START + dt.timedelta(minutes=m)) for m in (0, 1, 30, 31, 400)]
    counts = feeds.windowed_counts(files(spark, str(tmp_path / "in"), [rows], schema), "at", ["k"], "10 minutes", "1 minute")
    got = feeds.drain(counts, str(tmp_path / "out"), str(tmp_path / "c1")).collect()
    assert sorted(r["n"] for r in got)[-2:] == [2, 2]
    spans = feeds.sessions(feeds.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "at", ["k"], "5 minutes", "1 minute")
    assert sorted(r["n"] for r in feeds.drain(spans, str(tmp_path / "out2"), str(tmp_path / "c2")).collect())[:2] == [2, 2]
