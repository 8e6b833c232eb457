"""Operator 12 against a plain reading of its contract."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import queries, resample

LETTERS = ["a", "B", "word", "Ünï", "日本", "x" * 70, "y" * 200, "0", "9z", " ", "  ", "\n", ".", "{", "`", "@", "[", "\x7f", "/", ":", "é́"]


def runs(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def brute(docs, target, least_words=20, percent=5):
    raw, aimed = (Counter(bucket(f) for t in texts for f in runs(t)[1]) for texts in ([t for _, t in docs], target))
    total, wanted = sum(raw.values()), sum(aimed.values())
    gain = {b: math.floor(1000 * math.log((aimed[b] + 1) * (total + 10_000) / ((raw[b] + 1) * (wanted + 10_000)))) for b in range(10_000)}
    out = []
    for doc_id, text in docs:
        words, found = runs(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.lists(st.sampled_from(LETTERS), max_size=15).map("".join)), max_size=5))
def test_buckets_of_any_texts(texts):
    texts = [t and t.encode("utf-8", "replace").decode() for t in texts]
    row, found, n_words = resample.features(pa.array(texts, pa.string()), 1 << 20)
    want = Counter((k, bucket(f, 1 << 20)) for k, t in enumerate(texts) for f in runs(t)[1])
    assert Counter(zip(row.tolist(), found.tolist(), strict=True)) == want
    assert n_words.tolist() == [len(runs(t)[0]) for t in texts]


def test_shifts_of_any_length():
    rnd = random.Random(2)
    for n in [0, 1, 2, 63, 64, 65, 127, 128, 5000, 70_001]:
        head, tail = rnd.randbytes(20), rnd.randbytes(n)
        got = resample.shifted(np.array([zlib.crc32(head)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(tail))
        assert got[0] == zlib.crc32(head + tail)


def test_ranks_of_odd_texts(odd_docs, no_docs, spark):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    target = [docs[6][1], docs[9][1], None]
    aimed = spark.createDataFrame([(t,) for t in target], "passage string")
    found = resample.resample(odd_docs, aimed, target_col="passage", percent=60)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "n_features", "weight", "score", "rank"]
    assert order(found.select("doc_id", "n_features", "weight", "score", "rank").collect()) == order(brute(docs, target, percent=60))
    assert resample.resample(no_docs, aimed, target_col="passage").collect() == []
    bare = resample.resample(odd_docs, aimed.limit(0), target_col="passage").select("doc_id", "n_features", "weight", "score", "rank")
    assert order(bare.collect()) == order(brute(docs, []))


def test_ranks_in_many_ranges(spark, monkeypatch):
    rnd = random.Random(8)
    docs = [(k if k % 7 else None, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(15, 30)))) for k in range(600)]
    docs += [(5000, "one text of a third of all rows " * 4)] * 300
    target = [" ".join("abab" * 5)]
    frame, aimed = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame([(target[0],)], "text string")
    gain = resample.gains(resample.bucket_counts(frame), resample.bucket_counts(aimed))
    scored = resample.score(frame, gain)
    for percent, room in ((5, 0.002), (40, -0.2), (100, 0.002)):
        monkeypatch.setattr(resample, "ROOM", room)  # below nought the cut is too high, and all rows are ranked
        found = resample.draw(scored, percent=percent, range_rows=50).collect()
        ranks = sorted(r["rank"] for r in found if r["rank"])
        want = brute(docs, target, percent=percent)
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(w[4] is not None for w in want)
        key = lambda r: (r[4], r[3])
        assert sorted(key((r["doc_id"], 0, 0, r["score"], r["rank"])) for r in found if r["rank"]) == sorted(key(w) for w in want if w[4])
        assert {(r["doc_id"], r["rank"]) for r in found if r["rank"] and r["doc_id"] not in (None, 5000)} == {(w[0], w[4]) for w in want if w[4] and w[0] not in (None, 5000)}


def test_names_that_clash(odd_docs, spark):
    aimed = spark.createDataFrame([("word word",)], "text string")
    clashing = odd_docs.withColumnRenamed("source", "RANK").withColumnRenamed("lang", "_noise").withColumnRenamed("n_chars", "Weight")
    found = resample.resample(clashing, aimed)
    assert found.columns == ["doc_id", "_noise", "n_words", "n_features", "weight", "score", "rank"] and found.count() == odd_docs.count()


def test_query_on_whole_table(spark, data):
    docs, target = (spark.read.parquet(f"{data}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    found = queries.QUERIES["op12_importance_resampling"](spark, data)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(found.collect()) == order(brute([(r["doc_id"], r["text"]) for r in docs], [r["text"] for r in target]))
