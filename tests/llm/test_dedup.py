"""Operators 1, 2 and 8 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from siltstone.llm import naming, near_join, queries, substrings
from siltstone.llm.components import connected_components
from siltstone.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small_corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = [f"v{k}" for k in range(40)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(0, 90))] for _ in range(n // 3)]
    out = []
    for k in range(n):
        words = list(rnd.choice(base)) + (list(rnd.choice(base)) if rnd.random() < 0.3 else [])
        for _ in range(rnd.randint(0, 2)):
            if words:
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
        out.append((k if rnd.random() < 0.95 else None, rnd.choice([" ", "  ", "\n"]).join(words) if rnd.random() < 0.97 else None))
    return out


def brute_substrings(docs, width=13):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[p : p + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    docs = small_corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    out = substrings.remove_repeats(frame).select("doc_id", "n_words", "n_removed", "text")
    assert order(map(tuple, out.collect())) == order(brute_substrings(docs))


def test_hot_minimisers_are_split(spark, monkeypatch):
    draw = random.Random(9)
    fresh = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    # Five common words between differing ones, a passage of them only, and passages around them that repeat.
    common, shared = [f"common{k}" for k in range(5)], fresh(8)
    docs = [(k, " ".join(fresh(6) + common + fresh(6) + common * (4 * (k % 9 == 0)) + (shared + common + shared) * (k % 7 == 0))) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = frame.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    hot, windows = substrings.hot_runs(rows, often=100, sample=1)
    assert not len(windows) and 3 <= len(hot) < 30
    with monkeypatch.context() as less:
        less.setattr(substrings, "MOST_HOT", 5)  # fewer than fit: only those that no more than five can match
        assert max(map(len, substrings.hot_runs(rows, often=1, sample=1))) <= 5
    spans = [substrings.repeated_spans(frame, often=often, sample=1).distinct() for often in (100, 1 << 40)]
    words = lambda found: {(r["doc_id"], k) for r in found.collect() for k in range(r["first"], r["first"] + r["span"])}
    texts = dict(docs)
    gone = Counter(d for d, _ in words(spans[0]))
    assert words(spans[0]) == words(spans[1])
    assert {(d, gone[d]) for d in texts} == {(d, removed) for d, _, removed, _ in brute_substrings(docs)}

    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts)), pa.array(list(texts.values()))], names=["doc_id", "row_key", "text"])

    def largest(hot):
        sent = Counter()
        for part in substrings._pack(batch, 13, 1 << 20, hot, substrings.Met()):
            for bucket, text in zip(part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True):
                sent[bucket] += 0 if text is None else zstandard.decompress(text).count(b"\n") + 1
        return max(sent.values())

    # Runs that stay minimisers occur less than 100 times; without hot runs one bucket gets hundreds.
    assert largest(hot) < 100 < largest(np.zeros(0, np.uint64)) / 2


@pytest.mark.parametrize("most", [1 << 16, 40, 0])
def test_passages_are_sent_once_by_a_task(spark, most, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", 2000)
    monkeypatch.setattr(substrings, "MOST_MET", most)
    draw = random.Random(10)
    shared = [f"p{k}" for k in range(30)]
    docs = [(k, " ".join([f"u{draw.randrange(10**9)}" for _ in range(10)] + (shared if k % 3 else shared[: k % 25]))) for k in range(200)]
    draw.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    out = substrings.remove_repeats(frame).select("doc_id", "n_words", "n_removed", "text")
    assert order(map(tuple, out.collect())) == order(brute_substrings(docs))
    met, sent, inner = substrings.Met(), [], " ".join(shared[8:21]).encode()
    for at in range(0, 200, 10):
        ids, texts = zip(*docs[at : at + 10], strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts)], names=["doc_id", "row_key", "text"])
        texts = [t for part in substrings._pack(batch, 13, 1, np.zeros(0, np.uint64), met) for t in part.column(3).to_pylist() if t is not None]
        sent.append(any(inner in zstandard.decompress(t) for t in texts))
    # Again only when a slice has a smaller document with it than all before; else by every slice.
    assert sent[0] and (sum(sent) < 8 if most else sum(sent) == 20)


@pytest.mark.parametrize("salts", [1024, 3, 1])
def test_hot_windows_meet_in_two_steps(spark, salts, monkeypatch):
    """One passage once in every slice, ids falling: a bucket of the second step has one of each salt at most."""
    monkeypatch.setattr(substrings, "SLICE_BYTES", 400)
    monkeypatch.setattr(substrings, "SALTS", salts)
    draw = random.Random(12)
    shared = [f"p{k}" for k in range(16)]
    docs = [(999 - k, " ".join([f"u{draw.randrange(10**9)}" for _ in range(12)] + shared + [f"u{draw.randrange(10**9)}" for _ in range(3)])) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartitionByRange(20, F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc())
    spans = substrings.repeated_spans(frame, often=200, sample=1).distinct()
    words = {(r["doc_id"], k) for r in spans.collect() for k in range(r["first"], r["first"] + r["span"])}
    gone = Counter(d for d, _ in words)
    assert {(d, gone[d]) for d, _ in docs} == {(d, removed) for d, _, removed, _ in brute_substrings(docs)}
    assert sum(n > 0 for n in gone.values()) == 299


def test_later_steps_hold_one_of_each_salt():
    draw = random.Random(13)
    shared = [f"p{k}" for k in range(13)]
    hashes = substrings.arrays.word_hashes([x.encode() for x in shared])
    hot, windows = (np.sort(substrings.arrays.window_hashes(hashes, n)) for n in (3, 13))
    sent = {}
    for task in range(40):  # each with ten slices, ids falling
        met = substrings.Met()
        for k in range(10):
            doc = 10_000 - 10 * task - k
            text = " ".join([f"u{draw.randrange(10**9)}" for _ in range(3)] + shared)
            batch = pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([doc]), pa.array([text])], names=["doc_id", "row_key", "text"])
            for part in substrings._pack(batch, 13, 64, hot, met, windows, salt=task % 4):
                for bucket, *rest in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    if bucket >= 64:
                        sent.setdefault(bucket, []).append(tuple(rest))
    assert len(sent) <= 4 and sum(map(len, sent.values())) == 400
    left = [x for parcels in sent.values() for x in substrings._search(parcels, 13, again=64)[1]]
    assert len(left) <= 4 and len({b for b, *_ in left}) == 1
    spans, _ = substrings._search([tuple(x[1:]) for x in left], 13)
    settled = {d for p in sent.values() for d in substrings._search(p, 13, again=64)[0].column(0).to_pylist()} | set(spans.column(0).to_pylist())
    assert settled == set(range(10_000 - 399, 10_001)) - {10_000 - 399}


def test_substrings_of_odd_rows(odd_docs, no_docs):
    out = substrings.remove_repeats(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_words", "n_removed"]
    want = brute_substrings([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert order(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "text").collect()) == order(want)
    assert substrings.remove_repeats(no_docs).count() == 0
    again = substrings.remove_repeats(out.selectExpr("*", "1 AS first", "2 AS `__first`", "3 AS ID"))
    assert again.columns == [*odd_docs.columns, "first", "__first", "ID", "n_words", "n_removed"] and again.count() == odd_docs.count()
    as_they_are = substrings.remove_repeats(odd_docs, rejoin=False).where("n_removed = 0").select("doc_id", "text")
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert {tuple(r) for r in as_they_are.collect()} <= texts


def test_windows_of_one_hash_are_told_apart():
    import numpy as np

    numbers = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2])
    same = np.zeros(4, np.uint64)  # all words hash alike
    starts = np.array([0, 3, 6])
    assert substrings.starts_earlier(numbers, same, starts, np.array([1, 2, 3]), 3).tolist() == [False, False, True]


def test_keys_that_differ_in_low_bits_only_are_no_neighbours():
    keys = np.array([8, 9, 8, 1 << 60, 9, 8, 1 << 60, 7], np.uint64)  # places take the low four bits
    for some in (keys, keys >> np.uint64(1), keys[:1], keys[3:4], keys[[3, 6]], np.arange(5, dtype=np.uint64) << np.uint64(40)):
        order, tied = substrings._by_key(some)
        assert sorted(order.tolist()) == list(range(len(some)))
        same = [k for k in range(len(some) - 1) if some[order[k]] == some[order[k + 1]]]
        assert tied.tolist() == same and len(some) - len(same) == len(set(some.tolist()))


def test_lines_of_words_are_split_as_rows():
    lines = ["a bb ccc", "d", "é \x00\x01 日本 x\x1f", "e e e e"]
    rows, w = substrings.arrays.words(*substrings.arrays.utf8(pa.array(lines))), substrings.arrays.single_spaced(np.frombuffer("\n".join(lines).encode(), np.uint8))
    assert w.rows.tolist() == rows.rows.tolist() and w.row.tolist() == rows.row.tolist()
    assert [w.data[i:j].tobytes() for i, j in zip(w.bounds, w.bounds[1:])] == [rows.data[i:j].tobytes() + b" " for i, j in zip(rows.bounds, rows.bounds[1:])]  # noqa: B905


def test_a_bucket_hashes_no_word(monkeypatch):
    """Words are hashed once, as they are sent; what a bucket sorts by are their numbers."""
    draw, shared = random.Random(14), [f"p{k}" for k in range(20)]
    texts = [" ".join([f"u{draw.randrange(10**9)}" for _ in range(30)] + shared + [f"u{draw.randrange(10**9)}" for _ in range(30)]) for _ in range(40)]
    sent = []
    for k in range(0, 40, 10):  # four tasks, so that the passage meets in the bucket
        batch = pa.RecordBatch.from_arrays([pa.array(range(k, k + 10))] * 2 + [pa.array(texts[k : k + 10])], names=["doc_id", "row_key", "text"])
        for part in substrings._pack(batch, 13, 1, np.zeros(0, np.uint64), substrings.Met()):
            sent += [tuple(x) for _, *x in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True) if x[2] is not None]
    hashed, digest = [], substrings.arrays.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(substrings.arrays.xxhash, "xxh3_64_intdigest", lambda x: hashed.append(x) or digest(x))
    spans, left = substrings._search(sent, 13)
    assert set(spans.column(0).to_pylist()) == {10, 20, 30} and left == [] and hashed == []


def brute_exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for body, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        for i, t in rows:
            kept = i == keep[0] and len(t) == len(keep[1])
            out.append((i, keep[0], len(rows), kept, hashlib.sha256(body.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_exact(spark, odd_docs, no_docs, block, monkeypatch):
    if block == 3:  # blocks and pairs that differ and share a hash
        monkeypatch.setattr(naming, "hashed", lambda *v: F.pmod(F.xxhash64(*v), F.lit(5)))
    docs = [(r["doc_id"], r["text"] if block > 1 else (r["text"] or "")[:50]) for r in odd_docs.collect()]
    docs += [(100 + k, "x y" if k % 2 else "xy") for k in range(9)]
    out = naming.exact_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), block_chars=block)
    assert order(map(tuple, out.collect())) == order(brute_exact(docs))
    assert naming.exact_groups(no_docs, block_chars=block).count() == 0


def test_drop_copies(odd_docs, no_docs):
    out = naming.drop_copies(odd_docs).collect()
    # the first of each pair that differs in white space, one of the repeated rows, one empty row
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 1, 5, 6, 7, 8, 9, 10, 11, 12, 12, 13]
    assert naming.drop_copies(no_docs).count() == 0


def brute_near(docs, limit=0.8, n=5):
    sets = []
    for _, t in docs:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(docs)
    for a in range(len(docs)):
        for b in range(a):
            same = (docs[a][1] or "") == (docs[b][1] or "")
            union = len(sets[a] | sets[b])
            if same or (union and len(sets[a] & sets[b]) >= limit * union - 1e-12):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    big = float("inf")
    least = {}
    for a, (i, _) in enumerate(docs):
        least[find(a)] = min(least.get(find(a), big), big if i is None else i)
    return [(i, None if least[find(a)] == big else least[find(a)], links[a]) for a, (i, _) in enumerate(docs)]


@pytest.mark.parametrize("block_bytes", [600, 2 << 20])
def test_near(spark, block_bytes):
    docs = small_corpus(5, 150)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    out = near_join.near_duplicates(frame, block_bytes=block_bytes).select("doc_id", "class_id", "n_links")
    assert order(map(tuple, out.collect())) == order(brute_near(docs))


def test_near_of_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = near_join.near_duplicates(odd_docs)
    assert order(map(tuple, out.select("doc_id", "class_id", "n_links").collect())) == order(brute_near(docs))
    assert near_join.near_duplicates(no_docs).count() == 0
    clashing = odd_docs.selectExpr("*", "1 AS id", "2 AS `KEY`", "3 AS node", "4 AS kept")
    assert near_join.drop_near_duplicates(clashing).columns == clashing.columns
    assert naming.drop_copies(clashing).columns == clashing.columns
    kept = near_join.drop_near_duplicates(naming.drop_copies(odd_docs))
    assert kept.columns == odd_docs.columns
    found = {r["doc_id"] for r in kept.collect()}
    assert {5, 7, 11} <= found and not {6, 8} & found


def test_prefixes_shorten_until_recall():
    depth, trees = near_join.DEPTH, near_join.TREES
    found = lambda similarity, n, shared: np.array([n * (np.arange(depth + 1) == shared), [n * near_join.meeting(similarity, d, trees) for d in range(depth + 1)]])
    assert near_join.shortened(found(0.9, 0, 8), 0.8, trees, 0.9999) == (5, 1.0)  # no links: the limit decides
    assert near_join.shortened(found(0.98, 5000, 8), 0.8, trees, 0.9999)[0] == 8  # whole strings meet
    assert near_join.shortened(found(0.98, 5000, 6), 0.8, trees, 0.9999)[0] == 6  # as far as was measured
    assert near_join.shortened(found(0.8, 5000, 8), 0.8, trees, 0.9999)[0] == 5  # as far as is expected
    with pytest.raises(ValueError):
        near_join.shortened(found(0.3, 0, 8), 0.3, trees, 0.9999)


def test_shared_prefixes_of_neighbours():
    rnd = random.Random(4)
    rows = sorted((rnd.randrange(3), tuple(rnd.choice([0, 1]) for _ in range(near_join.DEPTH))) for _ in range(300))
    tree, values = np.array([t for t, _ in rows]), np.array([v for _, v in rows])
    shared = near_join.shared_prefixes(tree, values)
    front = lambda a, b: next((k for k in range(near_join.DEPTH) if a[k] != b[k]), near_join.DEPTH)
    assert shared.tolist() == [front(a, b) if s == t else 0 for (s, a), (t, b) in zip(rows, rows[1:], strict=False)]
    # The longest prefix that any other string of the tree shares is shared by a neighbour.
    reach = np.maximum(np.append(0, shared), np.append(shared, 0))
    assert reach.tolist() == [max((front(a, b) for k, (t, b) in enumerate(rows) if t == s and k != n), default=0) for n, (s, a) in enumerate(rows)]


@pytest.mark.parametrize("parts", [1, 7])
def test_texts_without_company_leave_the_forest(spark, parts):
    rnd = random.Random(5)
    draw = lambda: bytes(rnd.choice([0, 0, 0, 1]) for _ in range(near_join.TREES * near_join.DEPTH * 2))
    rows = [(k, draw(), True) for k in range(60)]
    texts = spark.createDataFrame(rows, "node bigint, strings binary, have boolean").repartition(parts)
    for depth in (8, 4):
        prefixes = Counter((t, s[16 * t : 16 * t + 2 * depth]) for _, s, _ in rows for t in range(near_join.TREES))
        want = sum(n for n in prefixes.values() if n > 1)
        found = near_join._matched(texts, near_join.TREES, depth)
        together = found.groupBy("key").count().where("count > 1").agg({"count": "sum"}).first()[0] or 0
        edges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert together == want and want <= found.count() <= want + edges


def test_prefixes_are_shortened_until_the_measured_recall(spark, monkeypatch):
    """With too few trees for its first level the join goes on to shorter prefixes, and says what it reached."""
    docs = small_corpus(5, 150)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(near_join, "shortened", lambda found, similarity, trees, recall: (8, 1.0))
    levels, matched = [], near_join._matched
    monkeypatch.setattr(near_join, "_matched", lambda texts, trees, depth: levels.append(depth) or matched(texts, trees, depth))
    out = near_join.near_duplicates(frame, recall=0.99999)
    assert out.first()["recall"] >= 0.99999 and levels == list(range(8, levels[-1] - 1, -1)) and len(levels) > 1
    assert order(map(tuple, out.select("doc_id", "class_id", "n_links").collect())) == order(brute_near(docs))


def test_links_to_a_sample_are_exact():
    rnd = random.Random(3)
    texts = [t or "" for _, t in small_corpus(7, 90)]
    sample = rnd.sample(sorted(set(texts)), 20)
    drawn = near_join._sample(sample, 5, 24, 8)
    w = near_join.arrays.words(*near_join.arrays.utf8(pa.array(texts)))
    number, distinct = near_join.arrays.numbered(w.data, w.bounds)
    grams, row = near_join._shingles(w, near_join.arrays.word_hashes(distinct)[number], 5)
    values, _ = near_join._signature(grams, row, len(texts), 24, 8)
    found = near_join._links_to(drawn, grams, row, values, 0.8, 24)
    sets = lambda t: {tuple(x) for x in zip(*[WORD.findall(t)[k:] for k in range(5)], strict=False)} or {tuple(WORD.findall(t))}
    near = lambda a, b: a.split() != b.split() and sets(a) != sets(b) and len(sets(a) & sets(b)) >= 0.8 * len(sets(a) | sets(b)) - 1e-12
    want = [sum(near(t, s) for s in sample) if WORD.findall(t) else 0 for t in texts]
    assert found[:, 0].sum(1).tolist() == want and sum(want) > 5
    assert found[:, 1, 0].tolist() == want


def test_large_groups_beside_a_pivot(spark):
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    docs = []
    for k in range(160):  # from copies of the base to texts of which half is changed
        words = list(base)
        for at in rnd.sample(range(60), rnd.choice([0, 0, 1, 1, 1, 2, 3, 12])):
            words[at] = f"x{rnd.randrange(4)}"
        docs.append((k, " ".join(words) + f" tail{k % 3}"))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for block_bytes in (1500, 1 << 20):
        out = near_join.near_duplicates(frame, block_bytes=block_bytes).select("doc_id", "class_id", "n_links")
        assert order(map(tuple, out.collect())) == order(brute_near(docs))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    out = connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), Scratch(spark, "t"), "c")
    got = {r["node"]: r["component"] for r in out.collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t"), "c").count() == 0


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_exact_dedup"])
def test_query_equals_sql(name, spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    out = queries.QUERIES[name](spark, data)
    want = con.sql(queries.ORACLE_SQL[name])
    assert order(map(tuple, out.select(want.columns).collect())) == order(want.fetchall())


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_near_query_equals_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.QUERIES["op8_ngram_jaccard_join"](spark, data).select("doc_id", "class_id", "n_links")
    assert order(map(tuple, out.collect())) == order(brute_near(docs))
