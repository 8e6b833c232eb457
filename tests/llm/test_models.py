"""Operators 3, 4, 6, 7 and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import fingerprints, language, quality, queries, sharding
from siltstone.llm.scratch import Scratch
from tests.llm.test_dedup import brute_near, brute_substrings
from tests.llm.test_tokens import check_packing

LARGER = "/root/testdata/sf0.01"


def check_places(rows, docs):
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_shards(spark, odd_docs, no_docs, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    repeated = spark.createDataFrame([(1, "same text")] * 300 + [(None, None)] * 50, "doc_id bigint, text string")
    monkeypatch.setattr(sharding, "RUN_ROWS", 40)
    for frame, shards in ((docs, 40), (odd_docs, 4), (repeated, 3)):
        check_places(sharding.shard_rows(frame, shards).collect(), pairs(frame))
    assert sharding.shard_rows(no_docs, 4).count() == 0
    clashing = odd_docs.selectExpr("*", "1 AS shard", "2 AS size", "3 AS place")
    assert sharding.shard_rows(clashing, 4).count() == odd_docs.count()


def loads_of(rows):
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    return loads


def test_repeated_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 50)
    rows = [(7, "one text")] * 400 + [(None, None)] * 300 + [(k, f"text {k}") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = sharding.shard_rows(frame, 40).collect()
    check_places(found, rows)
    loads = Counter()
    for r in found:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 60  # a row or two


def brute_rebalanced(slot_map, uneven):
    """Every move and swap between the fullest and the emptiest shard is tried; the best is made."""
    out = dict(slot_map)
    while True:
        loads = Counter()
        for shard, size in out.values():
            loads[shard] += size
        full, empty = max(loads, key=lambda s: (loads[s], s)), min(loads, key=lambda s: (loads[s], s))
        gap = loads[full] - loads[empty]
        if gap <= uneven * sum(loads.values()) / len(loads):
            return loads
        tried = []
        for a, (shard, size) in out.items():
            for b, (other, less) in [*out.items(), (None, (empty, 0))]:
                if shard == full and other == empty and 0 < size - less < gap:
                    tried.append((abs(gap - 2 * (size - less)), a, b))
        best = min(tried, default=None, key=lambda t: t[0])
        if best is None or best[0] >= gap:
            return loads
        for slot, target in ((best[1], empty), (best[2], full)):
            if slot is not None:
                out[slot] = (target, out[slot][1])


def test_maps_are_as_even_as_by_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        shards = rnd.randint(2, 5)
        slot_map = {k: (k % shards, rnd.choice([0, 1, rnd.randint(1, 50), rnd.randint(1, 400)])) for k in range(rnd.randint(shards, 24))}
        loads = Counter()
        for shard, size in sharding.rebalanced_map(slot_map, 0.0).values():
            loads[shard] += size
        best = brute_rebalanced(slot_map, 0.0)
        assert max(loads.values()) - min(loads.values()) <= max(best.values()) - min(best.values()) + max(size for _, size in slot_map.values())
        assert sum(loads.values()) == sum(best.values())


def test_the_query_keeps_its_law(spark):
    """Forty shards over the whole table: every row placed, shards by the map's slots, bytes nearly equal."""
    rows = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()
    found = queries.QUERIES["op3_virtual_slots"](spark, LARGER).collect()
    check_places(found, [(r["doc_id"], r["text"]) for r in rows])
    shard_of, loads = {}, Counter()
    for r in found:
        assert shard_of.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
    assert len(loads) == 40 and max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 40


def test_shards_are_even(spark):
    rows = sharding.shard_rows(spark.read.parquet(f"{LARGER}/documents.parquet"), 10).collect()
    loads = loads_of(rows).values()
    assert len(loads) == 10 and max(loads) - min(loads) < 0.005 * sum(loads) / 10
    # The second version moves few of the slots that the first one dealt out.
    first = {r["virtual_slot"]: r["first_shard"] for r in rows}
    after = {r["virtual_slot"]: r["shard"] for r in rows}
    assert all(shard == slot % 10 for slot, shard in first.items()) and {r["map_version"] for r in rows} == {2}
    assert 0 < sum(after[s] != first[s] for s in first) < 0.3 * len(first)


def test_a_stored_map_is_edited(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    path = Scratch(spark, "t").path("map")
    shard_of = lambda rows: {r["virtual_slot"]: r["shard"] for r in rows}
    one = sharding.shard_rows(docs, 8, map_path=path).collect()
    again = sharding.shard_rows(docs, 8, map_path=path).collect()
    assert shard_of(again) == shard_of(one) and {r["map_version"] for r in again} == {2}
    # One shard's rows go: the map is rebalanced, and slots move only where they must.
    rest = docs.join(spark.createDataFrame([(r["doc_id"],) for r in one if r["shard"] < 2 and r["doc_id"] % 2], "doc_id bigint"), "doc_id", "left_anti")
    less = sharding.shard_rows(rest, 8, map_path=path).collect()
    loads = loads_of(less).values()
    assert {r["map_version"] for r in less} == {3} and max(loads) < 1.02 * min(loads)
    assert sum(shard_of(less)[s] != shard_of(one)[s] for s in shard_of(less)) < 0.35 * len(shard_of(less))
    check_places(less, pairs(rest))
    grown = sharding.shard_rows(rest, 9, map_path=path).collect()
    assert {r["map_version"] for r in grown} == {4} and len(loads_of(grown)) == 9
    versions = sharding.stored_versions(spark, path)
    assert sorted(versions) == [1, 2, 3, 4]
    assert sharding.grow(spark, path, 10) == 5
    latest = sharding.stored_versions(spark, path)
    assert all(latest[5][s][0] in (latest[4][s][0], 9) for s in latest[4])
    with pytest.raises(ValueError):
        sharding.shard_rows(rest, 8, map_path=path)


def test_growing_moves_slots_to_new_shards_only():
    sizes = {s: (s * 7919) % 1000 + 1 for s in range(512)}
    first = sharding.rebalanced_map(sharding.with_sizes(sharding.dealt_map(8, 512), sizes))
    loads = Counter()
    for shard, size in first.values():
        loads[shard] += size
    assert max(loads.values()) - min(loads.values()) <= 0.001 * sum(sizes.values()) / 8
    grown = sharding.grown_map(first, 9)
    assert all(grown[s] in (first[s], (8, sizes[s])) for s in sizes)
    assert sum(size for shard, size in grown.values() if shard == 8) > 0.95 * sum(sizes.values()) / 9
    assert sharding.grown_map(sharding.dealt_map(2, 8), 3) == sharding.dealt_map(2, 8)  # no bytes to move


def test_edited_texts(spark, odd_docs, no_docs, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (None, "no id")], "doc_id bigint, text string")).repartition(3)
    scratch = Scratch(spark, "t")
    lexicon = fingerprints.learn_lexicon(docs, scratch, least=0.01)
    ordered = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    want = []
    for r, n in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, cut = r["text"] or "", len(r["text"] or "") // 3
        want.append((r["doc_id"], len(t), hashlib.sha256((t[: len(t) - cut] + (n["text"] or "")[:cut]).encode()).hexdigest()))
    rows = fingerprints.edited_likeness(docs, lexicon, scratch).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r["text"] or ""].add(by_id[r["doc_id"]]["fingerprint"])
    assert all(len(f) == 1 for f in texts.values())
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.8 * len(rows)
    assert fingerprints.edited_likeness(odd_docs, lexicon, scratch).count() == odd_docs.count()
    assert fingerprints.edited_likeness(no_docs, fingerprints.learn_lexicon(no_docs, scratch), scratch).count() == 0
    assert fingerprints.fingerprints(odd_docs, lexicon).columns == [*odd_docs.columns, "fingerprint"]
    twice = fingerprints.fingerprints(odd_docs.withColumnRenamed("lang", "Fingerprint"), lexicon)
    assert twice.columns == ["doc_id", "text", "source", "n_chars", "fingerprint"] and twice.count() == odd_docs.count()


def test_one_id_fills_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_BYTES", 200)
    docs = [(None if k % 3 else 5, f"text number {k % 7}") for k in range(90)] + [(9, "the last text")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    scratch = Scratch(spark, "t")
    rows = fingerprints.edited_likeness(frame, fingerprints.learn_lexicon(frame, scratch), scratch).collect()
    assert sorted(((r["doc_id"], r["n_chars"]) for r in rows), key=repr) == sorted(((i, len(t)) for i, t in docs), key=repr)
    # The order of equal ids is open, but each text is followed once: as many edits take from each text.
    one = spark.createDataFrame([(1, "alone here")], "doc_id bigint, text string")
    alone = fingerprints.edited_likeness(one, fingerprints.Lexicon([]), scratch).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in alone] == [(hashlib.sha256(b"alone halo").hexdigest(), 1.0)]


MASK = (1 << 64) - 1


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def brute_codes(lexicon, text):
    """I-Match by its definition, with sets and whole numbers."""
    name = lambda t: xxhash.xxh3_64_intdigest(t)
    terms = {t for t in re.split(rb"[\x20\x09-\x0D]+", text.encode()) if t}
    drawn = lambda h, k: mixed(h ^ mixed(k)) < 1 << 62 - k // fingerprints.SUBSETS
    code = lambda hashes: max(mixed(sum(mixed((mixed(h) + mixed(n)) & MASK) for n, h in enumerate(hashes)) & MASK) >> 32, 1) if hashes else 0
    subsets = range(fingerprints.SCALES * fingerprints.SUBSETS)
    kept = [name(t) for t in sorted(terms & lexicon)]
    out = [code([h for h in kept if drawn(h, k)]) for k in subsets]
    if not any(out):
        every = sorted(map(name, terms))
        out = [code([h for h in every if drawn(h, k)]) for k in subsets]
        out[0] = out[0] if any(out) else code(every)
    return out


def brute_likeness(a, b):
    total = same = 0.0
    weight = 1.0
    for x, y in zip(reversed(a), reversed(b), strict=True):  # the sparsest first
        if x or y:
            total, same, weight = total + weight, same + weight * (x == y), weight * fingerprints.DECAY
    return same / total if total else float(a == b)


def test_codes_and_likenesses_equal_brute_force(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").where("doc_id < 150").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    texts |= {10_000: "", 10_001: "only rare", 10_002: " \n"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    scratch = Scratch(spark, "t")
    lexicon = fingerprints.learn_lexicon(frame, scratch, least=0.02)
    counts = Counter(t for x in texts.values() for t in {t for t in re.split(rb"[\x20\x09-\x0D]+", x.encode()) if t})
    band = {t for t, n in counts.items() if 0.02 * len(texts) <= n <= 0.2 * len(texts)}
    assert set(lexicon.rank) == band
    order = sorted(texts, reverse=True)
    for r in fingerprints.edited_likeness(frame, lexicon, scratch).collect():
        text, after = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, changed, following = (brute_codes(band, t) for t in (text, edited, after))
        shown = lambda codes: ":".join(f"{c:08x}" if c else "-" for c in codes)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own), shown(changed))
        assert abs(r["near_edited"] - brute_likeness(own, changed)) < 1e-9
        assert abs(r["near_next"] - brute_likeness(own, following)) < 1e-9


def test_lexicon_counts_documents(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "b"), (4, None)], "doc_id bigint, text string")
    lexicon = fingerprints.learn_lexicon(docs, Scratch(spark, "t"), least=0.5, most=0.5)
    assert list(lexicon.rank) == [b"a", b"b"]


def test_texts_without_band_terms_differ(spark):
    lexicon = fingerprints.Lexicon([b"common"])
    texts = ["alpha", "beta", "alpha", "今日は良い天気です", "明日は雨が降ります", "rare words only here", "other rare terms there", "", None]
    texts += [f"single{k}" for k in range(2000)]
    codes = fingerprints.fingerprint(lexicon, pa.array(texts))
    assert codes[[0, 1, *range(3, 7), *range(9, len(texts))]].any(1).all() and not codes[7:9].any()
    pairs = [(0, 1), (3, 4), (0, 7)]
    assert [float(fingerprints.likeness(codes[[a]], codes[[b]])[0]) for a, b in pairs] == [0.0] * 3
    assert 0 <= fingerprints.likeness(codes[[5]], codes[[6]])[0] < 0.2  # they share the term "rare"
    assert fingerprints.likeness(codes[[0]], codes[[2]]).tolist() == [1.0]
    assert len(set(fingerprints.as_text(codes[9:]))) == 2000


def brute_phrases(sample, text):
    """Phrases of the greedy parse of a whole text, by plain search."""
    sample, n, k = " " + language._folded(sample) + " ", 0, 0
    while k < len(text):
        size = 0
        while k + size < len(text) and text[k : k + size + 1] in sample:
            size += 1
        n += 1
        k += max(size, 1)
    return n


@pytest.mark.parametrize("block", [1, 2, 7, 512])
def test_cross_parsing_counts_phrases(block):
    rnd = random.Random(2)
    samples = {"x": "abra kadabra abrakadabra", "y": "mississippi missouri misty", "z": "a" * 40, "w": ""}
    parser = language.build_parser(samples)
    texts = ["abra misty", "kadabrakadabra miss", "zzz abra", "ab" * 700, "", "a" * 900, "aab" * 300, "q", " ", "ää misty zq"]
    texts += ["".join(rnd.choice("abrkdmisy z") for _ in range(rnd.randint(0, 600))) for _ in range(60)]
    counts, letters = language._parse(parser, pa.array([*texts, None]), block)
    for k, t in enumerate(texts):
        plain = re.sub(" +", " ", t)
        assert counts[k].tolist() == [brute_phrases(samples[name], plain) for name in parser.languages]
        assert letters[k] == sum(c.isalpha() for c in t)
    assert counts[-1].tolist() == [0] * 4


def test_samples_are_of_whole_texts(spark):
    docs = [(k, " ".join(f"{'abcdefghij'[part]}word" for part in range(10) for _ in range(400)), "en") for k in range(3)]
    parser = language.learn(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), F.lit(True), sample_chars=9000)
    assert 8000 < parser.lengths[0] < 9100
    assert (parser.symbols[[ord(c) for c in "abcdefghijword"]] > 1).all()  # of every part of the texts


def test_languages(spark, odd_docs, no_docs):
    rows = queries.QUERIES["op7_language_id"](spark, LARGER)
    truth = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(truth, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows.collect())
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    parser = language.learn(spark.read.parquet(f"{LARGER}/documents.parquet"), F.lit(True))
    out = language.identify(odd_docs, parser).collect()
    assert {r["lang_pred"] for r in out if not any(c.isalpha() for c in r["text"] or "")} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == odd_docs.count()
    assert language.identify(no_docs, parser).count() == 0
    nothing = language.learn(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in language.identify(odd_docs, nothing).collect()} == {"und"}


def test_few_long_labelled_texts_fill_a_sample(spark):
    draw = random.Random(5)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(3, 8)))
    shared = [word("abcdefghijklmnop") for _ in range(300)]
    words = {name: shared + [word(letters) for _ in range(300)] for name, letters in (("large", "abcdefghijkl"), ("other", "efghijklmnop"), ("rare", "cdefghijklmn"))}
    text = lambda name, chars: " ".join(draw.choices(words[name], k=chars // 3))[:chars]
    labelled = [(k, text(name, 400), name) for k, name in enumerate(["large", "other"] * 200)]
    labelled += [(1000, text("rare", 20000), "rare"), (1001, text("rare", 20000), "rare"), (None, None, "rare"), (1002, "short", None)]
    parser = language.learn(spark.createDataFrame(labelled, "doc_id bigint, text string, lang string"), F.lit(True))
    assert parser.languages == ["large", "other", "rare"]
    assert parser.lengths.min() > 29_000
    texts = [(k, text(name, 600), name) for k, name in enumerate(["large", "other", "rare"] * 20)]
    out = language.identify(spark.createDataFrame(texts, "doc_id bigint, text string, lang string"), parser).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) > 0.95 * len(out)


def test_short_samples_are_not_at_a_loss():
    draw = random.Random(6)
    core = ["".join(draw.choice("abcdefghijkl") for _ in range(draw.randint(3, 8))) for _ in range(150)]
    own = {name: ["".join(draw.choice("abcdefghijkl") for _ in range(draw.randint(3, 8))) for _ in range(150)] for name in ("large", "rare")}
    text = lambda name, k: " ".join(draw.choices(core + own[name], k=k))
    parser = language.build_parser({"large": text("large", 4500), "rare": text("rare", 200)})
    names = ["large", "rare"] * 50
    counts, _ = language._parse(parser, pa.array([text(name, 100) for name in names]))
    right = lambda found: np.mean([parser.languages[k] == name for k, name in zip(found, names, strict=True)])
    assert right(counts.argmin(1)) < 0.9 < right((counts * language.phrase_costs(parser)).argmin(1))


def test_quality(spark):
    rows = queries.QUERIES["op6_quality_classifier"](spark, LARGER).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    for mark in (0, 1):
        own = [r for r in held if truth[r["doc_id"]] == mark]
        assert sum(r["predicted"] == mark for r in own) > 0.9 * len(own)


def direct_fit(x, label, to_pooled, to_identity):
    """Densities straight from the rows of each label."""
    parts = [x[label == k] for k in (0, 1)]
    pooled = sum(len(p) * np.cov(p.T, bias=True) for p in parts) / len(x)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    models = []
    for p in parts:
        cov = ((1 - to_pooled) * np.cov(p.T, bias=True) + to_pooled * pooled) / np.outer(scale, scale)
        cov = (1 - to_identity) * cov + to_identity * np.eye(len(cov)) * max(np.trace(cov) / len(cov), 1e-6)
        models.append((p.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1], np.log(len(p) / len(x))))

    def scores(z):
        dens = [prior - det / 2 - np.einsum("ij,jk,ik->i", (z - m) / scale, inv, (z - m) / scale) / 2 for m, inv, det, prior in models]
        return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -60, 60)))

    return scores


def test_quality_fit_equals_a_direct_one(spark):
    rows = quality.with_statistics(spark.read.parquet(f"{LARGER}/documents.parquet"))
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    usable = queries.remainder(3) != 1
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2))
    known = rows.where(usable).join(labels, "doc_id").select("x", "quality", fold.alias("fold")).collect()
    x, label, half = (np.array([r[c] for r in known]) for c in ("x", "quality", "fold"))
    losses = []
    for grid in quality.GRID:
        p = np.clip(direct_fit(x[half == 0], label[half == 0], *grid)(x[half == 1]), 1e-6, 1 - 1e-6)
        truth = label[half == 1]
        losses.append(round(-np.log(p[truth == 1]).mean() - np.log(1 - p[truth == 0]).mean(), 6))
    want = direct_fit(x, label, *quality.GRID[int(np.argmin(losses))])
    some = rows.collect()
    got = {r["doc_id"]: r["score"] for r in quality.score(rows, quality.learn(rows, labels, usable)).collect()}
    expected = want(np.array([r["x"] for r in some]))
    assert max(abs(got[r["doc_id"]] - e) for r, e in zip(some, expected, strict=True)) < 1e-6


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    x = quality.with_statistics(odd_docs)
    assert all(np.isfinite(r["x"]).all() for r in x.collect()) and x.count() == odd_docs.count()
    assert quality.with_statistics(no_docs).count() == 0
    labels = spark.createDataFrame([(1, 0), (5, 1), (6, 1), (7, None), (10, 0), (8, 3)], "doc_id bigint, quality int")
    model = quality.learn(x, labels, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score(x, model).collect())
    assert quality.score(no_docs.selectExpr("doc_id", "array(0D) AS x"), model).count() == 0
    for nothing in (quality.learn(x, labels.limit(0), F.lit(True)), quality.learn(quality.with_statistics(no_docs), labels, F.lit(True))):
        assert {r["score"] for r in quality.score(x, nothing).collect()} == {0.5}
    alike = quality.learn(x, labels.where("quality = 1"), F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score(x, alike).collect())


def brute_statistics(text):
    """The twenty statistics by their definitions."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    n, some, many = len(words), max(len(words), 1), max(len(raw), 1)
    share = lambda x: math.log(x + 0.002)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / some
    out = {"words": math.log1p(n), "word_length": math.log1p(mean), "longest_word": math.log1p(max(lengths, default=0))}
    out["word_spread"] = math.log1p(math.sqrt(max(sum(x * x for x in lengths) / some - mean**2, 0)))
    kinds = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".", "commas": b",;:", "shouts": b"!?", "symbols": b"#$%&*+=@^_~", "bars": b"|/\\-", "markup": b"<>{}[]()\"'`"}
    for name, members in kinds.items():
        out[name] = share(sum(b in members for b in raw) / many)
    out["foreign"] = share(sum(b >= 128 for b in raw) / many)
    out["capitals"] = share(sum(65 <= w[0] <= 90 for w in words) / some)
    out["closed_words"] = share(sum(w[-1] in b".,;:!?" for w in words) / some)
    following = list(zip(words, words[1:]))  # noqa: B905
    out["distinct_words"] = share(len(set(words)) / some)
    out["distinct_pairs"] = share(len(set(following)) / max(n - 1, 1))
    out["same_as_before"] = share(sum(a == b for a, b in following) / max(n - 1, 1))
    lines = re.findall(rb"[^\n]*\n|[^\n]+", raw)
    out["lines"] = math.log1p(len(lines)) - math.log1p(n)
    out["distinct_lines"] = share(len(set(lines)) / max(len(lines), 1))
    return [out[name] for name in quality.STATISTICS]


def test_statistics_equal_brute_force(data):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist()]
    texts += ["", " ", "\n", "a", "A\n\nA\nb", "x x x", "no end of line\nlast", "é日 <b>!</b> 1|2", "\n\n a"]
    found = quality.statistics(pa.array(texts))
    assert np.allclose(found, [brute_statistics(t) for t in texts], atol=1e-9)


@pytest.mark.parametrize(("to_pooled", "to_identity"), [(0.2, 0.0), (0.5, 0.3), (0.05, 0.1)])
def test_densities_equal_the_textbook(to_pooled, to_identity):
    rnd = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    mix = rnd.normal(size=(d, d)) / 3
    x = [(rnd.normal(size=(n, d)) * (1 + k) + 2 * k) @ (np.eye(d) + mix) for k, n in enumerate((50, 80))]
    count, total = np.array([50.0, 80.0]), np.array([a.sum(0) for a in x])
    product = np.array([a.T @ a for a in x])
    model = quality.fit(count, total, product, to_pooled, to_identity)
    covs = [np.cov(a.T, bias=True) for a in x]
    pooled = (50 * covs[0] + 80 * covs[1]) / 130
    scale = np.sqrt(np.diag(pooled))
    probe, logs = rnd.normal(size=(5, d)) + 1, []
    for a, own, n in zip(x, covs, (50, 80), strict=True):
        cov = ((1 - to_pooled) * own + to_pooled * pooled) / np.outer(scale, scale)
        cov = (1 - to_identity) * cov + to_identity * np.eye(d) * np.trace(cov) / d
        off = (probe - a.mean(0)) / scale
        logs.append(np.log(n / 130) - np.linalg.slogdet(cov)[1] / 2 - (off @ np.linalg.inv(cov) * off).sum(1) / 2)
    assert np.allclose(model.scores(probe), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_pipeline_stages_keep_columns(spark, odd_docs, data):
    frame = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, data)
        assert frame.columns == odd_docs.columns
        frame = Scratch(spark, "t").keep(frame, "x")
    kept = {r["doc_id"] for r in frame.collect()}
    assert {1, 5, 7, 10, 11} <= kept and not {2, 3, 4, 6, 9} & kept
    assert frame.where("n_chars <> length(text)").count() == 0


def brute_pipeline(docs):
    """Which documents each stage keeps, and the texts that are packed, by plain search."""
    near = lambda rows: brute_near([(r["doc_id"], r["text"]) for r in rows])
    best = {}
    for r in docs:
        body = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        best[body] = min(best.get(body, (1, 0)), (-len(r["text"]), r["doc_id"]))
    once = [r for r in docs if any(r["doc_id"] == i for _, i in [best[re.sub(r"[\x20\x09-\x0D]", "", r["text"])]])]
    apart = [r for r, (i, least, _) in zip(once, near(once), strict=True) if i == least]
    out = {}
    for (i, _, removed, left), r in zip(brute_substrings([(r["doc_id"], r["text"]) for r in apart]), apart, strict=True):
        if left or not removed:
            out[i] = left if removed else r["text"]
    return out


def test_pipeline_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    spoken = corpus_pipeline.language_id(spark, docs, data)
    given = spoken.collect()
    assert {r["doc_id"] for r in given} == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    want = brute_pipeline(given)
    rows = corpus_pipeline.run(spark, data).collect()
    check_packing(rows, list(want.items()), 2048)


def test_pipeline_of_nothing(spark, no_docs, data):
    frame = no_docs
    for _, stage in corpus_pipeline.STAGES:
        frame = Scratch(spark, "t").keep(stage(spark, frame, data), "x")
        assert frame.count() == 0


def test_clean_documents_leave_as_they_came(spark, odd_docs, data):
    clean = [(20, "Two lines,\n\n  as they are.", "en", "a", 27), (21, None, "en", "a", None), (22, "", None, None, 0)]
    docs = odd_docs.unionByName(spark.createDataFrame(clean, odd_docs.schema))
    after = {(r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.substring_dedup(spark, docs, data).collect()}
    assert {(i, t, n) for i, t, _, _, n in clean} <= after
