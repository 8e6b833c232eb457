"""One text, one id, or none, in a third of all rows and more."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import fingerprints, naming, near_join, packing, queries, scratch, sharding, substrings, token_files
from siltstone.llm.scratch import Scratch, exists
from tests.llm.test_dedup import brute_exact, brute_near, brute_substrings, order
from tests.llm.test_tokens import check_packing, library

SAME = " ".join(f"s{k}" for k in range(40))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    docs = [(k, SAME) for k in range(60)]  # copies
    docs += [(60 + k, SAME + f" tail{k % 6}") for k in range(60)]  # near copies, copied too
    docs += [(120 + k, " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(50)) for _ in range(rnd.randint(0, 60)))) for k in range(40)]
    docs += [(7777, f"one id {k}") for k in range(20)] + [(None, f"no id {k % 3}") for k in range(20)]
    rnd.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).cache()


def test_exact_copies(docs, rows):
    assert order(map(tuple, naming.exact_groups(docs).collect())) == order(brute_exact(rows))


def test_copies_are_sorted_once(spark, docs):
    """What is sorted by content is distinct: the copies of a text are one row there."""
    own = Scratch(spark, "t")
    valued = docs.select(F.xxhash64("text").alias("key"), F.col("text").alias("block"), F.monotonically_increasing_id().alias("p"))
    naming._named(valued.select("key", "p"), valued, ["block"], ["p"], own, "x")
    names = spark.read.parquet(own.path("x-names"))
    assert names.count() == docs.select("text").distinct().count() and names.agg(F.max("n")).first()[0] == 1


def test_near_copies(docs, rows):
    for block_bytes in (2000, 1 << 20):
        found = near_join.near_duplicates(docs, block_bytes=block_bytes).select("doc_id", "class_id", "n_links")
        assert order(map(tuple, found.collect())) == order(brute_near(rows))


def test_edges_of_one_node_are_dealt_out(spark):
    from siltstone.llm import components

    star = spark.createDataFrame([(k, 0) for k in range(1, 3000)], "a bigint, b bigint")
    both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    salted = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(components.SALTS)))
    assert salted.groupBy("a", "salt").count().agg(F.max("count")).first()[0] < 30
    found = components.connected_components(star, Scratch(spark, "t"), "c")
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 3000


def test_repeated_passages(docs, rows):
    found = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "text")
    assert order(map(tuple, found.collect())) == order(brute_substrings(rows))


def test_shards_of_one_text(docs, rows):
    found = sharding.shard_rows(docs, 5).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)


def test_sequences_of_one_text(docs, rows):
    check_packing(packing.pack_documents(docs, queries.WORD_BPE, capacity=64, group_pieces=50).collect(), rows, 64)


def test_fingerprints_of_one_text(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_BYTES", 2000)
    own = Scratch(spark, "t")
    found = fingerprints.edited_likeness(docs, fingerprints.learn_lexicon(docs, own), own).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in found) == Counter((i, len(t)) for i, t in rows)


def test_files_of_one_text(spark, docs, rows):
    path = Scratch(spark, "t").root
    token_files.write_token_files(docs, path, queries.BYTE_BPE, end_id=2, part_bytes=2000)
    found = token_files.read_token_files(spark, path).collect()
    lengths = [len(x) + 1 for x in library(queries.BYTE_BPE)([t for _, t in rows])]
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == Counter(zip((i for i, _ in rows), lengths, strict=True))


def test_scratch_tables_can_be_swept(spark):
    own = Scratch(spark, "t")
    own.keep(spark.range(3), "x")
    assert exists(spark, own.root)
    kept = set(scratch._used)
    scratch._used.clear()
    scratch._used.add(own.root)
    scratch.sweep(spark)
    assert not exists(spark, own.root) and not scratch._used
    scratch._used.update(kept - {own.root})
