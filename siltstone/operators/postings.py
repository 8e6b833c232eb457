"""A stored inverted index: searches that read the terms they ask for, not the texts.

Under the index's folder each batch of documents is a table of postings, a row
for each term of a document with its positions. Postings lie in buckets by the
term's hash, a folder each, sorted by term inside; a search reads the buckets of
its terms, and of these the pages that hold them. A bucket is dealt to tasks by
sections of documents too, so the postings of a frequent term, which every other
document may have, never meet in one task. Beside them are the documents'
lengths and the dictionary of terms. A batch counts once its commit is written,
so a failed one changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.fulltext import STOP_WORDS, Phrase, lexemes, parsed
from siltstone.functions.stemmers import STEMMERS
from siltstone.sources.shared import versions

#: Buckets of terms, and about how much text a section's documents have.
BUCKETS, SECTION_BYTES = 32, 256 << 20
#: The bucket of the documents' lengths while a batch is written; no term is in it.
LENGTHS = -1


#: A task works on so many words at a time, and remembers the terms of so many.
SLICE_WORDS, KNOWN_WORDS = 1 << 18, 1 << 16


def _slices(words: pa.ListArray, most: int = SLICE_WORDS) -> Iterator[slice]:
    """A batch's texts in slices of about ``most`` words; a longer text is one by itself."""
    ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def _postings_of(words: pa.ListArray, ids: pa.Array, analyser: str, known: dict[str, str] | None = None, by_term: bool = False) -> pa.RecordBatch:
    """``term, doc_id, positions`` of a batch: each distinct word is analysed once.

    ``known`` keeps terms for later batches. Rows are in the order of the texts, or
    with ``by_term`` those of a term together, which packs better.
    """
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    coded = words.flatten().dictionary_encode()
    stem, stop, numbers, known = STEMMERS[analyser], set(STOP_WORDS[analyser]), {}, {} if known is None else known
    if len(known) > KNOWN_WORDS:
        known.clear()

    def analysed(word: str) -> str:
        if word not in known:
            known[word] = stem(word)
        return known[word]

    term = analysed if stem else str
    term_of = np.array([-1 if w in stop else numbers.setdefault(term(w), len(numbers)) for w in coded.dictionary.to_pylist()] or [-1], np.int64)
    term = term_of[coded.indices.to_numpy(zero_copy_only=False)] if len(row) else np.zeros(0, np.int64)
    kept = np.flatnonzero(term >= 0)
    kept = kept[np.lexsort((row[kept], term[kept]) if by_term else (term[kept], row[kept]))]  # positions stay in order
    row, term, position = row[kept], term[kept], position[kept]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
    bounds = pa.array(np.append(first, len(row)), pa.int32())
    terms = pa.array(list(numbers), pa.string()).take(pa.array(term[first]))
    return pa.RecordBatch.from_arrays([terms, ids.take(pa.array(row[first])), pa.ListArray.from_arrays(bounds, pa.array(position, pa.int32()))], names=["term", "doc_id", "positions"])


class TextIndex:
    """The index at a folder that driver and executors share.

    ``analyser`` and ``buckets`` are those it was begun with. Ids are whole
    numbers; a document that is appended again replaces its earlier one.
    """

    def __init__(self, spark: SparkSession, path: str, analyser: str = "simple", buckets: int = BUCKETS):
        self.spark, self.path, self.analyser, self.buckets = spark, path, analyser, buckets
        if known := versions(spark, f"{path}/commits"):
            begun = spark.read.parquet(f"{path}/commits/{known[0]}").first()
            self.analyser, self.buckets = begun["analyser"], begun["buckets"]

    def _read(self, name: str, schema: str) -> DataFrame:
        """The batches of a table that were committed; a batch is a folder, as a bucket is."""
        known = versions(self.spark, f"{self.path}/commits")
        if not known:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch").isin(known))

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", section_bytes: int = SECTION_BYTES) -> int:
        """Add a batch of documents; returns its number.

        Rows without an id are left out, and of rows that share an id one counts,
        that with the greatest text; null and empty texts have no term. A batch
        whose writing failed is written anew under its number.
        """
        spark, analyser = self.spark, self.analyser
        number = max(versions(spark, f"{self.path}/commits"), default=0) + 1
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
        n, distinct, size = rows.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.sum(F.octet_length("text"))).first()
        if n != distinct:
            rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"))
        worded = rows.select("doc_id", lexemes("text").alias("words"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, str] = {}
            for batch in batches:
                for some in _slices(batch.column(1)):
                    part = batch.slice(some.start, some.stop - some.start)
                    made = _postings_of(part.column(1), part.column(0), analyser, known, by_term=True)
                    yield made.append_column("length", pa.nulls(made.num_rows, pa.int32()))
                    size = part.column(1).value_lengths().fill_null(0).cast(pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(size), pa.string()), part.column(0), pa.nulls(len(size), pa.list_(pa.int32())), size], names=["term", "doc_id", "positions", "length"])

        sections = max(1, -(-(size or 0) // section_bytes))
        # A task for each section of a bucket: what it sorts is bounded, so it needn't spill.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sections * self.buckets)
        # Texts are read once: rows without a term have their documents' lengths, in a bucket of their own.
        bucket = F.coalesce(F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(self.buckets)).cast("int"), F.lit(LENGTHS))
        made = worded.mapInArrow(run, "term string, doc_id bigint, positions array<int>, length int").withColumn("bucket", bucket)
        made = made.repartition(tasks, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(sections))).sortWithinPartitions("bucket", "term", "doc_id")
        made.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={number}")
        written = spark.read.schema("term string, doc_id bigint, positions array<int>, length int, bucket int").parquet(f"{self.path}/postings/batch={number}")
        lengths = written.where(F.col("bucket") == LENGTHS).select("doc_id", "length")
        lengths.write.mode("overwrite").parquet(f"{self.path}/documents/batch={number}")
        terms = written.where(F.col("bucket") != LENGTHS).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).alias("occurrences"))
        terms.repartitionByRange(max(1, min(tasks, sections * 4)), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/terms/batch={number}")
        old = self._read("documents", "doc_id bigint, length int, batch int")
        again = number > 1 and old.join(lengths.select("doc_id"), "doc_id", "left_semi").limit(1).count() > 0
        commit = [(number, self.analyser, self.buckets, bool(again))]
        spark.createDataFrame(commit, "batch int, analyser string, buckets int, replaces boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number}")
        return number

    def _replaces(self) -> bool:
        found = [f"{self.path}/commits/{n}" for n in versions(self.spark, f"{self.path}/commits")]
        return bool(found) and any(r["replaces"] for r in self.spark.read.schema("replaces boolean").parquet(*found).collect())  # one row for each batch

    def documents(self) -> DataFrame:
        """``doc_id, length, batch`` of all documents as they stand; a length counts all words."""
        rows = self._read("documents", "doc_id bigint, length int, batch int")
        if not self._replaces():
            return rows
        return rows.groupBy("doc_id").agg(F.max_by("length", "batch").alias("length"), F.max("batch").alias("batch"))

    def postings(self, terms: list[str]) -> DataFrame:
        """``term, doc_id, positions`` of these terms: only their buckets are read."""
        terms = sorted(set(terms))
        rows = self._read("postings", "term string, doc_id bigint, positions array<int>, batch int, bucket int")
        if not terms:
            return rows.limit(0).drop("batch", "bucket")
        near = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        rows = rows.where(F.col("bucket").isin(near) & F.col("term").isin(terms)).drop("bucket")
        if self._replaces():
            rows = rows.join(self.documents().select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")
        return rows.select("term", "doc_id", "positions")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many documents have each of a few terms, by the dictionary; replaced documents count too."""
        rows = self._read("terms", "term string, documents bigint, batch int").where(F.col("term").isin(sorted(set(terms))))
        return {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("documents").alias("n")).collect()}

    def search(self, text: str) -> DataFrame:
        """The ``doc_id`` of all documents that answer a search box's text (see ``fulltext.parsed``).

        Of each alternative the rarest term says which documents can match, and
        the other terms' postings are read for these only; phrases are checked by
        positions. Where an alternative only says what a text must not have, all
        documents are looked at, by their ids.
        """
        groups = parsed(text, self.analyser)
        asked = sorted({t for g in groups for p in g for t, _ in p.terms})
        if not asked:
            return self.documents().select("doc_id").limit(0)
        known = self.frequencies(asked)
        wanted = [[t for p in g if not p.minus for t, _ in p.terms] for g in groups]
        leads = {min(w, key=lambda t: (known.get(t, 0), t)) for w in wanted if w}
        hits = self.postings([t for t in asked if t in known])
        rest = [t for t in asked if t in known and t not in leads]
        if all(wanted) and rest:
            first = hits.where(F.col("term").isin(sorted(leads)))
            others = hits.where(F.col("term").isin(rest)).join(first.select("doc_id").distinct(), "doc_id", "left_semi")
            hits = first.unionByName(others.select(*first.columns))
        # A document has as many rows here as there are terms asked for, at most.
        found = hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        if not all(wanted):
            none = F.create_map().cast("map<string,array<int>>")
            found = self.documents().select("doc_id").join(found, "doc_id", "left").withColumn("at", F.coalesce("at", none))
        return found.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [_holds(p) for p in g]) for g in groups])).select("doc_id")

    def term_ranks(self, terms: list[str]) -> DataFrame:
        """``doc_id, rank``: ``fulltext.term_rank`` of every document with any of several analysed terms."""
        limit, weight = 1.64493406685, 0.1  # fixed values: the sum without end, and the weight
        n = F.size("positions")
        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, k: s + F.lit(1.0) / (k * k))
        rows = self.postings(terms).select("doc_id", total.alias("s")).groupBy("doc_id").agg(F.sum("s").alias("s"))
        return rows.select("doc_id", (F.col("s") * (weight / limit / len(terms))).alias("rank"))

    def shares(self, terms: list[str]) -> DataFrame:
        """``term, doc_id, share``: a term's share of a document's words, damped by its length (``fulltext.rank``)."""
        sized = self.documents().select("doc_id", "length")
        share = F.size("positions") / (1.0 + F.log(F.greatest("length", F.lit(1)).cast("double")))
        return self.postings(terms).join(sized, "doc_id").select("term", "doc_id", share.alias("share"))


def _holds(phrase: Phrase) -> Column:
    """Whether a document's positions (a map ``at`` by term) have a phrase."""
    at = [F.try_element_at("at", F.lit(t)) for t, _ in phrase.terms]
    has = at[0].isNotNull()
    if len(at) > 1:
        # Positions less their distance from the first word: what they share is where the phrase begins.
        begins = [_less(a, k) for a, (_, k) in zip(at, phrase.terms, strict=True)]
        has = F.coalesce(F.size(reduce(F.array_intersect, begins)) > 0, F.lit(False))
    return ~has if phrase.minus else has


def _less(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)
