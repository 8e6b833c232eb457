"""The corpus pipeline: language, exact copies, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import language, naming, near_join, packing, queries, substrings
from siltstone.llm.columns import quoted, unused
from siltstone.llm.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in some language stay, with the language found as ``lang``.

    Null and empty texts and those without a letter go. Without a label to learn
    from no language is known: then all texts with a letter stay as they are. Texts
    of any length are parsed whole, repeated rows stay repeated, extra columns pass
    through whatever their names, and an empty table stays empty.
    """
    usable = queries.remainder(5) != 0
    if not docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).limit(1).count():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    parser = language.learn(docs, usable=usable)
    own_lang, own_score = unused(docs, "found", "score")
    found = language.identify(docs, parser, lang_as=own_lang, score_as=own_score)
    return found.where(F.col(own_lang) != language.UNDETERMINED).withColumn("lang", F.col(own_lang)).select(*map(quoted, docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the longest and then the one with the smallest id.

    Null texts are empty, empty ones are one text. Very long texts are read whole,
    of rows repeated in all columns one stays, extra columns pass through whatever
    their names, and an empty table stays empty.
    """
    return naming.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id.

    Texts without a word, null ones too, are near to none but equal ones. Very long
    texts are read whole, of repeated rows one stays, extra columns pass through
    whatever their names, and an empty table stays empty.
    """
    return near_join.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, ``n_chars`` follows the text, and documents that lost all words go.

    Documents that lose nothing stay as they are, null and empty texts too; very
    long texts are read whole, and of rows repeated in text that with the smallest
    id keeps it. Extra columns pass through whatever their names; without a column
    ``n_chars`` there is none to follow. An empty table stays empty.
    """
    own = {n: unused(docs, n)[0] for n in ("n_words", "n_removed") if unused(docs, n)[0] != n}
    apart = docs.withColumnsRenamed({c: own[c.lower()] for c in docs.columns if c.lower() in own})
    cut = substrings.remove_repeats(apart, rejoin=False)
    changed = F.col("n_removed") > 0
    kept = cut.where(~changed | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(quoted(a)).alias(c) for a, c in zip(apart.columns, docs.columns, strict=True)])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document and its place; null and empty texts are an end id each.

    Very long texts are cut into pieces, repeated rows are packed each, other
    columns are not read, and an empty table gives an empty one.
    """
    return packing.pack_documents(docs, queries.WORD_BPE)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Cross-parsing, MinHash and BPE have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's table written and read again."""
    docs, scratch = queries.documents(spark, sf_dir), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
