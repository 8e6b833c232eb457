"""One query for each operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from siltstone.llm import bpe, fill_middle, fingerprints, language, naming, near_join, packing, quality, resample, sharding, substrings, token_files, warc
from siltstone.llm.columns import type_of
from siltstone.llm.scratch import Scratch

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(documents(spark, sf_dir))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir), shards=40)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "fingerprints")
    return fingerprints.edited_likeness(docs, fingerprints.learn_lexicon(docs, scratch), scratch)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_BPE)


def remainder(divisor: int) -> Column:
    """crc32 of the document id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = Scratch(spark, "quality").keep(quality.with_statistics(documents(spark, sf_dir)), "statistics")
    model = quality.learn(found, labels, usable=remainder(3) != 1)
    out = quality.score(found, model)
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    parser = language.learn(docs, usable=remainder(5) != 0)
    out = language.identify(docs.select("doc_id", "text"), parser)
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(documents(spark, sf_dir)).drop("row_key")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), BYTE_BPE)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").root
    token_files.write_token_files(documents(spark, sf_dir), path, BYTE_BPE, end_id=2)
    return token_files.read_token_files(spark, path, with_ids=False)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.transform(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = resample.resample(documents(spark, sf_dir).select("doc_id", "text"), target)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "archives").root
    warc.write_warc(pages, path)
    out = warc.read_warc(spark, path, id_type=type_of(pages, "page_id"), with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_virtual_slots, op4_document_fingerprints, op5_best_fit_packing, op6_quality_classifier, op7_language_id, op8_ngram_jaccard_join, op9_bpe_round_trip, op10_token_files, op11_fill_in_middle, op12_importance_resampling, op13_warc_round_trip)}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d),
keyed AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM win),
least AS (SELECT k, min(doc_id) AS first FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM keyed JOIN least USING (k) WHERE doc_id > first),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS b FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY b)::BIGINT AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(b) AS text_sha256
FROM d WINDOW w AS (PARTITION BY b ORDER BY length(t) DESC, doc_id)""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
part AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM part""",
    # CRC-32 by half bytes: the list is what it becomes by each value of its low half byte (0xEDB88320).
    "op12_importance_resampling": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM d),
g AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM b),
u AS (SELECT x, hex(x) AS h FROM (SELECT x FROM f UNION SELECT x FROM g)),
n AS (SELECT x, list_transform(range(0, len(h)), lambda i: strpos('0123456789ABCDEF', h[i + 2 - 2 * (i % 2)]) - 1) AS digits FROM u),
k AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, digits), lambda c, q: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, q) & 15) + 1], c >> 4)), 4294967295::BIGINT) % 10000 AS bucket FROM n),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (x) GROUP BY 1),
z AS (SELECT (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM g) AS aimed),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (total + 10000) / ((s + 1)::DOUBLE * (aimed + 10000)))) AS gain FROM z, s LEFT JOIN t USING (bucket)),
v AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN k USING (x) JOIN gain USING (bucket) GROUP BY 1),
r AS (SELECT d.doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN v USING (doc_id)),
o AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS place FROM r)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM r WHERE n >= 20) // 100 THEN place END AS rank FROM o""",
    "op13_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
sized AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM sized""",
}
