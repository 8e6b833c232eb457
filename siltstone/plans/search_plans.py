"""Similarity and keyword search over ``embeddings`` and ``documents``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import fulltext, vectors
from siltstone.operators import retrieval, search
from siltstone.operators.postings import TextIndex
from siltstone.operators.vector_index import VectorIndex
from siltstone.plans.registry import query
from siltstone.sources.shared import shared_folder, versions
from siltstone.sources.tables import table

_SIM = """SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""
_POOL = f"SELECT * FROM ({_SIM}) ORDER BY sim DESC, vec_id LIMIT 200"


_INDEXES: dict[tuple[str, str, str], str] = {}


def text_index(spark: SparkSession, sf_dir: str, analyser: str = "simple") -> TextIndex:
    """The stored index of ``documents``: written once by a session, then read by all searches."""
    key = (spark.sparkContext.applicationId, sf_dir, analyser)
    if key not in _INDEXES or not versions(spark, f"{_INDEXES[key]}/commits"):
        _INDEXES[key] = shared_folder(spark, "text-index")
        TextIndex(spark, _INDEXES[key], analyser).append(table(spark, sf_dir, "documents"))
    return TextIndex(spark, _INDEXES[key])


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored index of ``embeddings``: written once by a session, then read by all searches."""
    key = (spark.sparkContext.applicationId, sf_dir, "vectors")
    if key not in _INDEXES or not versions(spark, f"{_INDEXES[key]}/commits"):
        _INDEXES[key] = shared_folder(spark, "vector-index")
        VectorIndex.begin(table(spark, sf_dir, "embeddings"), _INDEXES[key], "vec_id", "embedding")
    return VectorIndex(spark, _INDEXES[key])


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search.with_similarity(rows, rows.where("vec_id = 0").select(F.col("embedding").alias("q"))).drop("embedding")


@query(f"{_SIM} ORDER BY sim DESC, vec_id LIMIT 20")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(_similar(spark, sf_dir), "vec_id", 20).select("vec_id", "label", "sim")


@query(f"SELECT * FROM ({_SIM}) WHERE sim >= 0.1")
def similarity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).where("sim >= 0.1").select("vec_id", "label", "sim")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS sim FROM embeddings, q)
SELECT query_id, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.nearest_of_each(rows, asked, "vec_id", "query_id", 5).select("query_id", "vec_id", "sim")


@query(f"{_SIM} ORDER BY sim DESC, vec_id LIMIT 20")
def knn_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the stored index, all cells that can hold one of the nearest rows."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    return vector_index(spark, sf_dir).search(asked, 20, exact=True).select("vec_id", "label", "sim")


@query()
def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the stored index, the measured number of cells; how many neighbours this finds is in ``index_recall``."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    return vector_index(spark, sf_dir).search(asked, 20).select("vec_id", "label", "sim")


@query()
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the share of its true twenty nearest rows that the index finds."""
    rows, index = table(spark, sf_dir, "embeddings"), vector_index(spark, sf_dir)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    true = search.nearest_of_each(rows, asked, "vec_id", "query_id", 20).select("query_id", "vec_id")
    found = index.search_each(asked, "query_id", 20).select("query_id", "vec_id", F.lit(True).alias("found"))
    both = true.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("neighbours"), F.count("found").alias("found"))
    return both.select("query_id", "neighbours", "found", (F.col("found") / F.col("neighbours")).alias("recall"), F.lit(index.probes).alias("cells_read"), F.lit(len(index.centroids)).alias("cells"))


_THE = "regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)')"


@query(f"""WITH pool AS (SELECT p.*, coalesce({_THE}, false) AS hit FROM ({_POOL}) p LEFT JOIN documents ON doc_id = vec_id), ok AS (SELECT * FROM pool WHERE sim >= 0.1),
top AS (SELECT label, count(*) AS mentions, max(sim) AS best_sim, round(avg(sim), 4) AS avg_sim, count(*) FILTER (WHERE hit) AS keyword_hits FROM ok GROUP BY label ORDER BY mentions DESC, best_sim DESC, label LIMIT 5),
r AS (SELECT ok.*, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rn FROM ok)
SELECT label, mentions, best_sim, avg_sim, keyword_hits, vec_id, sim FROM r JOIN top USING (label) WHERE rn <= 3""")
def grouped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.held(search.nearest(_similar(spark, sf_dir), "vec_id", 200))
    hits = text_index(spark, sf_dir).search("the").select(F.col("doc_id").alias("vec_id"))
    hits = hits.join(F.broadcast(pool.select("vec_id")), "vec_id", "left_semi").withColumn("hit", F.lit(True))
    pool = pool.join(hits, "vec_id", "left").withColumn("keyword_hit", F.coalesce("hit", F.lit(False)))
    return search.grouped(pool, "label", "vec_id", floor=0.1)


@query(f"""WITH pool AS ({_POOL}), ok AS (SELECT * FROM pool WHERE sim >= 0.05)
SELECT label, count(*) AS mentions, max(sim) AS best_sim FROM ok GROUP BY label ORDER BY best_sim DESC, label LIMIT 3""")
def grouped_by_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.nearest(_similar(spark, sf_dir), "vec_id", 200)
    out = search.grouped(pool, "label", "vec_id", floor=0.05, order="best_match", groups=3, per_group=1)
    return out.select("label", "mentions", "best_sim")


@query(f"""WITH pool AS ({_POOL})
SELECT 'label' AS facet, label::VARCHAR AS value, count(*) AS n, round(avg(sim), 3) AS avg_sim FROM pool GROUP BY 2
UNION ALL SELECT 'parity', CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END, count(*), round(avg(sim), 3) FROM pool GROUP BY 2""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.nearest(_similar(spark, sf_dir), "vec_id", 200)
    return search.facets(pool, {"label": F.col("label"), "parity": F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")})


@query(f"SELECT least(count(*), 100)::BIGINT AS total, count(*) > 100 AS capped FROM (SELECT 1 FROM ({_SIM}) WHERE sim > 0 LIMIT 101)")
def capped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.capped_count(_similar(spark, sf_dir).where("sim > 0"), cap=100)


@query(f"""WITH pool AS (SELECT p.vec_id, sim, ts FROM ({_POOL}) p JOIN events e ON e.event_id = p.vec_id)
SELECT vec_id, sim, ts FROM (SELECT * FROM pool ORDER BY sim DESC, vec_id LIMIT 100) ORDER BY ts DESC, vec_id LIMIT 20""")
def two_stage_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.nearest(_similar(spark, sf_dir), "vec_id", 200)
    dated = pool.join(table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "ts"), "vec_id")
    return search.recent_of_nearest(dated, "vec_id", "ts", pool=100, keep=20).select("vec_id", "sim", "ts")


@query(f"""SELECT vec_id, label, sim FROM ({_SIM}) ORDER BY label, sim DESC, vec_id LIMIT 15 OFFSET 30""")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("label"), F.col("sim").desc(), F.col("vec_id")]
    return search.page(_similar(spark, sf_dir), order, number=3, size=15).select("vec_id", "label", "sim")


@query(f"""WITH pool AS ({_POOL}), h AS (SELECT p.*, regexp_matches(lower(d.text), '(^|[^a-z])the([^a-z]|$)') AS hit FROM pool p JOIN documents d ON d.doc_id = p.vec_id)
SELECT count(*) FILTER (WHERE hit) AS both_hits, count(*) FILTER (WHERE NOT hit) AS semantic_only FROM h""")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.nearest(_similar(spark, sf_dir), "vec_id", 200)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    hit = F.lower("text").rlike("(^|[^a-z])the([^a-z]|$)")
    return search.keyword_overlap(pool.join(docs, "vec_id").withColumn("keyword_hit", hit))


@query(f"""WITH pool AS (SELECT * FROM ({_SIM}) ORDER BY sim DESC, vec_id LIMIT 100)
SELECT vec_id, sim, sim * 0.5 + label * 0.01::DOUBLE AS rerank FROM pool ORDER BY rerank DESC, vec_id LIMIT 10""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scorer(sim: pd.Series, label: pd.Series) -> pd.Series:
        return sim * 0.5 + label * 0.01

    return search.rerank(_similar(spark, sf_dir), scorer, ["sim", "label"], "vec_id").select("vec_id", "sim", "rerank")


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS s FROM documents)
SELECT doc_id FROM d WHERE (list_contains(w, 'the') AND contains(s, ' of the ') AND NOT list_contains(w, 'and')) OR (list_contains(w, 'und') AND list_contains(w, 'nicht'))""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).search('the "of the" -and or und nicht')


@query(f"""WITH d AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM d GROUP BY term""")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole dictionary of the stored index."""
    rows = text_index(spark, sf_dir)._read("terms", "term string, documents bigint, occurrences bigint, batch int")
    return rows.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS s FROM documents)
SELECT doc_id FROM d WHERE (contains(s, ' in der ') AND NOT contains(s, ' und die ')) OR NOT list_contains(w, 'de')""")
def search_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index in two batches, of which the second holds a third of the first's documents again."""
    docs, index = table(spark, sf_dir, "documents"), TextIndex(spark, shared_folder(spark, "text-batches"))
    index.append(docs.where("lang IS NOT NULL AND lang <> 'en' OR doc_id % 3 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, "in der de").otherwise(F.col("text"))))
    index.append(docs.where("lang IS NULL OR lang = 'en' OR doc_id % 3 = 0"))
    return index.search('"in der" -"und die" or -de')


@query()
def english_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By English stems, over an index of stems; no SQL has these, so the tests hold it against word lists."""
    return text_index(spark, sf_dir, "english").search('things -being or "ends ands" or ering')


@query()
def french_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir, "french").search('"dans les elle" or ourions -quement or ellement')


@query()
def search_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best answers of a search with their best fragments (a page of results)."""
    index = text_index(spark, sf_dir)
    best = index.term_ranks(["nicht", "the", "was"]).select("doc_id", F.round("rank", 6).alias("rank")).orderBy(F.col("rank").desc(), "doc_id").limit(50)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(best), "doc_id")
    return texts.select("doc_id", "rank", fulltext.best_fragments(F.col("text"), "the nicht or was").alias("headline"))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'nicht')) AS b FROM d)
SELECT doc_id, round((coalesce(list_sum(list_transform(range(1, a + 1), lambda k: 1.0::DOUBLE / (k * k))), 0) + coalesce(list_sum(list_transform(range(1, b + 1), lambda k: 1.0::DOUBLE / (k * k))), 0)) * (0.1::DOUBLE / 1.64493406685::DOUBLE / 2), 6) AS rank FROM n WHERE a + b > 0 ORDER BY rank DESC, doc_id LIMIT 20""")
def term_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = text_index(spark, sf_dir).term_ranks(["the", "nicht"])
    return ranked.select("doc_id", F.round("rank", 6).alias("rank")).orderBy(F.col("rank").desc(), "doc_id").limit(20)


_STOPS = ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS["english"])


@query(f"""WITH d AS (SELECT doc_id, list_filter({_WORDS}, lambda x: NOT list_contains([{_STOPS}], x)) AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS terms, len(list_distinct(w))::INTEGER AS distinct_terms FROM d""")
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English analyser's terms, as many as the words that aren't stop words; and these words, once each."""
    words = F.filter(fulltext.lexemes("text"), lambda w: ~w.isin(*fulltext.STOP_WORDS["english"]))
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"), fulltext.analysed("text", "english").alias("t"))
    return docs.select("doc_id", F.size("t").alias("terms"), F.size(F.array_distinct("w")).alias("distinct_terms"))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, round(len(list_filter(w, lambda x: x IN ('the', 'nicht'))) / (1.0 + ln(greatest(len(w), 1))), 6) AS rank FROM d
WHERE list_contains(w, 'the') OR list_contains(w, 'nicht') ORDER BY rank DESC, doc_id LIMIT 20""")
def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = text_index(spark, sf_dir).shares(["the", "nicht"]).groupBy("doc_id").agg(F.round(F.sum("share"), 6).alias("rank"))
    return ranked.orderBy(F.col("rank").desc(), "doc_id").limit(20)


@query("""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS a FROM documents),
h AS (SELECT doc_id, a, list_transform(a, lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g') IN ('the', 'this')) AS hit FROM w),
k AS (SELECT doc_id, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN hit[i] THEN '<b>' || a[i] || '</b>' ELSE a[i] END) AS b, list_filter(range(0, len(a)), lambda i: hit[i + 1]) AS hits FROM h),
f AS (SELECT doc_id, b, hits, greatest(hits[1] - 10, 0) AS s1 FROM k), g AS (SELECT *, list_filter(hits, lambda i: i >= s1 + 35)[1] AS h2 FROM f)
SELECT doc_id, CASE WHEN len(hits) = 0 THEN array_to_string(b[1:15], ' ') ELSE array_to_string(b[s1 + 1:s1 + 35], ' ') || CASE WHEN h2 IS NULL THEN '' ELSE ' … ' || array_to_string(b[greatest(h2 - 10, s1 + 35) + 1:greatest(h2 - 10, s1 + 35) + 35], ' ') END END AS headline FROM g""")
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", fulltext.headline(F.col("text"), ["the", "this"]).alias("headline"))


@query(f"""WITH ranked AS (SELECT 0 AS query_id, vec_id, label, row_number() OVER (ORDER BY sim DESC, vec_id) AS r FROM ({_SIM})),
want AS (SELECT vec_id FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0))
SELECT 0 AS query_id, round(sum(CASE WHEN r <= 10 THEN 1.0 / log2(r + 1) ELSE 0 END) / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 11) t(i)), 6) AS ndcg,
round(count(*) FILTER (WHERE r <= 20) / (SELECT count(*) FROM want), 6) AS recall FROM ranked WHERE vec_id IN (SELECT vec_id FROM want)""")
def ndcg_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = _similar(spark, sf_dir)
    own = sims.where("vec_id = 0").select(F.col("label").alias("own"))
    wanted = sims.join(F.broadcast(own), F.col("label") == F.col("own")).select(F.lit(0).alias("query_id"), "vec_id")
    best = search.nearest(sims, "vec_id", 20).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "vec_id"))).alias("a"))
    ranking = best.select(F.lit(0).alias("query_id"), F.posexplode("a").alias("p", "x")).select("query_id", F.col("x.vec_id").alias("vec_id"), (F.col("p") + 1).alias("r"))
    return retrieval.ranking_quality(ranking, wanted, "query_id", "vec_id", "r")


@query("""WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS total FROM s),
q AS (SELECT lang, n, round(n * 100.0 / total)::BIGINT AS quota FROM s, t),
m AS (SELECT 100 - sum(quota) AS missing FROM q),
p AS (SELECT lang, quota + CASE WHEN row_number() OVER (ORDER BY n DESC, lang) <= abs(missing) THEN sign(missing) ELSE 0 END AS quota FROM q, m)
SELECT lang, quota::BIGINT AS n FROM p""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = retrieval.stratified_sample(table(spark, sf_dir, "documents"), ["lang"], "doc_id", 100, seed=7)
    return drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT vec_id, '[' || array_to_string(embedding, ',') || ']' AS t FROM embeddings)
SELECT vec_id, len(t::FLOAT[])::INTEGER AS n, (round(list_sum(t::FLOAT[]::DOUBLE[]), 4) + 0.0::DOUBLE) AS total FROM v""")
def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = vectors.vector_literal(F.col("embedding"))
    back = table(spark, sf_dir, "embeddings").select("vec_id", vectors.parse_vector(text).alias("v"))
    return back.select("vec_id", F.size("v").alias("n"), (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4) + 0.0).alias("total"))
