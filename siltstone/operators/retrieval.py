"""How good a ranking is, and samples to judge it on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_quality(ranking: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, ndcg_at: int = 10, recall_at: int = 20) -> DataFrame:
    """``ndcg, recall`` of each query of ``relevant`` (binary gains; 0 if nothing is found)."""
    wanted = relevant.groupBy(query).agg(F.count(F.lit(1)).alias("__n"))
    hits = ranking.join(relevant.select(query, item), [query, item], "left_semi")
    gain = F.when(F.col(rank) <= ndcg_at, F.lit(1.0) / F.log2(F.col(rank) + F.lit(1.0))).otherwise(0.0)
    got = hits.groupBy(query).agg(F.sum(gain).alias("__dcg"), F.count_if(F.col(rank) <= recall_at).alias("__hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("__n"), F.lit(ndcg_at)).cast("int")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + F.lit(1.0)))
    out = wanted.join(got, query, "left")
    return out.select(query, F.round(F.coalesce(F.col("__dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"), F.round(F.coalesce("__hits", F.lit(0)) / F.col("__n"), 6).alias("recall"))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, target: int, seed: int, forced: DataFrame | None = None) -> DataFrame:
    """About ``target`` rows, each stratum's share of them; a hash of key and seed draws.

    Quotas are rounded, then one row at a time is added to or taken from the
    largest strata until they add up. Rows of ``forced`` come first in theirs.
    """
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 1
    sizes = sizes.withColumn("__quota", F.round(F.col("__n") * target / F.lit(total)).cast("long"))
    # One row for each stratum: the correction needs them in one order.
    missing = target - (sizes.agg(F.sum("__quota")).first()[0] or 0)
    place = F.row_number().over(Window.orderBy(F.col("__n").desc(), *strata))
    step = F.when(place <= abs(missing), 1 if missing > 0 else -1).otherwise(0)
    sizes = sizes.withColumn("__quota", F.col("__quota") + step)
    first = rows.withColumn("__forced", F.lit(False)) if forced is None else rows.join(forced.select(key).distinct().withColumn("__forced", F.lit(True)), key, "left").fillna({"__forced": False})
    order = Window.partitionBy(*strata).orderBy(F.col("__forced").desc(), F.xxhash64(key, F.lit(seed)), key)
    drawn = first.withColumn("__rn", F.row_number().over(order)).join(sizes, strata)
    return drawn.where((F.col("__rn") <= F.col("__quota")) | F.col("__forced")).select(rows.columns)


def quality_means(quality: DataFrame, queries: DataFrame, query: str, category: str) -> DataFrame:
    """Means over all queries and over each category: ``category, n, ndcg, recall``; all are ``*``."""
    rows = quality.join(queries.select(query, category), query, "left").withColumn(category, F.coalesce(category, F.lit("_uncat")))
    both = rows.select(F.explode(F.array(F.col(category), F.lit("*"))).alias("category"), "ndcg", "recall")
    return both.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg"), 4).alias("ndcg"), F.round(F.avg("recall"), 4).alias("recall"))


def cross_lingual_recall(ranking: DataFrame, relevant: DataFrame, queries: DataFrame, query: str, item: str, rank: str, at: int = 10) -> DataFrame:
    """The mean recall of queries whose ``language`` is not their ``target_language``: one row ``n, recall``."""
    across = queries.where("language <> target_language").select(query)
    found = ranking_quality(ranking, relevant.join(across, query, "left_semi"), query, item, rank, recall_at=at)
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 4).alias("recall"))
