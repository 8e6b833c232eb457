"""One row of each key: the latest, or the best by an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(rows: DataFrame, keys: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark drops later rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def latest(rows: DataFrame, keys: list[str], at: str, tie: str, columns: list[str]) -> DataFrame:
    """The latest row of each key by ``max_by``: partial aggregation, no sort; null times lose."""
    row = F.struct(*columns)
    best = rows.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(at), F.col(tie))).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in columns if c not in keys])
