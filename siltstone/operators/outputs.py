"""Results as feeds, digests and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.strings import collapse, xml_escape
from siltstone.sources.shared import drop_folder, versions


def rss_items(rows: DataFrame, title: str, link: str, body: str, at: str, keep: list[str] | None = None) -> DataFrame:
    item = F.concat(F.lit("<item><title>"), xml_escape(title), F.lit("</title><link>"), xml_escape(link), F.lit("</link><description>"), xml_escape(body), F.lit("</description><pubDate>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate></item>"))
    return rows.select(*(keep or []), item.alias("item"))


def rss_channel(items: DataFrame, title: str, link: str, description: str, at: str, item: str = "item", most: int = 50) -> DataFrame:
    """One row ``feed``: a channel with the ``most`` latest items (a feed's length)."""
    latest = items.orderBy(F.col(at).desc_nulls_last(), F.col(item)).limit(most)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(item).alias("item"))), asc=False), lambda x: x["item"]), "")
    head = "<?xml version=\"1.0\" encoding=\"UTF-8\"?><rss version=\"2.0\"><channel><title>{}</title><link>{}</link><description>{}</description>"
    escaped = [x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for x in (title, link, description)]
    return latest.agg(F.concat(F.lit(head.format(*escaped)), body, F.lit("</channel></rss>")).alias("feed"))


def digest_line(name: Column, text: Column, most: int = 280) -> Column:
    body = collapse(text)
    return F.concat(name, F.lit(": "), F.when(F.length(body) > most, F.concat(F.rtrim(F.substring(body, 1, most)), F.lit("…"))).otherwise(body))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def touched(rows: DataFrame, at: Column, column: str = "updated_at") -> DataFrame:
    """Rows that a writer changes carry the time of it."""
    return rows.withColumn(column, at)


def refresh(view: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """Write a derived table as the next version under ``path``, and read it.

    A version stands once it is written whole, so a refresh that fails changes
    nothing: readers of ``refreshed`` go on with the one before. The last ``keep``
    versions stay, for those who still read them.
    """
    spark = view.sparkSession
    number = max(versions(spark, path), default=0) + 1
    view.write.mode("overwrite").parquet(f"{path}/{number}")
    for old in versions(spark, path)[:-keep]:
        drop_folder(spark, f"{path}/{old}")
    return spark.read.schema(view.schema).parquet(f"{path}/{number}")


def refreshed(spark: SparkSession, path: str) -> DataFrame:
    """The latest version that ``refresh`` has written; raises if there is none."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version was written under {path}")
    return spark.read.parquet(f"{path}/{known[-1]}")
