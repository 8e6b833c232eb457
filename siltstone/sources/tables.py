"""Readers: every source becomes a DataFrame by one of Spark's own formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.networks import network_lookup, networks_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_pages(spark: SparkSession, path: str, items: str = "objects") -> DataFrame:
    """Landed pages of a paginated JSON service, one row for each entry of ``items``."""
    pages = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return pages.select(F.explode(items).alias("item")).select("item.*")


def sparql_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Landed SPARQL answers: a row for each binding, a text column for each of ``names`` (null: not bound)."""
    raw = spark.read.option("wholetext", True).text(path)
    found = F.from_json(F.get_json_object("value", "$.results.bindings"), "array<map<string,struct<type:string,value:string>>>")
    return raw.select(F.explode(found).alias("b")).select(*[F.col("b")[n]["value"].alias(n) for n in names])


def binary_pages(spark: SparkSession, path: str, to_text, names: str = "*.pdf") -> DataFrame:  # noqa: ANN001
    """Files whose text a given function takes out of their bytes: ``url, text``.

    ``to_text`` is the caller's (there is no PDF reader here); a file that it
    can't read has a null text.
    """
    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str | None:
            try:
                return to_text(raw)
            except Exception:  # noqa: BLE001  a caller's reader raises what it likes; one bad file doesn't end the job
                return None

        return contents.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    return files.select(F.col("path").alias("url"), read("content").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, explode: str | None = None) -> DataFrame:
    """JSON lines; malformed lines are skipped, and an array column is turned into rows."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).where("trim(value) <> ''").select(parsed.alias("r")).select("r.*").where("_corrupt_record IS NULL").drop("_corrupt_record")
    return rows.withColumn(explode, F.explode(explode)) if explode else rows


def csv_feed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def xml_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """An RSS or XML feed, a row for each ``row_tag``."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def graphql_nodes(spark: SparkSession, path: str, node_path: str, schema: str) -> DataFrame:
    """Landed GraphQL answers: the list at ``node_path``, parsed by ``schema``."""
    raw = spark.read.option("wholetext", True).text(path)
    nodes = F.from_json(F.get_json_object("value", f"$.{node_path}"), f"array<struct<{schema}>>")
    return raw.select(F.explode(nodes).alias("n")).select("n.*")


def newest(rows: DataFrame, at: str) -> DataFrame:
    """The time up to which a feed was read, one row ``seen_to``: where the next read begins."""
    return rows.agg(F.max(at).alias("seen_to"))


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed HTML files, one row each: ``url, html``."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections: ``properties`` as a map and ``geometry`` as GeoJSON text."""
    raw = spark.read.option("wholetext", True).text(path)
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    one = raw.select(F.explode(features).alias("f"))
    return one.select(F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"), F.get_json_object("f", "$.geometry").alias("geometry"))


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A VALUES relation."""
    return spark.createDataFrame(rows, schema)


def due(rows: DataFrame, last_seen: str, as_of: str, hours: int, limit: int | None = None) -> DataFrame:
    """Rows never seen, or not for ``hours`` before ``as_of``.

    With a ``limit``, that many of them, never-seen ones and then the oldest first;
    else all, in no order, which spares a sort of the table.
    """
    stale = F.col(last_seen).isNull() | (F.col(last_seen) < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
    out = rows.where(stale)
    return out.orderBy(F.col(last_seen).asc_nulls_first()).limit(limit) if limit else out


def geo_lookup(rows: DataFrame, ranges: DataFrame, ip: str) -> DataFrame:
    """The network (``first, last`` as numbers, with any facts) that holds each address of version 4.

    A range is a row for each of the networks that it is made of, at most 62. Of
    ranges that overlap the narrowest counts, then the one that begins first. For
    networks in the usual notation, of either version, see ``networks``.
    """
    narrowest = [F.col("last") - F.col("first"), F.col("first")]
    return network_lookup(rows, networks_of(ranges, to="__network"), ip, "__network", narrowest).drop("first", "last")
