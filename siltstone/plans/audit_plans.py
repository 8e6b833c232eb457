"""Audits, labels, numbering, time zones and objects: the smaller shapes of the inventory."""

from __future__ import annotations


from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import upserts
from siltstone.operators.latest import first_by
from siltstone.plans.registry import query
from siltstone.plans.search_plans import text_index
from siltstone.sources import tables
from siltstone.sources.shared import Workspace
from siltstone.sources.tables import table


@query("""SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS flagged, count(*) FILTER (WHERE toxic IS NULL) AS unchecked, round(avg(quality), 4) AS avg_quality
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def flag_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.count_if(F.col("toxic").isNull()).alias("unchecked"), F.round(F.avg("quality"), 4).alias("avg_quality"))


@query("""SELECT doc_id, coalesce(toxic = 0, true) AS assumed_clean, quality IS DISTINCT FROM 1 AS not_known_good FROM documents LEFT JOIN labels USING (doc_id)""")
def three_valued_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("assumed_clean"), (~F.col("quality").eqNullSafe(F.lit(1))).alias("not_known_good"))


_ASKED = [(1, "the"), (2, "nicht"), (3, "les")]


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT q, doc_id, round(len(list_filter(w, lambda x: x = term)) / (1.0 + ln(greatest(len(w), 1))), 6) AS score FROM d, (VALUES (1, 'the'), (2, 'nicht'), (3, 'les')) t(q, term) WHERE list_contains(w, term))
SELECT q AS query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 20""")
def auto_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.create_map(*[F.lit(x) for q, term in _ASKED for x in (term, q)])
    shares = text_index(spark, sf_dir).shares([term for _, term in _ASKED])
    scored = shares.select(numbers[F.col("term")].alias("query_id"), "doc_id", F.round("share", 6).alias("score"))
    return first_by(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], 20).select("query_id", "doc_id")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) SELECT doc_id, (i - 1)::INTEGER AS line_no, a[i] AS line FROM l, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("SELECT event_id, (ts AT TIME ZONE 'America/Toronto' AT TIME ZONE 'UTC')::TIMESTAMP AS utc FROM events")
def local_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.convert_timezone(F.lit("America/Toronto"), F.lit("UTC"), "ts").alias("utc"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, event_type AS kind FROM events""")
def json_build_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = F.to_json(F.struct(F.from_json("props", "k int").alias("props"), F.col("event_type").alias("kind")))
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(built, "props struct<k:int>, kind string").alias("o"))
    return rows.select("event_id", "o.props.k", "o.kind")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS r FROM events WHERE event_type = 'view') WHERE r = 1""")
def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = table(spark, sf_dir, "events").where("event_type = 'view'")
    return first_by(waiting, ["user_id"], [F.col("value").desc(), F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("""WITH moved AS (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0), kept AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM moved))
SELECT (SELECT count(*) FROM moved) AS moved, (SELECT count(*) FROM kept) AS kept""")
def staged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit(True).alias("poor"))
    rows = table(spark, sf_dir, "orders").join(poor, F.col("o_custkey") == F.col("k"), "left")
    staged, seen = upserts.counted(rows, "staged", moved=F.col("poor").isNotNull(), kept=F.col("poor").isNull())
    Workspace(spark, "staged").keep(staged, "rows")  # the counts come with the write
    return spark.createDataFrame([(seen.get["moved"], seen.get["kept"])], "moved bigint, kept bigint")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')""")
def presence_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, out = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    for value, how in (("1-URGENT", "left_semi"), ("5-LOW", "left_anti")):
        out = out.join(orders.where(F.col("o_orderpriority") == value), F.col("c_custkey") == F.col("o_custkey"), how)
    return out.select("c_custkey")


@query("SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name LIKE 'N%' UNION ALL SELECT 'none', s_name FROM supplier WHERE s_nationkey IS NULL")
def filtered_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where(F.col("n_name").startswith("N"))
    rows = table(spark, sf_dir, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_name", "n_name")
    return rows.unionByName(table(spark, sf_dir, "supplier").where("s_nationkey IS NULL").select(F.lit("none").alias("r_name"), F.col("s_name").alias("n_name")))


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AND lang = 'fr'")
def nested_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return table(spark, sf_dir, "documents").where("lang = 'fr'").join(good, "doc_id", "left_semi").select("doc_id", "text")


@query("SELECT b.item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(regexp_split_to_array(b.text, '[ \\n]')) >= 3 GROUP BY 1")
def passages_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage of three words or more.

    A passage's words but the first and the last stand whole in any text that holds
    it. Joined on the hash of these, of the first eight at most, and then compared
    whole: an equality join on numbers, no nested loop, and texts only for hits.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"), F.split("text", r"[ \n]").alias("w"))
    items = items.where(F.size("w") >= 3).withColumn("n", F.least(F.size("w") - 2, F.lit(8)))
    items = items.select("item_id", "passage", "n", F.xxhash64(F.expr("slice(w, 2, n)")).alias("key"))
    sizes = [r["n"] for r in items.select("n").distinct().collect()]  # eight at most
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    worded = docs.select("doc_id", F.split("text", r"[ \n]").alias("w"))
    keys = [worded.select("doc_id", F.lit(n).alias("n"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), _window_hash(n)))).alias("key")) for n in sizes]
    near = reduce(DataFrame.unionByName, keys).join(items, ["n", "key"]).select("doc_id", "item_id", "passage").distinct() if keys else items.select(F.lit(None).cast("long").alias("doc_id"), "item_id", "passage").limit(0)
    found = docs.join(near, "doc_id").where(F.contains("text", F.col("passage")))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def _window_hash(n: int) -> Callable[[Column], Column]:
    return lambda i: F.xxhash64(F.slice("w", i, n))


@query("SELECT 3 AS parliament, i AS session FROM range(1, 4) t(i)")
def values_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.inline(spark, [(3, 1), (3, 2), (3, 3)], "parliament int, session bigint")
