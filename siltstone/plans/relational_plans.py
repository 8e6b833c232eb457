"""Filters, joins, aggregates, windows, order and sets over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.strings import hostname
from siltstone.operators import latest, rollups, search
from siltstone.operators.filters import SearchFilter, optional_equals
from siltstone.plans.registry import query
from siltstone.sources import tables
from siltstone.sources.tables import table


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'""")
def filtered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = SearchFilter(level="F", party="1-URGENT", date_from="1995-01-01", date_to="1995-12-31", columns={"level": "o_orderstatus", "party": "o_orderpriority", "date": "o_orderdate"})
    return wanted.apply(table(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (1, 5, 9, 13, 77)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = SearchFilter(entities=(1, 5, 9, 5, 13, 77), columns={"entity": "c_custkey"})
    return wanted.apply(table(spark, sf_dir, "customer")).select("c_custkey", "c_mktsegment")


@query("SELECT count(*) AS n FROM customer WHERE c_name ILIKE '%00001%' AND c_name LIKE 'Customer%' AND regexp_matches(c_mktsegment, '(?i)^(auto|build)')")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where(F.col("c_name").ilike("%00001%") & F.col("c_name").startswith("Customer") & F.col("c_mktsegment").rlike("(?i)^(auto|build)"))
    return rows.where(optional_equals("c_nationkey", None)).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN regexp_matches(url, '(?i)(blog|news)') THEN 'media' WHEN regexp_matches(url, '(?i)wiki') THEN 'reference' ELSE 'other' END AS site_class, count(*) AS n FROM pages GROUP BY 1""")
def site_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("url").rlike("(?i)(blog|news)"), "media").when(F.col("url").rlike("(?i)wiki"), "reference").otherwise("other")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("site_class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def inner_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation and region have fixed sizes; Spark broadcasts them by their statistics.
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000""")
def left_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) o ON o_custkey = c_custkey AND r = 1""")
def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderdate"])
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS order_list, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def lateral_ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",")
    joined = table(spark, sf_dir, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("c_custkey", text.alias("order_list"), F.size("l").cast("long").alias("n"))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer""")
def scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    joined = table(spark, sf_dir, "customer").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "most")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return table(spark, sf_dir, "customer").join(some, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(some, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT u.user_id, k.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) k
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = k.event_type)""")
def gap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rollups.gap_matrix(events.select("user_id").distinct(), events.select("event_type").distinct(), events, "user_id", "event_type")


@query("""SELECT e.event_id, c.c_name, s.s_name FROM events e LEFT JOIN customer c ON e.event_type = 'purchase' AND c.c_custkey = e.user_id
LEFT JOIN supplier s ON e.event_type = 'view' AND s.s_suppkey = e.user_id WHERE e.event_type IN ('purchase', 'view', 'error')""")
def polymorphic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view', 'error')")
    rows = rows.join(table(spark, sf_dir, "customer"), (F.col("event_type") == "purchase") & (F.col("c_custkey") == F.col("user_id")), "left")
    return rows.join(table(spark, sf_dir, "supplier"), (F.col("event_type") == "view") & (F.col("s_suppkey") == F.col("user_id")), "left").select("event_id", "c_name", "s_name")


@query("""SELECT c.c_custkey, coalesce(x.v, 0) AS urgent_total FROM customer c LEFT JOIN (SELECT o_custkey::VARCHAR AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) x ON x.k = c.c_custkey::VARCHAR""")
def filtered_right_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    rows = table(spark, sf_dir, "customer").join(right, F.col("c_custkey").cast("string") == F.col("k"), "left")
    return rows.select("c_custkey", F.coalesce("v", F.lit(0.0)).alias("urgent_total"))


@query("""SELECT o_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 50""")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 50")
    return lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "l_linenumber", "c_name")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "event_type").limit(3)


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS large, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.counts_where(table(spark, sf_dir, "events"), ["user_id"], {"clicks": F.col("event_type") == "click", "large": F.col("value") > 50, "errors": F.col("event_type") == "error"})


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 25) AS bulk_parts FROM lineitem GROUP BY 1")
def distinct_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("bulk_parts"))


@query("SELECT o_orderpriority, coalesce(round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 1), 0) AS pct FROM orders GROUP BY 1")
def safe_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(rollups.share(F.col("o_orderstatus") == "F").alias("pct"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_key_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def ordered_distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT user_id, string_agg(event_type || ':' || event_id, ' ' ORDER BY ts, event_id) AS trail FROM events WHERE value > 80 GROUP BY 1")
def ordered_json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    text = F.array_join(F.transform(items, lambda x: F.concat(x["event_type"], F.lit(":"), x["event_id"].cast("string"))), " ")
    return table(spark, sf_dir, "events").where("value > 80").groupBy("user_id").agg(text.alias("trail"))


_HOST = "lower(regexp_replace(regexp_replace(url, '^https?://', ''), '/.*$', ''))"


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 3")
def hostname_rollup_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(hostname("url").alias("host")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(f"""WITH s AS (SELECT h FROM (SELECT DISTINCT {_HOST} AS h FROM pages) UNION SELECT 'www.' || h FROM (SELECT DISTINCT {_HOST} AS h FROM pages WHERE {_HOST} NOT LIKE 'www.%')) SELECT h AS host FROM s""")
def host_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(hostname("url").alias("h")).distinct()
    both = F.when(F.col("h").startswith("www."), F.array("h")).otherwise(F.array(F.col("h"), F.concat(F.lit("www."), "h")))
    return hosts.select(F.explode(both).alias("host")).distinct()


@query("SELECT sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END)::DECIMAL(18,2)::DOUBLE AS balance, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_custkey")
def ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'P')")
    delta = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return rows.groupBy("o_custkey").agg(F.sum(delta).cast("decimal(18,2)").cast("double").alias("balance"))


@query("""SELECT r_name, count(DISTINCT c_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, round(avg(o_totalprice), 2) AS avg_price
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def place_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


@query("""SELECT c_mktsegment, count(*) AS members, count(*) FILTER (WHERE c_name ILIKE '%1') AS chairs, count(*) FILTER (WHERE c_name ILIKE '%2') AS vice_chairs, round(avg(c_acctbal), 2) AS avg_balance FROM customer GROUP BY 1""")
def member_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("c_name").ilike("%1")).alias("chairs"), F.count_if(F.col("c_name").ilike("%2")).alias("vice_chairs"), F.round(F.avg("c_acctbal"), 2).alias("avg_balance"))


@query("SELECT count(*) AS total, count(l.quality) AS labelled, round(count(l.quality) / count(*), 4) AS ratio FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("labelled"), F.round(F.count("quality") / F.count(F.lit(1)), 4).alias("ratio"))


@query("WITH v AS (SELECT event_type, list(value ORDER BY value) AS a FROM events GROUP BY 1) SELECT event_type, a[least(floor(len(a) * 0.5::DOUBLE), len(a) - 1)::BIGINT + 1] AS p50, a[least(floor(len(a) * 0.95::DOUBLE), len(a) - 1)::BIGINT + 1] AS p95 FROM v")
def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.index_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents ORDER BY doc_id LIMIT 300) SELECT (r - 1) // 10 AS bucket, count(*) AS n, string_agg(doc_id::VARCHAR, chr(10) ORDER BY r) AS body FROM c GROUP BY 1")
def report_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    return rollups.bucketed(docs, [F.col("doc_id")], 10, "name")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) SELECT c_mktsegment, c_custkey, c_acctbal, rn FROM r WHERE rn <= 4""")
def top_m_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), F.col("c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 4").select("c_mktsegment", "c_custkey", "c_acctbal", "rn")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n = 1")
def window_uniqueness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    return table(spark, sf_dir, "orders").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))).where("n = 1").select("o_orderkey", "o_custkey")


@query("SELECT s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 1000 THEN 1 ELSE 2 END AS priority FROM supplier ORDER BY priority, s_nationkey, s_name LIMIT 25")
def case_rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("s_acctbal") < 0, 0).when(F.col("s_acctbal") < 1000, 1).otherwise(2)
    return table(spark, sf_dir, "supplier").withColumn("priority", order).orderBy("priority", "s_nationkey", "s_name").limit(25).select("s_name", "s_nationkey", "priority")


@query("SELECT c_custkey, last_order FROM (SELECT c_custkey, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ORDER BY last_order DESC NULLS LAST, c_custkey LIMIT 40")
def nulls_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    rows = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.orderBy(F.col("last_order").desc_nulls_last(), "c_custkey").select("c_custkey", "last_order").limit(40)


@query("SELECT user_id, (max(struct_pack(a := event_type, b := event_id))).a AS kind, (max(struct_pack(a := event_type, b := event_id))).b AS event_id FROM events GROUP BY 1")
def greatest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("event_type", "event_id")).alias("m")).select("user_id", F.col("m.event_type").alias("kind"), F.col("m.event_id").alias("event_id"))


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS latest_order FROM orders GROUP BY 1")
def latest_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("latest_order"))


@query("""WITH u AS (SELECT c_nationkey AS nation, 0 AS pri, c_custkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier)
SELECT nation, pri, k FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY pri, k) AS rn FROM u) WHERE rn = 1""")
def union_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"), F.lit(0).alias("pri"), F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit(1).alias("pri"), F.col("s_suppkey").alias("k"))
    return latest.first_by(a.unionByName(b), ["nation"], [F.col("pri"), F.col("k")])


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("""WITH p AS (SELECT least(a.c_custkey, b.c_custkey) AS a, greatest(a.c_custkey, b.c_custkey) AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND floor(a.c_acctbal / 50) = floor(b.c_acctbal / 50) WHERE a.c_custkey <> b.c_custkey)
SELECT DISTINCT a, b FROM p""")
def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators.resolve import pairs_within

    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 50).alias("bin"), "c_custkey")
    return pairs_within(rows, ["c_nationkey", "c_mktsegment", "bin"], "c_custkey", "a", "b")


@query("SELECT unnest([1, 2, 3]) AS id, unnest(['a', 'b', 'c']) AS tag")
def unnest_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tables.inline(spark, [([1, 2, 3], ["a", "b", "c"])], "i array<int>, t array<string>")
    return one.select(F.inline(F.arrays_zip("i", "t"))).toDF("id", "tag")


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, 'k' AS name FROM events")
def json_object_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "k"))
    return rows.where("name = 'k'").select("event_id", F.col("k").cast("int").alias("k"), "name")


@query("SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL AND year(o_orderdate) BETWEEN 1900 AND 2100 GROUP BY 1")
def by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").where(y.between(1900, 2100)).groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, (5 + ceil(least(count(*), 300) / 10.0))::BIGINT AS cost FROM orders GROUP BY 1")
def report_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("o_custkey", rollups.report_cost(F.col("n")).alias("cost"))


@query("""WITH due AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1) SELECT user_id, last_ts FROM due WHERE last_ts IS NULL OR last_ts < TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 48 HOURS""")
def due_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return tables.due(last.withColumn("last_ts", F.col("last_ts").cast("timestamp")), "last_ts", "2024-01-29", 48).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("""WITH d AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) SELECT user_id, CASE WHEN user_id % 3 = 0 THEN seen < TIMESTAMP '2024-01-30' - INTERVAL 1 DAY WHEN user_id % 3 = 1 THEN seen < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY ELSE false END AS due FROM d""")
def cadence_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    due = F.when(F.col("user_id") % 3 == 0, F.col("seen") < now - F.expr("INTERVAL 1 DAY")).when(F.col("user_id") % 3 == 1, F.col("seen") < now - F.expr("INTERVAL 7 DAY")).otherwise(False)
    return seen.select("user_id", due.alias("due"))


@query("SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), [F.col("c_nationkey"), F.col("c_custkey")], 3, 20)
