"""Sources and outputs: tables written in a feed's format, read back and held against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import hosting, strings
from siltstone.operators import bills, chunks, geo, outputs, resolve, retrieval, rollups, transcripts
from siltstone.plans.registry import query
from siltstone.sources.networks import network_lookup
from siltstone.sources import tables
from siltstone.sources.shared import shared_folder
from siltstone.sources.tables import table


def _landed(spark: SparkSession, rows: DataFrame, label: str) -> str:
    """The texts of ``rows`` (one column ``value``) as files."""
    folder = shared_folder(spark, label)
    rows.write.text(folder)
    return folder


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def json_page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages of a JSON service, a file each with a list of objects."""
    one, folder = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), shared_folder(spark, "pages")
    pages = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 500).alias("page")).agg(F.collect_list(one).alias("objects"))
    pages.select(F.to_json(F.struct("objects", F.lit(None).cast("string").alias("next_url"))).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return tables.json_pages(spark, folder)


@query("SELECT c_custkey AS id, unnest([c_name, c_mktsegment]) AS url FROM customer")
def json_line_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON among lines that are none."""
    good = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.array("c_name", "c_mktsegment").alias("url")))
    lines = table(spark, sf_dir, "customer").select(F.explode(F.array(good, F.lit("{not json"), F.lit(""))).alias("value"))
    return tables.json_lines(spark, _landed(spark, lines, "lines"), "id bigint, url array<string>", explode="url")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit export read back."""
    folder = shared_folder(spark, "csv")
    outputs.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), folder)
    return tables.csv_feed(spark, folder, "p_partkey bigint, p_name string, p_retailprice double")


@query("SELECT doc_id, quality FROM labels")
def label_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "labels")
    outputs.write_json_lines(table(spark, sf_dir, "labels").select("doc_id", "quality"), folder)
    return tables.json_lines(spark, folder, "doc_id bigint, quality int")


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")
def refreshed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table, written twice."""
    folder, customers = shared_folder(spark, "view"), table(spark, sf_dir, "customer")
    for rows in (customers.where("c_acctbal > 0"), customers):
        view = outputs.refresh(rows.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n")), folder)
    return view


@query("SELECT n_name AS title, n_nationkey AS k FROM nation")
def rss_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of items, rendered and read again."""
    rows = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("k"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    items = outputs.rss_items(rows, "n_name", "k", "n_name", "at", keep=["at"])
    feed = outputs.rss_channel(items, "Nations & more", "https://example.org", "all", "at")
    found = tables.xml_feed(spark, _landed(spark, feed.select(F.col("feed").alias("value")), "rss"))
    return found.select("title", F.col("link").cast("int").alias("k"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def graphql_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    answer = table(spark, sf_dir, "region").agg(F.collect_list(one).alias("nodes")).select(F.to_json(F.struct(F.struct("nodes").alias("data"))).alias("value"))
    return tables.graphql_nodes(spark, _landed(spark, answer, "graphql"), "data.nodes", "id int, name string")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR END AS code FROM nation")
def sparql_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda c: F.struct(F.lit("literal").alias("type"), c.cast("string").alias("value"))
    one = F.struct(value(F.col("n_name")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, value(F.col("n_nationkey"))).alias("code"))
    answer = table(spark, sf_dir, "nation").agg(F.collect_list(one).alias("bindings")).select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("value"))
    return tables.sparql_rows(spark, _landed(spark, answer, "sparql"), ["name", "code"])


@query("SELECT n_name AS name, (n_nationkey + 1)::DOUBLE AS lng FROM nation")
def boundary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of boundaries, landed and measured."""
    from siltstone.operators.geo import with_facts

    k = F.col("n_nationkey").cast("double")
    ring = F.array(F.array(k, F.lit(0.0)), F.array(k + 2, F.lit(0.0)), F.array(k + 2, F.lit(1.0)), F.array(k, F.lit(1.0)), F.array(k, F.lit(0.0)))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.col("n_name").alias("name")).alias("properties"))
    answer = table(spark, sf_dir, "nation").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    rows = with_facts(tables.geojson_features(spark, _landed(spark, answer, "geojson")), "geometry")
    return rows.select(F.col("properties")["name"].alias("name"), F.round("geo.lng", 6).alias("lng"))


@query("""WITH a AS (SELECT event_id, (event_id * 7919) % 16777216 AS n FROM events), r AS (SELECT s_suppkey AS k, s_suppkey * 150000 AS lo, s_suppkey * 150000 + 99999 AS hi FROM supplier)
SELECT event_id, k AS network FROM a LEFT JOIN r ON n BETWEEN lo AND hi""")
def address_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses 0.x.y.z against the networks of suppliers, some of which span several /16."""
    n = (F.col("event_id") * 7919) % 16777216
    ip = F.concat_ws(".", F.lit("0"), *[(F.shiftright(n, s) % 256).cast("string") for s in (16, 8, 0)])
    nets = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 150000).alias("first"), (F.col("s_suppkey") * 150000 + 99999).alias("last"), F.col("s_suppkey").alias("network"))
    return tables.geo_lookup(table(spark, sf_dir, "events").select("event_id", ip.alias("ip")), nets, "ip").select("event_id", "network")


@query("""WITH a AS (SELECT c_custkey, c_custkey % 256 AS x, (c_custkey // 256) % 256 AS y FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN x < 16 THEN 'doc' WHEN x < 128 AND y % 4 = 1 THEN 'low' WHEN x < 128 THEN 'half' ELSE 'all' END WHEN c_custkey % 3 = 1 THEN CASE WHEN x = 10 THEN 'ten' ELSE 'every' END END AS network FROM a""")
def networks_of_both_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' addresses of version 6 and 4, and texts that are none, against networks that lie in each other."""
    k = F.col("c_custkey")
    x, y = k % 256, F.floor(k / 256) % 256
    wide = F.format_string("2001:db8:%02x%02x::%x", x, y, k % 65536)
    ip = F.when(k % 3 == 0, wide).when(k % 3 == 1, F.format_string("%d.%d.0.7", x, y)).otherwise("no address")
    nets = [("2001:db8::/32", "all"), ("2001:db8::/33", "half"), ("2001:db8:0000::/36", "doc"), ("0.0.0.0/0", "every"), ("10.0.0.0/8", "ten"), ("no network", "none")]
    nets += [(f"2001:db8:{a:02x}{b:02x}::/48", "low") for a in range(16, 128) for b in range(1, 256, 4)]
    known = spark.createDataFrame(nets, "network string, name string")
    found = network_lookup(table(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip")), known, "ip")
    return found.select("c_custkey", F.col("name").alias("network"))


@query("SELECT max(o_orderdate) AS seen_to FROM orders")
def feed_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.newest(table(spark, sf_dir, "orders"), "o_orderdate")


@query("""WITH t AS (SELECT c_custkey, upper(substr('abceghjk', (c_custkey % 8)::INTEGER + 1, 1)) || (c_custkey % 10) || 'A' AS a, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE (c_custkey % 10) || 'Z' || (c_nationkey % 10) END AS b FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN a || b END AS code FROM t""")
def postal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, w = F.col("c_custkey"), F.col("c_nationkey")
    digit = lambda c: (c % 10).cast("string")
    first = F.concat(F.substring(F.lit("abceghjk"), (k % 8).cast("int") + 1, F.lit(1)), digit(k), F.lit("a"))
    text = F.concat(first, F.lit(" "), F.when(k % 3 == 0, "x").otherwise(F.concat(digit(k), F.lit("z"), digit(w))))
    return table(spark, sf_dir, "customer").select("c_custkey", strings.postal_code(text).alias("code"))


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS marked FROM documents""")
def marked_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda code: F.concat(F.lit('<p data-originallang="'), code, F.lit('">x</p>'))
    page = F.concat(mark(F.col("lang")), mark(F.upper("lang")), mark(F.lit("en")))
    return table(spark, sf_dir, "documents").select("doc_id", strings.plurality_language(page).alias("marked"))


@query("""SELECT s_suppkey, round(CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE least(1, greatest(0, CASE WHEN s_suppkey % 4 = 0 THEN 0.60 + 0.20 + 0.15 WHEN s_suppkey % 4 = 1 THEN least(0.60 + 0.15, 0.55) ELSE 0.60 * 0.5 END)) END::DOUBLE, 4) AS score FROM supplier""")
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    title = F.when(k == 3, "Somebody else").when(k == 2, "Ann Other").otherwise("Ann Tall")
    bio = F.when(k == 0, "member of the house for york").when(k == 1, "lives in york").otherwise("")
    score = strings.profile_score(F.lit("Ann Tall"), F.lit(None).cast("string"), F.lit("York"), F.lit(False), F.lit(False), title, bio, ["member of"], ["parody"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(score, 4).alias("score"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 11 WHEN 1 THEN 13 ELSE 11 END AS score FROM supplier""")
def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    host = F.when(k == 2, "oakville.org").otherwise("annatall.ca")
    near = F.when(k == 0, "").when(k == 1, 'website rel="external"').otherwise("her web site")
    score = strings.site_score(host, F.when(k == 1, "donate").otherwise(""), near, F.array(F.lit("anna"), F.lit("tall")), F.array(F.lit("oakville")), ["donate"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", score.alias("score"))


@query("""SELECT o_orderkey, i - 1 AS sequence, CASE i WHEN 1 THEN 'first_reading' WHEN 2 THEN 'committee' ELSE 'royal_assent' END AS stage, (o_orderdate + INTERVAL (i - 1) DAY)::DATE AS day FROM orders, (SELECT unnest([1, 2, 3]) AS i)""")
def bill_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills' pages: three stages each, dates in two forms."""
    day = lambda n, form: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), form)
    row = lambda stage, when: F.concat(F.lit(f"<tr><td>{stage}</td><td>"), when, F.lit("</td></tr>"))
    page = F.concat(row("First Reading", day(0, "yyyy-MM-dd")), F.lit("<li>no stage here</li>"), row("Referred to Committee", day(1, "MMMM d, yyyy")), row("<b>Royal</b> Assent", day(2, "yyyy-MM-dd")))
    return chunks.stage_events(table(spark, sf_dir, "orders").select("o_orderkey", page.alias("html")), "o_orderkey")


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS sequence, 'Mr. ' || role AS speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM conversations""")
def plain_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts in plain lines, with headings between the turns."""
    line = F.concat(F.lit("A HEADING\nMr. "), F.col("role"), F.lit(": "), strings.collapse("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.alias("text"))
    return chunks.line_turns(pages, "conv_id").select("conv_id", "sequence", "speaker", "body")


_SITES = "SELECT c_mktsegment AS party, o_custkey AS id, o_custkey % 400 AS host, o_orderdate AS seen, o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 6 + 1)::INTEGER END AS tier, o_orderpriority AS provider FROM orders JOIN customer ON o_custkey = c_custkey"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scans of sites that members share."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return rows.select(F.col("c_mktsegment").alias("party"), F.col("o_custkey").alias("id"), (F.col("o_custkey") % 400).alias("host"), F.col("o_orderdate").alias("at"), k.alias("k"), F.when(k % 7 > 0, k % 6 + 1).cast("int").alias("tier"), F.col("o_orderpriority").alias("provider"))


@query(f"""WITH s AS ({_SITES}), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY party, host ORDER BY seen DESC NULLS LAST, k DESC) AS r FROM s) WHERE r = 1),
a AS (SELECT party, count(*) AS sites, count(*) FILTER (WHERE tier IN (1, 2)) AS home, count(*) FILTER (WHERE tier = 3) AS cdn, count(*) FILTER (WHERE tier = 4) AS us, count(*) FILTER (WHERE tier = 5) AS "foreign" FROM h GROUP BY 1),
m AS (SELECT c_mktsegment AS party, count(*) AS members, count(*) FILTER (WHERE c_custkey NOT IN (SELECT id FROM s)) AS no_site FROM customer GROUP BY 1),
p AS (SELECT party, members, sites, home, cdn, us, "foreign", no_site, floor(100.0::DOUBLE * home / sites + 0.5)::INTEGER AS pct FROM m JOIN a USING (party))
SELECT *, CASE WHEN pct >= 85 THEN 'A' WHEN pct >= 70 THEN 'B' WHEN pct >= 50 THEN 'C' WHEN pct >= 30 THEN 'D' ELSE 'F' END AS grade FROM p""")
def party_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("party"), F.col("c_custkey").alias("id"))
    return rollups.party_report(members, _sites(spark, sf_dir), "party", "id", "host", "at", "k", "tier")


@query(f"""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY party, host ORDER BY seen DESC NULLS LAST, k DESC) AS r FROM ({_SITES})) WHERE r = 1), c AS (SELECT party, provider, count(*) AS n FROM h GROUP BY ALL)
SELECT party, provider, n FROM (SELECT *, row_number() OVER (PARTITION BY party ORDER BY n DESC, provider) AS r FROM c) WHERE r <= 3""")
def top_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.top_values(_sites(spark, sf_dir), "party", "host", "at", "k", "provider", most=3)


@query(f"""SELECT id, max(coalesce(tier, 6)) AS worst, min(coalesce(tier, 6)) AS best, count(*) FILTER (WHERE tier IN (1, 2)) AS home, count(*) FILTER (WHERE tier = 3) AS cdn, count(*) FILTER (WHERE tier = 4) AS us, count(*) FILTER (WHERE tier = 5) AS "foreign", string_agg(k || ':' || coalesce(tier, 6) || ':' || host, ',' ORDER BY k) AS sites FROM ({_SITES}) GROUP BY 1""")
def member_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollups.member_sites(_sites(spark, sf_dir), "id", "tier", "k", ["host"])
    return rows.withColumn("sites", F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["k"].cast("string"), s["tier"].cast("string"), s["host"].cast("string"))), ","))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 < 6 THEN (['Canadian Sovereign', 'Canadian Soil', 'CDN-Fronted', 'US-Hosted', 'Other Foreign', 'Unknown'])[(s_suppkey % 7)::INTEGER + 1] ELSE 'Unknown' END AS label FROM supplier""")
def tier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", hosting.tier_label((F.col("s_suppkey") % 7 + 1).cast("int")).alias("label"))


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_name) AS full_name, lower(split_part(p_name, ' ', -1)) AS last FROM part), f AS (SELECT full_name, count(DISTINCT k) AS n, min(k) AS k FROM p GROUP BY 1), l AS (SELECT last, count(DISTINCT k) AS n, min(k) AS k FROM p GROUP BY 1),
m AS (SELECT k AS id, CASE WHEN k % 2 = 0 THEN full_name ELSE last END AS name, last FROM p WHERE k % 5 <> 0)
SELECT p.k AS id, CASE WHEN f.n = 1 THEN f.k WHEN f.n IS NULL AND l.n = 1 THEN l.k END AS who FROM p LEFT JOIN m ON m.id = p.k LEFT JOIN f ON f.full_name = m.name LEFT JOIN l ON l.last = m.last""")
def presiding_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chairs named by their full or their last name, and lines without a name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("full_name"), F.lower(strings.last_token("p_name")).alias("last"))
    name = F.when(F.col("k") % 2 == 0, F.col("full_name")).otherwise(F.col("last"))
    said = p.select(F.col("k").alias("id"), F.when(F.col("k") % 5 == 0, "The Speaker").otherwise(F.concat(F.lit("The Acting Speaker (Mr. "), name, F.lit(")"))).alias("line"))
    return resolve.presiding(said, p, "id", "k", "line", "full_name", "last").select("id", F.col("k").alias("who"))


@query("""SELECT DISTINCT least(o_custkey, o_orderkey % 200) AS a, greatest(o_custkey, o_orderkey % 200) AS b FROM orders WHERE o_custkey <> o_orderkey % 200 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey % 200 IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a model named, of which some ids were never in its input."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 200).alias("b"))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return resolve.valid_pairs(pairs, "a", "b", known, "c_custkey")


@query("""WITH q AS (SELECT c_custkey AS q, c_nationkey % 4 AS cat FROM customer), h AS (SELECT o_custkey AS q, count(*) FILTER (WHERE o_orderstatus = 'F') AS rel, count(*) FILTER (WHERE o_orderstatus = 'F' AND r <= 20) AS got,
sum(CASE WHEN o_orderstatus = 'F' AND r <= 10 THEN 1.0 / log2(r + 1) ELSE 0 END) AS dcg FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY 1),
e AS (SELECT q, round(dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(rel, 10) + 1) t(i)), 6) AS ndcg, round(got / rel, 6) AS recall FROM h WHERE rel > 0)
SELECT 'c' || cat AS category, count(*) AS n, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall FROM e JOIN q USING (q) GROUP BY 1 UNION ALL SELECT '*', count(*), round(avg(ndcg), 4), round(avg(recall), 4) FROM e""")
def quality_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rankings by price, the filled ones relevant; customers are the queries."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), "o_totalprice", "o_orderstatus")
    ranking = orders.select("q", "item", F.row_number().over(Window.partitionBy("q").orderBy(F.col("o_totalprice").desc(), "item")).alias("r"))
    relevant = orders.where("o_orderstatus = 'F'").select("q", "item")
    found = retrieval.ranking_quality(ranking, relevant, "q", "item", "r")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"), F.concat(F.lit("c"), (F.col("c_nationkey") % 4).cast("string")).alias("category"))
    return retrieval.quality_means(found, asked, "q", "category")


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) - 300 * (o_orderkey % 3 = 0)::INTEGER BETWEEN 1900 AND 2100 THEN year(o_orderdate) - 300 * (o_orderkey % 3 = 0)::INTEGER ELSE 2024 END::INTEGER AS y FROM orders""")
def sane_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years out of range give way to the year of the debate."""
    at = F.when(F.col("o_orderkey") % 3 == 0, F.add_months("o_orderdate", -3600)).otherwise(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(strings.sane_date(at, F.lit("2024-05-01").cast("date"))).alias("y"))


@query("""SELECT n_regionkey AS region, count(*) AS cells, count(*) * 2 + 2 AS sides FROM nation GROUP BY 1""")
def region_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as cells in a row; the borders between them are dissolved."""
    at = (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("double")
    cells = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), at.alias("x"))
    ring = F.array(*[F.array(F.col("x") + dx, F.lit(y)) for dx, y in ((0, 0.0), (1, 0.0), (1, 1.0), (0, 1.0), (0, 0.0))])
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    outlines = geo.dissolved(cells.select("region", shape.alias("g")), ["region"], "g")
    counted = cells.groupBy("region").agg(F.count(F.lit(1)).alias("cells"))
    points = F.from_json(F.get_json_object("outline", "$.coordinates"), "array<array<array<array<double>>>>")
    return outlines.join(counted, "region").select("region", "cells", (F.size(points[0][0]) - 1).cast("long").alias("sides"))


def _box(x: Column, w: Column, h: Column) -> Column:
    """A box on the x axis as GeoJSON."""
    points = [(x, F.lit(0.0)), (x + w, F.lit(0.0)), (x + w, h), (x, h), (x, F.lit(0.0))]
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(a.cast("double"), b.cast("double")) for a, b in points])).alias("coordinates")))


@query("""WITH b AS (SELECT c_nationkey AS k, (c_custkey * 37) % 997 AS x, 1 + c_custkey % 5 AS w FROM customer), o AS (SELECT *, max(x + w) OVER (PARTITION BY k ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY x, w ROWS UNBOUNDED PRECEDING) AS n FROM o), m AS (SELECT k, n, min(x) AS a, max(x + w) AS b FROM i GROUP BY 1, 2)
SELECT k AS nation, count(*)::INTEGER AS parts, round(sum(b - a) * 2.0, 3)::DOUBLE AS area FROM m GROUP BY 1""")
def overlapping_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers as boxes that overlap, touch and lie in each other, dissolved."""
    k = F.col("c_custkey")
    boxes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), _box((k * 37) % 997, 1 + k % 5, F.lit(2.0)).alias("g"))
    out = geo.dissolved(boxes, ["nation"], "g", block_points=100)
    shapes = F.from_json(F.get_json_object("outline", "$.coordinates"), "array<array<array<array<double>>>>")
    return out.select("nation", F.size(shapes).alias("parts"), F.round(geo.planar_area("outline"), 3).alias("area"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 2 END AS parts, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 4.0 / 2 WHEN 1 THEN p_size * 4.0 + 1 ELSE p_size * 4.0 END, 3)::DOUBLE AS area FROM part""")
def repaired_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow-ties, boxes with a hole outside, and boxes with a spike and a point given twice."""
    w, n = F.col("p_size").cast("double"), F.lit(0.0)
    pair = lambda a, b: F.array(a, F.lit(float(b)) if not hasattr(b, "cast") else b)
    tie = F.array(F.array(pair(n, 0), pair(w, 4), pair(w, 0), pair(n, 4), pair(n, 0)))
    box = [pair(n, 0), pair(w, 0), pair(w, 4), pair(n, 4), pair(n, 0)]
    apart = F.array(F.array(*box), F.array(*[pair(n - x, y) for x, y in ((5, 0), (4, 0), (4, 1), (5, 1), (5, 0))]))
    spiked = F.array(F.array(*box[:2], box[1], pair(w, 2), pair(w + 3, 2), pair(w, 2), *box[2:]))
    rings = F.when(F.col("p_partkey") % 3 == 0, tie).when(F.col("p_partkey") % 3 == 1, apart).otherwise(spiked)
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))
    out = geo.repaired(table(spark, sf_dir, "part").select("p_partkey", shape.alias("g")), "g")
    shapes = F.from_json(F.get_json_object("valid", "$.coordinates"), "array<array<array<array<double>>>>")
    return out.select("p_partkey", F.size(shapes).alias("parts"), F.round(geo.planar_area("valid"), 3).alias("area"))


@query("""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS body FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS sequence, CASE WHEN conv_id % 2 = 0 THEN 'Hon. ' ELSE 'Mr. ' END || role AS speaker, body, 'Debate' AS section, CASE WHEN conv_id % 2 = 0 THEN 'speaker starts' ELSE 'printed' END AS dialect FROM c WHERE body <> ''""")
def transcripts_of_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts of two styles: pages with classes, and a print with its page numbers and running titles."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    html = F.concat(F.lit('<p class="speakerStart"><span id="para"/><strong>Hon. '), "role", F.lit(":</strong> "), strings.xml_escape(F.coalesce("text", F.lit(""))), F.lit('</p><p class="procedure">(Applause.)</p>'))
    print_ = F.concat(F.lit("Mr. "), "role", F.lit(": "), said, F.lit("\n\n117\nRecord Hansard\nApril 16, 2026\n[Some applause]\n"))
    each = table(spark, sf_dir, "conversations").withColumn("part", F.when(F.col("conv_id") % 2 == 0, html).otherwise(print_))
    whole = each.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("body"))
    opening = F.when(F.col("conv_id") % 2 == 0, "<h2>Debate</h2>").otherwise("Title: a day\nhead:\n\n116\nDebate\n")
    pages = whole.select("conv_id", F.concat(opening, "body").alias("page"))
    return transcripts.transcript_turns(pages, "conv_id", "page").select("conv_id", "sequence", "speaker", "body", "section", "dialect")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, 0 AS sequence, 'first_reading' AS stage, d AS day FROM o UNION ALL SELECT o_orderkey, 1, 'committee', (d + INTERVAL 40 DAY)::DATE FROM o
UNION ALL SELECT o_orderkey, 2, 'withdrawn', NULL FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 2 + (o_orderkey % 2 = 0)::INTEGER, 'royal_assent', (d + INTERVAL 90 DAY)::DATE FROM o""")
def stages_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bills' pages: a legend, a committee that is there twice, rows that are no stage."""
    day = lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "MMMM d, yyyy")
    row = lambda label, body: F.concat(F.lit(f"<tr><td>{label}</td><td>"), body if isinstance(body, Column) else F.lit(body), F.lit("</td></tr>"))
    gone = F.when(F.col("o_orderkey") % 2 == 0, row("Withdrawn", "")).otherwise("")
    page = F.concat(row("First Reading", ""), row("Royal Assent", "-"), row("First Reading", day(0)), row("Private &amp; Local Bills", day(40)), row("Law Amendments Committee", F.concat(F.lit("<a>"), day(40), F.lit("</a>"))), row("Sponsor", day(41)), gone, row("Royal Assent", day(90)))
    return bills.page_stages(table(spark, sf_dir, "orders").select("o_orderkey", page.alias("html")), "o_orderkey").select("o_orderkey", "sequence", "stage", "day")


@query("""WITH c AS (SELECT c_custkey, list(o_orderdate::DATE ORDER BY o_orderdate, o_orderkey) AS d FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
f AS (SELECT c_custkey, list_filter(d, lambda x, i: i = 1 OR x <> d[i - 1]) AS d FROM c), e AS (SELECT c_custkey, unnest(d[1:6]) AS day, unnest(range(0, len(d[1:6]))) AS sequence FROM f)
SELECT c_custkey // 5000 AS page, (c_custkey % 5000)::VARCHAR AS bill, sequence::INTEGER AS sequence, (['first_reading', 'second_reading', 'committee', 'third_reading', 'royal_assent', 'in_effect'])[sequence + 1] AS stage, day FROM e""")
def stages_of_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bills of printed status tables, their orders' days as dates; a table has five thousand numbers."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    days = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: F.date_format(x["o_orderdate"], "MMM. d, yyyy")), "\n")
    each = orders.groupBy("c_custkey").agg(F.concat((F.col("c_custkey") % 5000).cast("string"), F.lit(" The Act\nRoyal\nAssent\n"), days).alias("part"))
    pages = each.groupBy(F.floor(F.col("c_custkey") / 5000).alias("page")).agg(F.concat(F.lit("Bill Status 2025-12\nSTATUS OF BILLS\n"), F.array_join(F.collect_list("part"), "\nGOVERNMENT BILLS\n")).alias("text"))
    return bills.printed_stages(pages, "page").select("page", "bill", "sequence", "stage", "day")
