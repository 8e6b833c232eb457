"""Latest states, changes between them, report cards, and dated lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import hosting
from siltstone.operators import changes, intervals, latest, resolve, rollups, upserts
from siltstone.operators.stored import StoredTable
from siltstone.plans.registry import query
from siltstone.sources import tables
from siltstone.sources.shared import shared_folder
from siltstone.sources.tables import table

_LAST = "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query(f"SELECT user_id, event_id, ts, event_type, value FROM ({_LAST})")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", ["event_id", "ts", "event_type", "value"])


@query(f"SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM ({_LAST}) GROUP BY 1")
def latest_tier_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", ["event_type"])
    counted = last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("t"))
    return counted.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(F.lit(100.0) * F.col("n") / F.col("t"), 2).alias("pct"))


@query(f"SELECT event_type, count(*) AS n FROM ({_LAST}) WHERE value > 20 GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def latest_top_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", ["event_type", "value"])
    return last.where("value > 20").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "event_type").limit(3)


@query("""WITH l AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT user_id, event_id, old, event_type AS new, CASE WHEN event_type = 'error' THEN 'major' ELSE 'info' END AS severity FROM l WHERE old IS NOT NULL AND old IS DISTINCT FROM event_type""")
def consecutive_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.with_previous(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).where("prev IS NOT NULL")
    level = F.when(F.col("event_type") == "error", "major").otherwise("info")
    change = changes.field_change(F.col("prev.event_type"), F.col("event_type"), "state_changed", level)
    return changes.exploded(rows, [change], ["user_id", "event_id"]).select("user_id", "event_id", "old", "new", "severity")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scans of a site: every fact is a function of the event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("site_id"), F.struct("ts", "event_id").alias("scanned_at"), F.when(k % 5 > 0, F.concat(F.lit("C"), (k % 3).cast("string"))).alias("country"), F.lit(None).cast("string").alias("city"),
        F.col("event_type").alias("provider"), F.when(k % 7 > 0, k % 6 + 1).alias("tier"), F.lit(None).cast("string").alias("cdn"), F.array((k % 2).cast("string"), (k % 4).cast("string")).alias("ips"),
    )


@query("""WITH s AS (SELECT user_id, ts, event_id, json_extract_string(props, '$.k')::INTEGER AS k, event_type FROM events),
f AS (SELECT user_id, ts, event_id, CASE WHEN k % 5 > 0 THEN 'C' || (k % 3) END AS country, event_type AS provider, CASE WHEN k % 7 > 0 THEN k % 6 + 1 END AS tier,
  CASE WHEN k % 2 = k % 4 THEN (k % 2)::VARCHAR ELSE least(k % 2, k % 4) || ',' || greatest(k % 2, k % 4) END AS ips FROM s),
l AS (SELECT *, lag(country) OVER w AS c0, lag(provider) OVER w AS p0, lag(tier) OVER w AS t0, lag(ips) OVER w AS i0, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT 'country_changed' AS kind, 'major' AS severity, count(*) AS n FROM l WHERE n > 1 AND coalesce(c0, '') <> coalesce(country, '')
UNION ALL SELECT 'provider_changed', 'major', count(*) FROM l WHERE n > 1 AND p0 <> provider
UNION ALL SELECT 'tier_changed', 'major', count(*) FROM l WHERE n > 1 AND abs(t0 - tier) >= 2
UNION ALL SELECT 'tier_changed', 'notable', count(*) FROM l WHERE n > 1 AND abs(t0 - tier) = 1
UNION ALL SELECT 'ip_changed', 'info', count(*) FROM l WHERE n > 1 AND i0 <> ips) SELECT * FROM x WHERE n > 0""")
def scan_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.scan_changes(_scans(spark, sf_dir)).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


_FACTS = {"country": "CASE WHEN k % 5 > 0 THEN 'C' || (k % 3) END", "city": "CASE WHEN k % 3 > 0 THEN 'T' || (k % 4) END", "provider": "event_type", "cdn": "CASE WHEN k % 6 > 1 THEN 'N' || (k % 2) END", "cms": "'M' || (k % 5)", "tls_issuer": "CASE WHEN k % 7 <> 2 THEN 'I' || (k % 2) END"}
_LEVELS = {"country": "major", "city": "notable", "provider": "major", "cdn": "info", "cms": "info", "tls_issuer": "info"}


@query(f"""WITH f AS (SELECT user_id, ts, event_id, {", ".join(f"{v} AS {c}" for c, v in _FACTS.items())}, CASE WHEN k % 7 > 0 THEN k % 6 + 1 END AS tier, list_sort(list_distinct([(k % 2)::VARCHAR, (k % 4)::VARCHAR])) AS ips
  FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)),
l AS (SELECT *, {", ".join(f"lag({c}) OVER w AS old_{c}" for c in [*_FACTS, "tier", "ips"])}, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS ({" UNION ALL ".join(f"SELECT event_id, '{c}_changed' AS kind, '{_LEVELS[c]}' AS severity, coalesce(old_{c}, '') AS old, coalesce({c}, '') AS new, NULL::VARCHAR AS added, NULL::VARCHAR AS removed FROM l WHERE n > 1 AND coalesce(old_{c}, '') <> coalesce({c}, '')" for c in _FACTS)}
UNION ALL SELECT event_id, 'tier_changed', CASE WHEN abs(old_tier - tier) >= 2 THEN 'major' ELSE 'notable' END, old_tier::VARCHAR, tier::VARCHAR, NULL, NULL FROM l WHERE n > 1 AND old_tier <> tier
UNION ALL SELECT event_id, 'ip_changed', 'info', array_to_string(old_ips, ','), array_to_string(ips, ','), array_to_string(list_filter(ips, lambda i: NOT list_contains(old_ips, i)), ','), array_to_string(list_filter(old_ips, lambda i: NOT list_contains(ips, i)), ',') FROM l WHERE n > 1 AND old_ips <> ips)
SELECT event_id, kind, severity, old, new, coalesce(added, '') AS added, coalesce(removed, '') AS removed FROM x""")
def scan_changes_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans in which every fact changes now and then, with what each set of addresses gained and lost."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = lambda n: (F.col("k") % n).cast("string")
    scans = e.select(
        F.col("user_id").alias("site_id"), F.struct("ts", "event_id").alias("scanned_at"), F.when(F.col("k") % 5 > 0, F.concat(F.lit("C"), k(3))).alias("country"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("T"), k(4))).alias("city"), F.col("event_type").alias("provider"),
        F.when(F.col("k") % 6 > 1, F.concat(F.lit("N"), k(2))).alias("cdn"), F.concat(F.lit("M"), k(5)).alias("cms"), F.when(F.col("k") % 7 != 2, F.concat(F.lit("I"), k(2))).alias("tls_issuer"), F.when(F.col("k") % 7 > 0, F.col("k") % 6 + 1).alias("tier"), F.array(k(2), k(4)).alias("ips"),
    )
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return changes.scan_changes(scans).select(F.col("scanned_at.event_id").alias("event_id"), "kind", "severity", "old", "new", text("added"), text("removed"))


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS party FROM customer WHERE c_custkey % 10 <> 3),
w AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN c_name || ' Jr' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS party FROM customer WHERE c_custkey % 10 <> 4)
SELECT coalesce(o.id, w.id) AS id, kind FROM o FULL JOIN w ON o.id = w.id, LATERAL (SELECT unnest([CASE WHEN o.id IS NULL THEN 'newly_elected' END, CASE WHEN w.id IS NULL THEN 'retired' END,
CASE WHEN o.id IS NOT NULL AND w.id IS NOT NULL AND o.name <> w.name THEN 'name_changed' END, CASE WHEN o.id IS NOT NULL AND w.id IS NOT NULL AND o.party <> coalesce(nullif(w.party, ''), '') THEN 'party_switch' END]) AS kind) WHERE kind IS NOT NULL""")
def roster_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("party"))
    after = c.where("id % 10 <> 4").withColumn("name", F.when(F.col("id") % 11 == 0, F.concat("name", F.lit(" Jr"))).otherwise(F.col("name"))).withColumn("party", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("party")))
    out = changes.roster_changes(c.where("id % 10 <> 3"), after, "id", {"name": ("name_changed", "info"), "party": ("party_switch", "notable")})
    return out.select("id", "kind")


@query("""WITH s AS (SELECT DISTINCT c_mktsegment AS grp, o_custkey AS host, first_value(o_orderstatus) OVER (PARTITION BY c_mktsegment, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS st FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT grp, count(*) AS hosts, count(*) FILTER (WHERE st = 'F') AS good_hosts, round(100.0 * count(*) FILTER (WHERE st = 'F') / count(*), 1) AS pct,
CASE WHEN 100.0 * count(*) FILTER (WHERE st = 'F') / count(*) >= 85 THEN 'A' WHEN 100.0 * count(*) FILTER (WHERE st = 'F') / count(*) >= 70 THEN 'B' WHEN 100.0 * count(*) FILTER (WHERE st = 'F') / count(*) >= 50 THEN 'C' WHEN 100.0 * count(*) FILTER (WHERE st = 'F') / count(*) >= 30 THEN 'D' ELSE 'F' END AS grade FROM s GROUP BY 1""")
def report_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_mktsegment").alias("grp"), F.col("o_custkey").alias("host"), "o_orderdate", "o_orderkey", "o_orderstatus")
    return rollups.report_card(rows, "grp", "host", "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "F")


@query("""WITH l AS (SELECT user_id, max(value) AS worst, min(value) AS best, count(*) AS sites, count(*) FILTER (WHERE event_type = 'view') AS home, count(*) FILTER (WHERE event_type <> 'view') AS foreign_n FROM events GROUP BY 1) SELECT * FROM l""")
def site_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("worst"), F.min("value").alias("best"), F.count(F.lit(1)).alias("sites"), F.count_if(F.col("event_type") == "view").alias("home"), F.count_if(F.col("event_type") != "view").alias("foreign_n"))


@query("""WITH k AS (SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 9 = 0 THEN 'blocked' ELSE 'none' END AS status FROM nation)
SELECT k.nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, CASE WHEN k.status = 'blocked' THEN 'blocked' WHEN coalesce(c.n, 0) >= 70 THEN 'live' WHEN coalesce(c.n, 0) >= 55 THEN 'partial' ELSE k.status END AS status
FROM k LEFT JOIN (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1) c USING (nation) LEFT JOIN (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1) s USING (nation)""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.when(F.col("n_nationkey") % 9 == 0, "blocked").otherwise("none").alias("status"))
    parts = {"customers": table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), "suppliers": table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation")}
    return rollups.coverage(known, ["nation"], parts, "customers", live=70, partial=55)


@query("""SELECT 'leave' AS side, count(*) AS orgs, count(*) FILTER (WHERE s_acctbal > 5000) AS rich, string_agg(DISTINCT s_nationkey::VARCHAR, ',' ORDER BY s_nationkey::VARCHAR) AS nations FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'stay', count(*), count(*) FILTER (WHERE s_acctbal > 5000), string_agg(DISTINCT s_nationkey::VARCHAR, ',' ORDER BY s_nationkey::VARCHAR) FROM supplier WHERE s_suppkey % 3 = 1""")
def side_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("s_suppkey") % 3 == 0, "leave").when(F.col("s_suppkey") % 3 == 1, "stay")
    rows = table(spark, sf_dir, "supplier").withColumn("side", side).where("side IS NOT NULL")
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("orgs"), F.count_if(F.col("s_acctbal") > 5000).alias("rich"), F.array_join(F.array_sort(F.collect_set(F.col("s_nationkey").cast("string"))), ",").alias("nations"))


_SESSIONS = [(1, 1, "1992-01-01", "1993-06-30"), (1, 2, "1993-07-01", "1995-03-31"), (2, 1, "1995-04-01", "1997-12-31"), (2, 2, "1998-01-01", None)]
_SESSIONS_SQL = "(VALUES (1, 1, TIMESTAMP '1992-01-01', TIMESTAMP '1993-06-30'), (1, 2, TIMESTAMP '1993-07-01', TIMESTAMP '1995-03-31'), (2, 1, TIMESTAMP '1995-04-01', TIMESTAMP '1997-12-31'), (2, 2, TIMESTAMP '1998-01-01', NULL)) s(parliament, session, s_start, s_end)"


def _sessions(spark: SparkSession) -> DataFrame:
    rows = tables.inline(spark, _SESSIONS, "parliament int, session int, a string, b string")
    return rows.select("parliament", "session", F.col("a").cast("timestamp_ntz").alias("s_start"), F.col("b").cast("timestamp_ntz").alias("s_end"))


@query(f"SELECT o_orderkey, parliament, session FROM orders JOIN {_SESSIONS_SQL} ON o_orderdate >= s_start AND (s_end IS NULL OR o_orderdate <= s_end)")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interval_join(table(spark, sf_dir, "orders"), _sessions(spark), "o_orderdate", "s_start", "s_end").select("o_orderkey", "parliament", "session")


@query(f"SELECT max(parliament) AS parliament, arg_max(session, struct_pack(p := parliament, s := session)) AS session FROM {_SESSIONS_SQL}")
def current_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark).agg(F.max(F.struct("parliament", "session")).alias("m")).select("m.parliament", "m.session")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of office from orders: the place is the customer's nation, the holder the customer."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("place"), F.col("c_custkey").alias("holder"), F.col("o_orderkey").alias("term"), F.col("o_orderdate").alias("t_start"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS")).alias("t_end"))


_TERMS_SQL = "(SELECT c_nationkey AS place, c_custkey AS holder, o_orderkey AS term, o_orderdate AS t_start, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate + INTERVAL 20 DAYS END AS t_end FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')"


@query(f"""WITH t AS {_TERMS_SQL}, f AS (SELECT o_orderkey AS fact, c_nationkey AS place, o_orderdate AS d FROM orders JOIN customer ON o_custkey = c_custkey),
j AS (SELECT fact, holder, t_start, row_number() OVER (PARTITION BY fact ORDER BY t_start NULLS LAST, t_end NULLS LAST, term) AS r FROM f LEFT JOIN t ON t.place = f.place AND d >= t_start AND (t_end IS NULL OR d < t_end)) SELECT fact, holder, t_start AS since FROM j WHERE r = 1""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = facts.select(F.col("o_orderkey").alias("fact"), F.col("c_nationkey").alias("place"), F.col("o_orderdate").alias("d"))
    out = intervals.holder_at(facts, _terms(spark, sf_dir), "d", "t_start", "t_end", ["place"], "fact", tie=["term"], bin_days=31)
    return out.select("fact", "holder", F.col("t_start").alias("since"))


@query(f"""WITH t AS {_TERMS_SQL}, f AS (SELECT o_orderkey AS fact, c_nationkey AS place, o_orderdate AS d FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT fact, min(holder) AS holder FROM f JOIN t ON t.place = f.place AND d >= t_start AND (t_end IS NULL OR d <= t_end) GROUP BY fact HAVING count(DISTINCT holder) = 1""")
def unique_candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = facts.select(F.col("o_orderkey").alias("fact"), F.col("c_nationkey").alias("place"), F.col("o_orderdate").alias("d"))
    return intervals.sole_holder_at(facts, _terms(spark, sf_dir), "d", "t_start", "t_end", ["place"], "fact", "holder", bin_days=31)


@query(f"""WITH t AS (SELECT * FROM {_TERMS_SQL}) SELECT a.term, count(*) AS pairs, min(b.term) AS first, max(b.term) AS last, sum(b.term)::BIGINT AS total FROM t a JOIN t b ON a.place = b.place AND a.term < b.term AND a.t_start <= coalesce(b.t_end, TIMESTAMP '9999-12-31') AND b.t_start <= coalesce(a.t_end, TIMESTAMP '9999-12-31') GROUP BY a.term""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _terms(spark, sf_dir)
    other = t.select("place", F.col("term").alias("term2"), F.col("t_start").alias("u_start"), F.col("t_end").alias("u_end"))
    pairs = intervals.overlapping(t, other, ["place"], ("t_start", "t_end"), ("u_start", "u_end")).where("term < term2")
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("pairs"), F.min("term2").alias("first"), F.max("term2").alias("last"), F.sum("term2").alias("total"))


@query("""WITH e AS (SELECT p_partkey AS k, p_name AS full_name, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', -1) AS short, split_part(p_name, ' ', -1) AS last FROM part),
m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'unknown' END AS n1, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', -1) AS n2, split_part(p_name, ' ', -1) AS n3 FROM part),
c AS (SELECT id, 0 AS step, count(DISTINCT k) AS n, min(k) AS k FROM m JOIN e ON n1 = full_name GROUP BY 1 UNION ALL SELECT id, 1, count(DISTINCT k), min(k) FROM m JOIN e ON n2 = short GROUP BY 1 UNION ALL SELECT id, 2, count(DISTINCT k), min(k) FROM m JOIN e ON n3 = last GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step) AS r FROM c) SELECT m.id, b.k AS k, b.step, CASE b.step WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 END::DOUBLE AS confidence FROM m LEFT JOIN b ON b.id = m.id AND r = 1 AND b.n = 1""")
def name_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    short = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(-1)))
    last = F.split_part("p_name", F.lit(" "), F.lit(-1))
    entities = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("full_name"), short.alias("short"), last.alias("last"))
    mentions = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise("unknown").alias("n1"), short.alias("n2"), last.alias("n3"))
    out = resolve.cascade(mentions, entities, "id", "k", [("n1", "full_name", 1.0), ("n2", "short", 0.9), ("n3", "last", 0.8)])
    return out.select("id", "k", "step", "confidence")


@query("""WITH v AS (SELECT p_partkey AS k, p_name AS variant, 0 AS priority FROM part UNION ALL SELECT p_partkey, split_part(p_name, ' ', -1), 1 FROM part) SELECT variant, priority, min(k) AS k FROM v WHERE variant <> '' GROUP BY 1, 2 HAVING count(DISTINCT k) = 1""")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", F.split_part("p_name", F.lit(" "), F.lit(-1)).alias("last"))
    return resolve.name_index(p, "k", [("p_name", 0), ("last", 1)])


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 4 THEN 'shared ' || p_partkey % 100 ELSE p_partkey::VARCHAR END AS slug, p_name AS name FROM part),
b AS (SELECT k AS id, CASE WHEN k % 2 = 0 THEN slug END AS slug, name FROM p), n AS (SELECT name, min(k) AS k FROM p GROUP BY 1 HAVING count(*) = 1), s AS (SELECT slug, CASE WHEN count(*) = 1 THEN min(k) END AS k, count(*) AS n FROM p GROUP BY 1)
SELECT b.id, coalesce(s.k, n.k) AS k, s.k IS NULL AND n.k IS NOT NULL AND coalesce(s.n, 0) < 2 AS learned FROM b LEFT JOIN s USING (slug) LEFT JOIN n USING (name)""")
def slug_then_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs are shared by the parts of one ending where that is a four."""
    slug = F.when(F.col("p_partkey") % 10 == 4, F.concat(F.lit("shared "), F.col("p_partkey") % 100)).otherwise(F.col("p_partkey").cast("string"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), slug.alias("slug"), F.col("p_name").alias("name"))
    rows = p.select(F.col("k").alias("id"), F.when(F.col("k") % 2 == 0, F.col("slug")).alias("slug"), "name")
    return resolve.by_key_then_name(rows, p, "id", "k", "slug", "name").select("id", "k", "learned")


@query("""SELECT DISTINCT a.p_partkey AS id, b.p_brand AS hit FROM part a JOIN (SELECT DISTINCT p_brand, split_part(p_brand, '#', 2) AS num FROM part) b ON b.p_brand = a.p_brand OR b.num = split_part(a.p_type, ' ', 1)""")
def or_condition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    brands = p.select(F.col("p_brand").alias("hit"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("num")).distinct()
    keyed = brands.select("hit", F.explode(F.array("hit", "num")).alias("ek"))
    keys = [F.col("p_brand"), F.split_part("p_type", F.lit(" "), F.lit(1))]
    return resolve.any_key(p.withColumnRenamed("p_partkey", "id"), keys, "id", keyed, "ek", "hit")


@query("""SELECT regexp_extract(c_name, '#0*([0-9]+)', 1)::BIGINT AS k, o_orderkey FROM customer JOIN orders ON o_custkey = regexp_extract(c_name, '#0*([0-9]+)', 1)::BIGINT""")
def regex_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.expr("try_cast(regexp_extract(c_name, '#0*([0-9]+)', 1) AS bigint)").alias("k"))
    return c.join(table(spark, sf_dir, "orders"), F.col("k") == F.col("o_custkey")).select("k", "o_orderkey")


@query("""SELECT a.c_custkey AS loser, b.s_suppkey + 1000000 AS winner FROM customer a JOIN supplier b ON regexp_replace(lower(a.c_name), '[^0-9]', '', 'g') = regexp_replace(lower(b.s_name), '[^0-9]', '', 'g')""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("k"), F.col("s_name").alias("name"))
    return resolve.duplicate_pairs(a, b, "k", F.regexp_replace(F.lower("name"), "[^0-9]", ""))


_OLD = "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, round(c_acctbal / 10000, 4) AS conf, 'old' AS src FROM customer WHERE c_custkey % 4 <> 1"
_NEW = "SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(c_name) END AS name, lower(c_mktsegment) AS seg, 0.5::DOUBLE AS conf, 'new' AS src FROM customer WHERE c_custkey % 4 <> 2"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.round(F.col("c_acctbal") / 10000, 4).alias("conf"), F.lit("old").alias("src"))
    new = c.where("c_custkey % 4 <> 2").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.upper("c_name")).alias("name"), F.lower("c_mktsegment").alias("seg"), F.lit(0.5).alias("conf"), F.lit("new").alias("src"))
    return old, new


@query(f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.name ELSE n.name END AS name, coalesce(n.seg, o.seg) AS seg, coalesce(n.conf, o.conf) AS conf, coalesce(n.src, o.src) AS src FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.k = n.k")
def upsert_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    return upserts.upsert(old, new, ["k"])


@query(f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.name ELSE n.name END AS name, coalesce(n.seg, o.seg) AS seg, coalesce(n.conf, o.conf) AS conf, coalesce(n.src, o.src) AS src FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.k = n.k")
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert into a stored table, in the buckets that the new rows fall into."""
    old, new = _sides(spark, sf_dir)
    kept = StoredTable.create(old, shared_folder(spark, "stored"), ["k"], buckets=16)
    kept.merge(new, lambda a, b: upserts.upsert(a, b, ["k"]))
    return kept.read()


@query("""SELECT o_orderkey, o_custkey, CASE WHEN l.n IS NULL OR l.n < 4 THEN o_orderstatus ELSE 'R' END AS o_orderstatus, o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW' OR l.n >= 4""")
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders but those of low priority; then all with four returned lines are merged in as returned."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    o = table(spark, sf_dir, "orders")
    kept = StoredTable.create(o.where("o_orderpriority <> '5-LOW'").select(*columns), shared_folder(spark, "stored"), ["o_orderkey"])
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    returned = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(*columns).withColumn("o_orderstatus", F.lit("R"))
    kept.merge(returned, lambda a, b: upserts.upsert(a, b, ["o_orderkey"]))
    return kept.read()


@query(f"SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.k = n.k)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    return upserts.insert_absent(old, new, ["k"])


@query(f"SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.seg, o.seg) AS seg, CASE WHEN o.k IS NULL THEN n.conf WHEN n.k IS NULL THEN o.conf ELSE greatest(o.conf, n.conf) END AS conf, CASE WHEN o.k IS NULL OR n.conf > o.conf THEN n.src ELSE o.src END AS src FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.k = n.k")
def confidence_gated_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    return upserts.upsert_if_surer(old, new, ["k"], "conf", ["src"])


@query(f"SELECT o.k, CASE WHEN o.k % 3 = 0 THEN n.name ELSE o.name END AS name, CASE WHEN o.k % 7 = 0 THEN n.seg ELSE o.seg END AS seg, o.conf, o.src FROM ({_OLD}) o LEFT JOIN ({_NEW}) n ON o.k = n.k")
def fill_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    blanks = old.withColumn("name", F.when(F.col("k") % 3 != 0, F.col("name")).otherwise("")).withColumn("seg", F.when(F.col("k") % 7 != 0, F.col("seg")))
    return upserts.fill_blanks(blanks, new, ["k"])


@query("""WITH o AS (SELECT o_custkey AS k, max(o_orderdate) AS d, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_orderdate) AS d, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL OR n.d > o.d THEN n.d ELSE o.d END AS d, CASE WHEN o.k IS NULL OR n.d > o.d THEN n.s ELSE o.s END AS s FROM o FULL JOIN n ON o.k = n.k""")
def newer_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda odd: latest.latest(o.where(F.col("o_orderkey") % 2 == odd), ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderdate", "o_orderstatus"]).toDF("k", "d", "s")
    return upserts.newer_wins(side(0), side(1), ["k"], "d")


@query(f"SELECT k, name, src, CASE WHEN k % 4 <> 2 THEN NULL ELSE TIMESTAMP '2024-01-01' END AS ended FROM ({_OLD})")
def soft_close_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    held = old.select("k", "name", "src").withColumn("ended", F.lit(None).cast("timestamp_ntz"))
    return upserts.soft_close(held, new, ["k"], "ended", F.lit("2024-01-01").cast("timestamp_ntz"))


@query(f"SELECT k, name, src FROM ({_OLD}) WHERE k % 2 = 0 UNION ALL SELECT k, name, 'old' FROM ({_NEW})")
def replace_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    tagged = old.select("k", "name", F.when(F.col("k") % 2 == 0, "old").otherwise("feed").alias("src"))
    return upserts.replace_source(tagged, new.select("k", "name", F.lit("feed").alias("src")), "src", "feed").withColumn("src", F.lit("old"))


@query("""SELECT o_orderkey, CASE WHEN c_mktsegment IS DISTINCT FROM o_orderpriority THEN c_mktsegment ELSE o_orderpriority END AS tag, c_mktsegment IS DISTINCT FROM o_orderpriority AS changed FROM orders JOIN customer ON c_custkey = o_custkey""")
def reconcile_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("tag"))
    source = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tag"))
    return upserts.update_distinct(o, source, "o_custkey", "tag").select("o_orderkey", "tag", "changed")


@query("""WITH RECURSIVE m AS (SELECT DISTINCT user_id AS loser, CASE WHEN user_id % 10 = 3 THEN user_id - 3 ELSE user_id - 10 END AS winner FROM events WHERE user_id % 10 IN (0, 3) AND user_id > 3),
t AS (SELECT loser, winner AS heir FROM m UNION ALL SELECT t.loser, m.winner FROM t JOIN m ON m.loser = t.heir), ends AS (SELECT loser, heir FROM t WHERE heir NOT IN (SELECT loser FROM m))
SELECT DISTINCT coalesce(heir, user_id) AS user_id, event_type FROM events LEFT JOIN ends ON loser = user_id""")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third of ten users merges into the tenth, and tenths into those ten before: long chains."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    winner = F.when(F.col("user_id") % 10 == 3, F.col("user_id") - 3).otherwise(F.col("user_id") - 10)
    mapping = e.where("user_id % 10 IN (0, 3) AND user_id > 3").select(F.col("user_id").alias("loser"), winner.alias("winner"))
    return upserts.merge_entities(e, mapping, "user_id", ["user_id", "event_type"])


@query("SELECT c_custkey, CASE c_custkey WHEN 3 THEN 'X' WHEN 9 THEN 'Y' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def batch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.apply_batch(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), [3, 9], ["X", "Y"], "c_custkey", "c_mktsegment")


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'CA' WHEN s_suppkey % 4 = 1 THEN 'US' WHEN s_suppkey % 4 = 2 THEN 'FR' END AS country, CASE WHEN s_suppkey % 3 = 0 THEN 'Amazon AWS' WHEN s_suppkey % 3 = 1 THEN 'HostPapa Inc' END AS org, CASE WHEN s_suppkey % 5 = 0 THEN 'x.cloudflare.net' END AS cname, s_suppkey % 7 = 0 AS failed FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'Cloudflare' END AS cdn, CASE WHEN s_suppkey % 3 = 0 THEN 'Amazon Web Services' WHEN s_suppkey % 3 = 1 THEN 'HostPapa' WHEN s_suppkey % 5 = 0 THEN 'Cloudflare' END AS provider,
CASE WHEN failed AND country IS NULL AND org IS NULL AND cname IS NULL THEN 6 WHEN country = 'CA' AND org = 'HostPapa Inc' THEN 1 WHEN country = 'CA' THEN 2 WHEN cname IS NOT NULL THEN 3 WHEN country = 'US' THEN 4 WHEN country IS NOT NULL THEN 5 WHEN org IS NOT NULL THEN 5 ELSE 6 END AS tier FROM s""")
def hosting_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 4 == 0, "CA").when(k % 4 == 1, "US").when(k % 4 == 2, "FR").alias("country"), F.when(k % 3 == 0, "Amazon AWS").when(k % 3 == 1, "HostPapa Inc").alias("org"), F.when(k % 5 == 0, "x.cloudflare.net").alias("cname"), (k % 7 == 0).alias("failed"))
    s = s.withColumn("cdn", hosting.first_match(F.array("cname", "org"), hosting.CDNS)).withColumn("provider", F.coalesce(hosting.first_match(F.array("org", "cname"), hosting.PROVIDERS), "cdn"))
    home = hosting.home_provider(F.col("org"), F.lit(None).cast("string"), ["hostpapa"], [])
    return s.select("s_suppkey", "cdn", "provider", hosting.tier(F.col("country"), home, F.col("cdn"), F.col("provider"), F.col("failed")).alias("tier"))
