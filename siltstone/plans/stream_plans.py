"""Streams over ``events``, held against the batch result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.intervals import covers
from siltstone.plans.registry import query
from siltstone.sources.shared import Workspace, file_system, shared_folder
from siltstone.sources.tables import table
from siltstone.streaming import feeds, timed
from siltstone.streaming.percolator import Percolator


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return feeds.file_stream(spark, sf_dir, schema, names="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    folder = shared_folder(spark, label)
    return feeds.drain(stream, f"{folder}/out", f"{folder}/checkpoint")


#: Rows of a part for each of its files, which are written by a task each.
FILE_ROWS = 500_000


def _in_files(spark: SparkSession, rows: DataFrame, part: Column, parts: int, label: str) -> DataFrame:
    """The rows as a stream of parts, one after the other: a batch is a part, of as many files as the largest needs."""
    folder = f"{shared_folder(spark, label)}/files"
    held = rows.withColumn("__part", part)
    sizes = {r["__part"]: r["count"] for r in held.groupBy("__part").count().collect()}  # a row for each part
    files = max(1, -(-max(sizes.values(), default=0) // FILE_ROWS))
    for k in range(parts):
        # Rows are dealt in turn to tasks that write one file each; a part of few rows has empty files too.
        some = held.where(F.col("__part") == k).drop("__part")
        some = some.coalesce(1) if files == 1 else some.repartition(files)
        some.write.mode("append").parquet(folder)
        fs, where = file_system(spark, folder)
        lacking = files * (k + 1) - sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(where))
        for _ in range(lacking):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return feeds.file_stream(spark, folder, rows.schema, files_per_batch=files)


@query("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) SELECT user_id, event_id, old, event_type AS new FROM l WHERE old IS NOT NULL AND old <> event_type""")
def stream_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in files that overlap in time: rows come up to a day behind later ones."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    hour = F.floor((F.unix_timestamp("ts") - F.lit(1704067200)) / 3600) + F.col("event_id") % 24
    stream = _in_files(spark, rows, F.least(F.floor(hour / 240), F.lit(2)), 3, "changes")
    folder = shared_folder(spark, "changes-state")
    work = timed.StateChanges(folder, "user_id", "ts", "event_id", "event_type", late="2 days")
    return work.drain(stream, f"{folder}/checkpoint", complete=True).select("user_id", "event_id", "old", "new")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, in two files; the copy is behind all of the first file's times."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    stream = _in_files(spark, twice, F.col("copy"), 2, "dedup")
    return _drained(spark, feeds.first_of_key(stream, "event_id", "ts", within="60 days"), "dedup").select("event_id")


@query("""WITH m AS (SELECT s.id AS search_id, event_id, row_number() OVER (PARTITION BY s.id ORDER BY ts DESC, event_id) AS r FROM events JOIN (VALUES (1, 'click', TIMESTAMP '2024-01-10'), (2, 'purchase', NULL), (3, 'error', TIMESTAMP '2030-01-01')) s(id, kind, since) ON event_type = kind AND ts > coalesce(since, TIMESTAMP '0001-01-01')) SELECT search_id, event_id FROM m WHERE r <= 10""")
def standing_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = spark.createDataFrame([(1, {"event_type": ["click"]}, "2024-01-10"), (2, {"event_type": ["purchase"]}, None), (3, {"event_type": ["error"]}, "2030-01-01")], "search_id int, filters map<string,array<string>>, since string")
    saved = saved.select("search_id", "filters", F.col("since").cast("timestamp_ntz").alias("last_checked_at"))
    folder = shared_folder(spark, "standing")
    asked = Percolator(saved, ["event_type"], "ts", "event_id")
    work = feeds.StandingQueries(asked, lambda found, n: found.select("search_id", "event_id").write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/state")
    work.run(_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz")), f"{folder}/checkpoint")
    return spark.read.schema("search_id int, event_id bigint").parquet(f"{folder}/out").select("search_id", "event_id")


_ROWS = """SELECT doc_id, lang, ts, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS s, embedding::DOUBLE[] AS v FROM documents JOIN events ON event_id = doc_id LEFT JOIN embeddings ON vec_id = doc_id"""
_NEAR = "round(1 - round(list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})), 6), 6)"


@query(f"""WITH r AS ({_ROWS}), m AS (
SELECT 1 AS search_id, doc_id, ts, NULL::DOUBLE AS d FROM r WHERE lang = 'fr'
UNION ALL SELECT 2, doc_id, ts, NULL FROM r WHERE lang IN ('en', 'de') AND contains(s, ' of the ') AND NOT contains(s, ' and ') OR lang IN ('en', 'de') AND contains(s, ' nicht ')
UNION ALL SELECT 3, doc_id, ts, {_NEAR.format(3)} FROM r WHERE lang IN ('en', 'fr') AND v IS NOT NULL
UNION ALL SELECT 4, doc_id, ts, {_NEAR.format(5)} FROM r WHERE v IS NOT NULL AND ts > TIMESTAMP '2024-01-10'
UNION ALL SELECT 5, doc_id, ts, {_NEAR.format(7)} FROM r WHERE v IS NOT NULL AND contains(s, ' les ') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'
UNION ALL SELECT 6, doc_id, ts, {_NEAR.format(9)} FROM r WHERE v IS NOT NULL AND {_NEAR.format(9)} <= 0.9)
SELECT search_id, doc_id, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY d NULLS LAST, CASE WHEN d IS NULL THEN ts END DESC, doc_id) AS k FROM m) WHERE k <= 10""")
def percolated_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by words, values, times and vectors against all documents, dated by the events of their ids."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    vectors = {r["vec_id"]: r["embedding"] for r in table(spark, sf_dir, "embeddings").where("vec_id IN (3, 5, 7, 9)").collect()}
    asked = [
        (1, {"lang": ["fr"]}, None, None, None, None, None, None), (2, {"lang": ["en", "de"]}, '"of the" -and or nicht', None, None, None, None, None), (3, {"lang": ["en", "fr"]}, None, vectors[3], None, None, None, None),
        (4, None, None, vectors[5], None, None, None, "2024-01-10"), (5, None, "les", vectors[7], None, "2024-01-05", "2024-01-25", None), (6, {}, "", vectors[9], 0.1, None, None, None),
    ]
    saved = spark.createDataFrame(asked, "search_id int, filters map<string,array<string>>, search string, q array<float>, floor double, after string, before string, last_checked_at string")
    known = Percolator(saved, ["lang"], "ts", "doc_id", "text", "embedding", sample=documents)
    # Texts are read before they meet times and vectors, which only take along what is asked for.
    rows = known.with_terms(documents).drop("text").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    rows = rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    rows = Workspace(spark, "percolated").keep(rows, "rows")
    marks = known.searches.select("search_id", "last_checked_at")
    return known.matches(rows, marks, F.lit("0001-01-01").cast("timestamp_ntz"), 10).select("search_id", "doc_id", F.round("distance", 6).alias("distance"))


@query("SELECT user_id AS schedule_id, TIMESTAMP '2024-01-30' AS queued_at FROM (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) WHERE user_id % 5 <> 0 AND CASE user_id % 3 WHEN 0 THEN seen + INTERVAL 1 DAY <= TIMESTAMP '2024-01-30' WHEN 1 THEN seen + INTERVAL 7 DAY <= TIMESTAMP '2024-01-30' ELSE false END")
def due_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("schedule_id")).agg(F.max("ts").alias("last_run_at"))
    plans = seen.withColumn("cadence", F.when(F.col("schedule_id") % 3 == 0, "daily").when(F.col("schedule_id") % 3 == 1, "weekly").otherwise("never")).withColumn("enabled", F.col("schedule_id") % 5 != 0)
    return feeds.due_schedules(plans, F.lit("2024-01-30").cast("timestamp_ntz"), {"daily": "1 DAY", "weekly": "7 DAYS"})


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 2 HOURS THEN CASE WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'queued' END WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status FROM events""")
def requeued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").alias("started_at"), (F.col("event_id") % 4).alias("attempts"))
    return feeds.requeued(jobs, F.lit("2024-01-15").cast("timestamp_ntz"), "2 HOURS").select("event_id", "status")


@query("SELECT event_id, event_id % 3 <> 0 AS genuine FROM events")
def signed_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with their signatures, of which every third is another body's."""
    secret, events = b"shared secret", table(spark, sf_dir, "events").select("event_id", "props")
    pads = [F.lit(bytearray(k ^ pad for k in secret.ljust(64, b"\0"))) for pad in (0x36, 0x5C)]
    said = F.concat(F.when(F.col("event_id") % 3 == 0, "x").otherwise(""), F.col("props"))
    signature = F.sha2(F.concat(pads[1], F.unhex(F.sha2(F.concat(pads[0], F.encode(said, "UTF-8")), 256))), 256)
    return events.select("event_id", feeds.signed(F.col("props"), F.concat(F.lit("sha256="), signature), secret).alias("genuine"))


@query("SELECT event_id, event_type AS kind, json_extract_string(props, '$.k')::INTEGER AS k FROM events WHERE event_id % 3 <> 0 AND event_id % 7 <> 0")
def webhook_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries in two files, the second with the first's again; of every third the signature is another's, every seventh is no object."""
    secret = b"shared secret"
    pads = [F.lit(bytearray(k ^ pad for k in secret.ljust(64, b"\0"))) for pad in (0x36, 0x5C)]
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "props")
    whole = F.to_json(F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    body = F.when(F.col("event_id") % 7 == 0, "no object").otherwise(whole)
    said = F.concat(F.when(F.col("event_id") % 3 == 0, "x").otherwise(""), "body")
    sent = events.select("event_id", "ts", body.alias("body"))
    sent = sent.withColumn("signature", F.sha2(F.concat(pads[1], F.unhex(F.sha2(F.concat(pads[0], F.encode(said, "UTF-8")), 256))), 256))
    twice = sent.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    stream = _in_files(spark, twice, F.col("part"), 2, "webhooks")
    changes = feeds.webhook_changes(stream, secret, "kind string, k int", "event_id", "ts", within="60 days")
    return _drained(spark, changes, "webhooks").select("event_id", "kind", "k")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return feeds.pending(events, events.where("event_type = 'view'"), "event_id").select("event_id")


@query("SELECT event_id, ts + INTERVAL 12 HOURS > TIMESTAMP '2024-01-20' AS fresh FROM events")
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    expires = F.col("ts") + F.expr("INTERVAL 12 HOURS")
    return table(spark, sf_dir, "events").select("event_id", covers(now, F.lit("0001-01-01").cast("timestamp_ntz"), expires, closed=False).alias("fresh"))
