"""Counts, shares and report cards."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.markup import rewritten_links, sanitised
from siltstone.functions.strings import letter_grade
from siltstone.operators.latest import first_by
from siltstone.sources.shared import Workspace


def share(part: Column, digits: int = 1) -> Column:
    """The percentage of rows for which ``part`` holds; 0 for no rows."""
    return F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.count_if(part), F.count(F.lit(1))), digits), F.lit(0.0))


def counts_where(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def gap_matrix(entities: DataFrame, kinds: DataFrame, present: DataFrame, key: str, kind: str, most: int = 1000) -> DataFrame:
    """The (entity, kind) pairs that are missing.

    Kinds are a stated, short list: more than ``most`` raise, so each entity is a
    bounded number of pairs and the list can go to every task.
    """
    short = kinds.select(kind).distinct().limit(most + 1).collect()
    if len(short) > most:
        raise ValueError(f"a gap matrix takes at most {most} kinds")
    every = F.array(*[F.lit(r[0]) for r in short]) if short else F.array().cast(f"array<{dict(kinds.dtypes)[kind]}>")
    return entities.select(key, F.explode(every).alias(kind)).join(present.select(key, kind), [key, kind], "left_anti")


def report_card(sites: DataFrame, group: str, host: str, at: str, tie: str, good: Column) -> DataFrame:
    """Per group: its hosts by their latest rows, how many are good, the share and a grade."""
    once = first_by(sites, [group, host], [F.col(at).desc_nulls_last(), F.col(tie).desc()])
    out = once.groupBy(group).agg(F.count(F.lit(1)).alias("hosts"), F.count_if(good).alias("good_hosts"), share(good).alias("pct"))
    return out.withColumn("grade", letter_grade(F.col("pct")))


def party_report(members: DataFrame, sites: DataFrame, group: str, member: str, host: str, at: str, tie: str, tier: str) -> DataFrame:
    """Each group's report: ``members, sites, home, cdn, us, foreign, no_site, pct, grade``.

    A host that several members share counts once, by its latest row; a tier is
    home (1, 2), a CDN's (3), of the US (4) or foreign (5). ``no_site`` counts the
    members without any site. ``pct`` is the share at home, whole per cent.
    """
    tiers = {"home": [1, 2], "cdn": [3], "us": [4], "foreign": [5]}
    once = first_by(sites, [group, host], [F.col(at).desc_nulls_last(), F.col(tie).desc()])
    by_host = once.groupBy(group).agg(F.count(F.lit(1)).alias("sites"), *[F.count_if(F.col(tier).isin(t)).alias(n) for n, t in tiers.items()])
    people = members.select(group, member).distinct()
    have = sites.select(F.col(member).alias("__m")).distinct()
    counted = people.join(have, F.col(member) == F.col("__m"), "left").groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("__m").isNull()).alias("no_site"))
    out = counted.join(by_host, group, "left").fillna(0, ["sites", *tiers])
    pct = F.when(F.col("sites") > 0, F.floor(F.lit(100.0) * F.col("home") / F.greatest("sites", F.lit(1)) + 0.5)).otherwise(0).cast("int")
    return out.select(group, "members", "sites", *tiers, "no_site", pct.alias("pct"), letter_grade(pct).alias("grade"))


def top_values(sites: DataFrame, group: str, host: str, at: str, tie: str, value: str, most: int = 6) -> DataFrame:
    """The ``most`` frequent values of each group's hosts, by their latest rows: ``group, value, n``."""
    once = first_by(sites, [group, host], [F.col(at).desc_nulls_last(), F.col(tie).desc()])
    counted = once.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return first_by(counted, [group], [F.col("n").desc(), F.col(value)], most)


def member_sites(sites: DataFrame, member: str, tier: str, order: str, facts: list[str]) -> DataFrame:
    """Each member's sites: ``worst, best, home, cdn, us, foreign`` and the list of them with their ``facts``.

    An unknown tier is 6. A member's list is as long as the sites they have.
    """
    t = F.coalesce(F.col(tier), F.lit(6))
    kinds = {"home": t.isin(1, 2), "cdn": t == 3, "us": t == 4, "foreign": t == 5}
    one = F.struct(F.col(order), t.alias("tier"), *facts)
    listed = F.array_sort(F.collect_list(one)).alias("sites")
    return sites.where(F.col(member).isNotNull()).groupBy(member).agg(F.max(t).alias("worst"), F.min(t).alias("best"), *[F.count_if(c).alias(n) for n, c in kinds.items()], listed)


def coverage(known: DataFrame, keys: list[str], parts: dict[str, DataFrame], main: str, live: int = 50_000, partial: int = 1_000) -> DataFrame:
    """Counts of several tables for each known place and what they say of its status.

    One aggregation for each table. ``live`` and ``partial`` are thresholds of
    the ``main`` count; fewer rows keep the status, and ``blocked`` stays.
    """
    out = known
    for name, rows in parts.items():
        counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    n = F.col(main)
    status = F.when(F.col("status") == "blocked", F.col("status")).when(n >= live, "live").when(n >= partial, "partial").otherwise(F.col("status"))
    return out.withColumn("status", status)


def bucketed(rows: DataFrame, order: list[Column], size: int, text: str, most: int = 300) -> DataFrame:
    """The first ``most`` rows in buckets of ``size``, each with its texts joined (report map phase).

    ``most`` is a report's size, so one task numbers its rows.
    """
    numbered = rows.orderBy(*order).limit(most).withColumn("__rn", F.row_number().over(Window.orderBy(*order)))
    numbered = numbered.withColumn("bucket", F.floor((F.col("__rn") - 1) / size))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", text))), lambda x: x[text]), "\n")
    return numbered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), joined.alias("body"))


def mapped_report(rows: DataFrame, order: list[Column], text: str, mapper: Callable[[str], str], reducer: Callable[[list[str]], str], targets: dict[str, str], size: int = 10, most: int = 300, prefix: str = "/speeches/") -> DataFrame:
    """A report of the first ``most`` rows, one row ``report``: buckets mapped, answers reduced, links rewritten, HTML cleaned.

    ``mapper`` and ``reducer`` are the caller's, a language model for one;
    ``targets`` are the places of the chunks that the report may link to, and only
    links that begin with ``prefix`` stay. Buckets
    are mapped in tasks; at most ``most / size`` answers come to the driver.
    """

    @F.pandas_udf("string")
    def answers(bodies: pd.Series) -> pd.Series:
        return bodies.map(mapper)

    parts = bucketed(rows, order, size, text, most).select("bucket", answers("body").alias("answer")).orderBy("bucket").collect()
    whole = rows.sparkSession.createDataFrame([(reducer([r["answer"] for r in parts]), targets)], "html string, targets map<string,string>")
    return whole.select(sanitised(rewritten_links(F.col("html"), F.col("targets")), prefix=prefix).alias("report"))


def index_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The values at index ``int(n * share)`` of each key's sorted values, as a list index has it.

    ``keys``, and a column for each of ``shares``. Rows are sorted in ranges of
    keys and values, ranges are counted, and only the ranges that hold an index
    are looked at: a key may fill many of them, and none is gathered. Nulls in
    ``value`` don't count.
    """
    spark = rows.sparkSession
    own = Workspace(spark, "percentiles")
    kept = rows.where(F.col(value).isNotNull()).select(*keys, value, F.monotonically_increasing_id().alias("__tie"))
    ranged = kept.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, value, "__tie").drop("__tie")
    ranged = own.keep(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*keys)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__n").over(whole))
    index = lambda q: F.least(F.floor(F.col("__all") * q), F.col("__all") - 1)
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), index(q).alias("at")) for name, q in shares.items()]))
    places = counts.withColumn("__q", asked).where("__q.at >= __before AND __q.at < __before + __n")
    places = places.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), F.col("__q.name").alias("__name"), (F.col("__q.at") - F.col("__before")).alias("__at"))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    here = places.select(*[f"__k_{k}" for k in keys], "__p").distinct()
    near = ranged.join(here, [*same, F.col("__part") == F.col("__p")], "left_semi")
    near = near.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(value)) - 1)
    found = near.join(places, [*same, F.col("__part") == F.col("__p"), F.col("__rn") == F.col("__at")])
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in shares])


def report_cost(chunks: Column, base: int = 5, bucket: int = 10, unit: int = 1, most: int = 300) -> Column:
    return (F.lit(base) + F.ceil(F.least(chunks, F.lit(most)) / bucket) * unit).cast("long")
