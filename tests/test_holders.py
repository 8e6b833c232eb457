"""Holders on a date, held against every pair of a fact and a term."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import intervals
from siltstone.plans import catalog

DAY = datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def drawn():
    rnd = random.Random(5)
    hours = lambda n: DAY + timedelta(hours=rnd.randrange(n))
    facts = [(k, rnd.choice(["a", "b", "c", None]), rnd.choice([hours(2000)] * 9 + [None])) for k in range(600)]
    facts += [(7, "b", DAY), (8, "a", DAY + timedelta(days=4000)), (9, "a", DAY - timedelta(days=4000))]
    terms = []
    for k in range(160):
        s = rnd.choice([hours(2000)] * 9 + [None])
        e = rnd.choice([None if rnd.random() < 0.1 or s is None else s + timedelta(hours=rnd.randrange(-5, 90))] * 3 + [hours(2000)])
        terms.append((rnd.choice(["a", "b", None]), rnd.choice([*range(12), None]), k // 2, s, e))
    return facts, terms


@pytest.fixture(scope="module")
def tables(spark, drawn):
    return spark.createDataFrame(drawn[0], "fact long, place string, d timestamp_ntz").repartition(5), spark.createDataFrame(drawn[1], "place string, holder int, term long, s timestamp_ntz, e timestamp_ntz").repartition(5)


@pytest.mark.parametrize("days", [1, 31, 3660])
def test_the_first_that_began_holds(tables, drawn, days):
    late = datetime(9999, 1, 1)
    want = {}
    for fact, place, d in drawn[0]:
        over = [(s, e or late, t, h if h is not None else 99) for p, h, t, s, e in drawn[1] if None not in (p, place, d, s) and p == place and s <= d and (e is None or d < e)]
        want[fact] = min([*over, *[x for x in [want.get(fact)] if x]], default=None)
    got = {r["fact"]: r for r in intervals.holder_at(*tables, "d", "s", "e", ["place"], "fact", tie=["term", "holder"], bin_days=days).collect()}
    assert {f: r["s"] and (r["s"], r["e"] or late, r["term"], r["holder"] if r["holder"] is not None else 99) for f, r in got.items()} == want


@pytest.mark.parametrize("days", [1, 31, 3660])
def test_one_holder_or_none(tables, drawn, days):
    found = {}
    for fact, place, d in drawn[0]:
        found.setdefault(fact, set()).update(h for p, h, t, s, e in drawn[1] if None not in (p, place, d, s, h) and p == place and s <= d and (e is None or d <= e))
    got = intervals.sole_holder_at(*tables, "d", "s", "e", ["place"], "fact", "holder", bin_days=days).collect()
    assert sorted(map(tuple, got)) == sorted((f, min(h)) for f, h in found.items() if len(h) == 1) and len(got) > 20


@pytest.mark.parametrize("name", ["asof_lookup", "unique_candidate_gate"])
def test_facts_never_meet_the_terms_that_overlap(spark, data, name):
    """Pairs of facts and terms grow with the square of both: no join compares a fact's time with a term's."""
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join [^\n]*(t_start|t_end|o_orderdate)", plan)


def test_a_key_is_spread_over_its_bins(spark):
    facts = spark.range(2000).select(F.col("id").alias("fact"), F.lit(1).alias("place"), (F.lit(DAY) + F.make_dt_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("d"))
    terms = facts.select("place", F.col("fact").alias("holder"), F.col("d").alias("s"), (F.col("d") + F.expr("INTERVAL 500 HOURS")).alias("e"))
    held = intervals.holder_at(facts, terms, "d", "s", "e", ["place"], "fact", bin_days=7).select("fact", "holder").collect()
    assert {r["fact"]: r["holder"] for r in held} == {k: max(0, k - 499) for k in range(2000)}
