"""Joins on validity intervals, with an equality key so that they never loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.latest import first_by


def covers(at: Column, start: Column, end: Column, closed: bool) -> Column:
    """Whether a time lies in [start, end] or, not closed, in [start, end); no end is open."""
    return (at >= start) & (end.isNull() | ((at <= end) if closed else (at < end)))


def interval_join(facts: DataFrame, spans: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None, closed: bool = True, how: str = "inner", bin_days: int = 366) -> DataFrame:
    """Facts with the intervals that hold their time (and, if any, share ``keys``).

    Time is cut into bins, and an interval is a row for every bin that it shares
    with the times of ``facts``, from their first to their last, whatever its own
    ends. So the join is on the bin and the keys, and only facts and intervals of
    one bin meet; smaller bins suit many short intervals. ``spans`` may not share
    column names with ``facts`` besides ``keys``. Null times and starts match nothing.
    """
    keys = keys or []
    bin_of = lambda t: F.floor(F.unix_date(t.cast("date")) / bin_days)
    reach = facts.agg(F.min(bin_of(F.col(at))).alias("__lo"), F.max(bin_of(F.col(at))).alias("__hi"))
    right = spans.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start)))).crossJoin(F.broadcast(reach))  # one row
    first, last = F.greatest(bin_of(F.col(start)), F.col("__lo")), F.least(F.coalesce(bin_of(F.col(end)), F.col("__hi")), F.col("__hi"))
    right = right.where(first <= last).withColumn("__bin", F.explode(F.sequence(first, last))).drop("__lo", "__hi")
    left = facts.withColumn("__fact_bin", bin_of(F.col(at)))
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = (F.col("__fact_bin") == F.col("__bin")) & covers(F.col(at), F.col(start), F.col(end), closed)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(right, on, how).drop("__fact_bin", "__bin", *[f"__{k}" for k in keys])


def unique_candidate(rows: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """Keys with exactly one candidate, and that one; ambiguous keys are left out, never guessed."""
    found = rows.groupBy(*keys).agg(F.min(candidate).alias(candidate), F.max(candidate).alias("__last"))
    return found.where(F.col(candidate) == F.col("__last")).drop("__last")


def _bin(time: Column, bin_days: int) -> Column:
    return F.floor(F.unix_date(time.cast("date")) / bin_days)


def _running(rows: DataFrame, keys: list[str], order: list[Column], total: Column, over: Callable[[Column], Column], both: Callable[[Column, Column], Column], value: str, to: str, before: bool = False) -> DataFrame:
    """Add ``to``, the aggregate of ``value`` over a key's rows up to this one (or ``before`` it).

    A key's rows are spread over the bins ``__bin``, which go with ``order``: each
    bin begins with what the ``total`` of the earlier ones comes to (``over``), and
    ``both`` adds that to its own rows'. So no key meets in one task, and no row is
    made twice.
    """
    first = Window.unboundedPreceding
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(first, -1)
    bins = rows.groupBy(*keys, "__bin").agg(total.alias("__total")).withColumn("__carried", over(F.col("__total")).over(earlier))
    bins = bins.select(*[F.col(k).alias(f"__own_{k}") for k in keys], F.col("__bin").alias("__own_bin"), "__carried")
    same = F.col("__bin").eqNullSafe(F.col("__own_bin"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__own_{k}"))
    own = over(F.col(value)).over(Window.partitionBy(*keys, "__bin").orderBy(*order).rowsBetween(first, -1 if before else 0))
    return rows.join(bins, same).withColumn(to, both(own, F.col("__carried"))).drop("__own_bin", "__carried", *[f"__own_{k}" for k in keys])


def holder_at(facts: DataFrame, terms: DataFrame, at: str, start: str, end: str, keys: list[str], fact_id: str, tie: list[str] | None = None, bin_days: int = 366) -> DataFrame:
    """The holder on a date, half-open; of overlapping terms the first that began. No holder: nulls.

    Terms of equal ends are told apart by the columns ``tie``, by default all of theirs.
    In that order a term holds from where all before it have ended, so terms become
    stretches of time that share nothing, and a fact's is the last that began: facts
    never meet the terms that overlap.
    """
    own = [c for c in terms.columns if c not in keys]
    last = tie if tie is not None else [c for c in own if c not in (start, end)]
    s, e = F.col(start), F.col(end)
    real = s.isNotNull() & (e.isNull() | (e > s))
    for k in keys:
        real = real & F.col(k).isNotNull()
    order = [s.asc(), e.asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in last]]
    ends = terms.where(real).withColumns({"__bin": _bin(s, bin_days), "__end": F.struct(e.isNull().alias("open"), e.alias("end"))})
    ends = _running(ends, keys, order, F.max("__end"), F.max, F.greatest, "__end", "__taken", before=True)
    until = F.col("__taken.end")
    free = ends.where(F.col("__taken").isNull() | (~F.col("__taken.open") & (e.isNull() | (e > until)))).withColumn("__from", F.greatest(s, until))
    stretches = free.select(*keys, F.col("__from").alias("__t"), F.lit(0).alias("__kind"), F.struct(*own).alias("__term"), F.lit(None).alias("__fact"))
    asked = facts.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).alias("__term"), F.struct(*facts.columns).alias("__fact"))
    rows = stretches.unionByName(asked).withColumn("__bin", _bin(F.col("__t"), bin_days))
    lasting = lambda c: F.last(c, ignorenulls=True)
    # max_by leaves out rows of no order: facts have none
    total = F.max_by("__term", F.when(F.col("__kind") == 0, F.col("__t")))
    found = _running(rows, keys, [F.col("__t"), F.col("__kind")], total, lasting, F.coalesce, "__term", "__held").where("__kind = 1")
    holds = F.col(f"__held.{end}").isNull() | (F.col("__t") < F.col(f"__held.{end}"))
    found = found.select("__fact.*", F.when(holds, F.col("__held")).alias("__held")).select(*facts.columns, *[F.col("__held")[c].alias(c) for c in own])
    return first_by(found, [fact_id], [F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in last]])


def sole_holder_at(facts: DataFrame, terms: DataFrame, at: str, start: str, end: str, keys: list[str], fact_id: str, holder: str, bin_days: int = 366) -> DataFrame:
    """``fact_id, holder`` of facts on whose date (ends are inclusive) exactly one holder has a term.

    As ``unique_candidate`` of an ``interval_join``, but facts never meet terms: a
    holder's terms are put together where they overlap, and at any time the holders
    are those that began less those that ended. Where that is one, it is the one
    whose end is the latest of all that began.
    """
    s, e = F.col(start), F.col(end)
    real = s.isNotNull() & (e.isNull() | (e >= s)) & F.col(holder).isNotNull()
    for k in keys:
        real = real & F.col(k).isNotNull()
    ends = terms.where(real).select(*keys, F.col(holder).alias("__holder"), s.alias("__s"), F.struct(e.isNull().alias("open"), e.alias("end")).alias("__e"))
    w = Window.partitionBy(*keys, "__holder").orderBy("__s", "__e")
    taken = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = ends.withColumn("__taken", taken).withColumn("__new", F.coalesce(~F.col("__taken.open") & (F.col("__s") > F.col("__taken.end")), F.lit(True)).cast("int"))
    apart = apart.withColumn("__nth", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    once = apart.groupBy(*keys, "__holder", "__nth").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
    # Beginnings come before a time's facts, ends after them.
    steps = F.array(F.struct(F.col("__s").alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.col("__e.end").alias("t"), F.lit(2).alias("kind"), F.lit(-1).alias("step")))
    moved = once.withColumn("__p", F.explode(steps)).where("__p.t IS NOT NULL")
    fact = F.struct(F.col(fact_id).alias("id"))
    moved = moved.select(*keys, F.col("__p.t").alias("__t"), F.col("__p.kind").alias("__kind"), F.col("__p.step").alias("__step"), F.when(F.col("__p.kind") == 0, F.struct("__e", "__holder")).alias("__last"), F.lit(None).alias("__fact"))
    asked = facts.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(0).alias("__step"), F.lit(None).alias("__last"), fact.alias("__fact"))
    rows = moved.unionByName(asked).withColumn("__bin", _bin(F.col("__t"), bin_days))
    order = [F.col("__t"), F.col("__kind")]
    plus = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    rows = _running(rows, keys, order, F.sum("__step"), F.sum, plus, "__step", "__n")
    rows = _running(rows, keys, order, F.max("__last"), F.max, F.greatest, "__last", "__latest").where("__kind = 1")
    found = rows.groupBy(F.col("__fact.id").alias(fact_id)).agg(F.max("__n").alias("__n"), *[f(F.when(F.col("__n") == 1, F.col("__latest.__holder"))).alias(n) for n, f in ((holder, F.min), ("__last", F.max))])
    return found.where((F.col("__n") == 1) & (F.col(holder) == F.col("__last"))).select(fact_id, holder)


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], bin_days: int = 31) -> DataFrame:
    """Pairs of intervals of one key that overlap (ends are inclusive, no end is open).

    Both sides are rows for each bin of time they touch, and a pair is made in the
    first bin that both touch: so a key's intervals are spread over its bins, and
    only those of one bin meet. Intervals without a start overlap nothing.
    """
    bin_of = lambda t: F.floor(F.unix_date(t.cast("date")) / bin_days)
    ends = [side.agg(F.min(bin_of(F.col(s))).alias("lo"), F.max(bin_of(F.greatest(F.col(s), F.coalesce(F.col(e), F.col(s))))).alias("hi")) for side, (s, e) in ((a, a_span), (b, b_span))]
    reach = ends[0].unionByName(ends[1]).agg(F.max("hi").alias("__hi"))  # beyond it nothing begins or ends

    def binned(side: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        s, e = F.col(span[0]), F.col(span[1])
        rows = side.where(s.isNotNull() & (e.isNull() | (e >= s))).crossJoin(F.broadcast(reach))  # one row
        first = bin_of(s)
        return rows.withColumn(f"__{name}", F.explode(F.sequence(first, F.coalesce(bin_of(e), F.col("__hi"))))).withColumn(f"__{name}_first", first).drop("__hi")

    left, right = binned(a, a_span, "a"), binned(b, b_span, "b")
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = (F.col("__a") == F.col("__b")) & (F.col("__a") == F.greatest("__a_first", "__b_first"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    late = F.lit("9999-12-31").cast("timestamp_ntz")
    on = on & (F.col(a_span[0]) <= F.coalesce(F.col(b_span[1]), late)) & (F.col(b_span[0]) <= F.coalesce(F.col(a_span[1]), late))
    return left.join(right, on).drop("__a", "__b", "__a_first", "__b_first", *[f"__{k}" for k in keys])
