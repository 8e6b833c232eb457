"""Writes as new versions of a table: every function returns what the table would become.

Of several new rows of one key one counts, the last by ``order`` (by default that
of the greatest values), so a key never has more rows than it had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.operators.latest import first_by
from siltstone.sources.shared import Workspace


def _joined(table: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Both sides of each key, null-safe; the new side's columns start with ``__n_``."""
    right = new.select(*[F.col(c).alias(f"__n_{c}") for c in new.columns], F.lit(True).alias("__is_new"))
    left = table.withColumn("__is_old", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__n_{k}"))
    return left.join(right, on, "full_outer"), [c for c in table.columns if c not in keys]


def once(new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row of each key: the last by ``order``, else by all other columns that can be ordered."""
    rest = [F.col(f.name) if f.dataType.typeName() != "map" else F.array_sort(F.map_entries(f.name)) for f in new.schema if f.name not in keys]
    last = [c.desc_nulls_last() for c in (order or rest)] or [F.lit(0)]
    return first_by(new, keys, last)


def _resolved(table: DataFrame, new: DataFrame, keys: list[str], pick: dict[str, Column], order: list[Column] | None = None) -> DataFrame:
    joined, _ = _joined(table, once(new, keys, order), keys)
    fresh = F.col("__is_old").isNull()
    value = lambda c: F.when(fresh, F.col(f"__n_{c}") if c in new.columns else F.lit(None)).when(F.col("__is_new").isNull(), F.col(c)).otherwise(pick.get(c, F.col(c)))
    return joined.select(*[(F.when(fresh, F.col(f"__n_{c}")).otherwise(F.col(c)) if c in keys else value(c)).alias(c) for c in table.columns])


def upsert(table: DataFrame, new: DataFrame, keys: list[str], fill: bool = False, order: list[Column] | None = None) -> DataFrame:
    """New rows replace those of their key; with ``fill`` a null keeps the old value."""
    rest = [c for c in table.columns if c not in keys and c in new.columns]
    return _resolved(table, new, keys, {c: F.coalesce(f"__n_{c}", c) if fill else F.col(f"__n_{c}") for c in rest}, order)


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows of keys that the table lacks are added, one for each key."""
    right = table.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return table.unionByName(once(new, keys).join(right, on, "left_anti").select(table.columns))


def upsert_if_surer(table: DataFrame, new: DataFrame, keys: list[str], confidence: str, provenance: list[str]) -> DataFrame:
    """Values change always, provenance only with a higher confidence, which never falls."""
    surer = F.col(f"__n_{confidence}") > F.coalesce(F.col(confidence), F.lit(-1.0))
    pick = {c: F.coalesce(f"__n_{c}", c) for c in table.columns if c in new.columns and c not in keys}
    pick |= {c: F.when(surer, F.col(f"__n_{c}")).otherwise(F.col(c)) for c in provenance}
    return _resolved(table, new, keys, pick | {confidence: F.greatest(confidence, f"__n_{confidence}")}, [F.col(confidence)] + [F.col(c) for c in new.columns if c not in (confidence, *keys)])


def newer_wins(table: DataFrame, new: DataFrame, keys: list[str], at: str, maps: list[str] | None = None) -> DataFrame:
    """A row moves forward in time only; map columns are merged, the newer side last."""
    newer = F.col(f"__n_{at}") > F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp_ntz"))
    pick = {c: F.when(newer, F.col(f"__n_{c}")).otherwise(F.col(c)) for c in table.columns if c in new.columns and c not in keys}
    for m in maps or []:
        old, fresh = F.coalesce(F.col(m), F.create_map().cast("map<string,string>")), F.coalesce(F.col(f"__n_{m}"), F.create_map().cast("map<string,string>"))
        pick[m] = merged(old, fresh)
    return _resolved(table, new, keys, pick, [F.col(at)] + [F.col(c) for c in new.columns if c not in (at, *keys, *(maps or []))])


def merged(a: Column, b: Column) -> Column:
    """Two maps, the second's entries over the first's."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def fill_blanks(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only nulls and empty texts are filled in; no row is added."""
    known, rest = _joined(table, once(new, keys), keys)
    known = known.where("__is_old IS NOT NULL")
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if dict(table.dtypes)[c] == "string" else F.col(c)
    return known.select(*[F.coalesce(blank(c), F.col(f"__n_{c}")).alias(c) if c in rest and c in new.columns else F.col(c) for c in table.columns])


def update_distinct(table: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Copies of a value follow their source; ``changed`` marks the rows that weren't the same."""
    right = once(new.select(key, column), [key]).select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    out = table.join(right, F.col(key) == F.col("__k"), "left")
    moved = F.col("__k").isNotNull() & ~F.col(column).eqNullSafe(F.col("__v"))
    return out.withColumn("changed", moved).withColumn(column, F.when(moved, F.col("__v")).otherwise(F.col(column))).drop("__k", "__v")


def replace_source(table: DataFrame, new: DataFrame, tag: str, source: str) -> DataFrame:
    """All rows of one source go, and its new rows come."""
    return table.where(~F.col(tag).eqNullSafe(F.lit(source))).unionByName(new.select(table.columns))


def soft_close(table: DataFrame, seen: DataFrame, keys: list[str], ended: str, at: Column, scope: Column | None = None) -> DataFrame:
    """Open rows (of the scope) that weren't seen end now."""
    right = seen.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__seen", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    gone = F.col("__seen").isNull() & F.col(ended).isNull() & (F.lit(True) if scope is None else scope)
    return table.join(right, on, "left").withColumn(ended, F.when(gone, at).otherwise(F.col(ended))).select(table.columns)


def counted(rows: DataFrame, label: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The rows, and counts of them by condition that are known once they were written.

    The counts come with the write itself, so a chain of updates reports what each
    of its steps did without another pass.
    """
    seen = Observation(label)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()]), seen


def last_winners(mapping: DataFrame) -> DataFrame:
    """``loser, winner`` with every winner one that loses to none itself.

    Of several winners of a loser the least counts; pairs with themselves or with
    a null say nothing. Each round every winner takes its own winner's place, so a
    chain of n merges takes log2(n) rounds, each of one join; raises on a cycle.
    """
    own = Workspace(mapping.sparkSession, "merges")
    first = mapping.where("loser <> winner").groupBy("loser").agg(F.min("winner").alias("winner"))
    pairs, length = own.keep(first, "1"), 1
    while True:
        further = pairs.select(F.col("loser").alias("__l"), F.col("winner").alias("__w"))
        step = pairs.join(further, F.col("winner") == F.col("__l"), "left")
        step = own.keep(step.select("loser", F.coalesce("__w", "winner").alias("winner"), F.col("__w").isNotNull().alias("moved")), str(2 * length))
        total, moved = step.agg(F.count(F.lit(1)), F.count_if("moved")).first()
        own.drop(str(length))
        if not moved:
            return step.drop("moved")
        if length > total:  # any chain would have ended
            raise ValueError("merges go round in a circle")
        pairs, length = step.drop("moved"), 2 * length


def merge_entities(children: DataFrame, mapping: DataFrame, key: str, unique: list[str]) -> DataFrame:
    """Children of losers move to their last winners (``loser, winner``, see ``last_winners``); rows that then repeat go."""
    moved = children.join(last_winners(mapping), F.col(key) == F.col("loser"), "left").withColumn(key, F.coalesce("winner", key))
    return moved.select(children.columns).dropDuplicates(unique)


def apply_batch(table: DataFrame, ids: list, values: list, key: str, column: str) -> DataFrame:
    """Set ``column`` for a batch of ids, given as two lists of equal length; None sets a null.

    Of an id given twice the last value counts.
    """
    spark = table.sparkSession
    kinds = dict(table.dtypes)
    last = dict(zip(ids, values, strict=True))
    pairs = spark.createDataFrame([(list(last), list(last.values()))], f"__i array<{kinds[key]}>, __v array<{kinds[column]}>").select(F.inline(F.arrays_zip("__i", "__v")))
    out = table.join(pairs.withColumn("__set", F.lit(True)), F.col(key) == F.col("__i"), "left")
    return out.withColumn(column, F.when(F.col("__set"), F.col("__v")).otherwise(F.col(column))).drop("__i", "__v", "__set")
