"""Names to entities: exact before loose, and never a guess between two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.strings import last_token, normalised_name, presiding_name
from siltstone.operators.latest import first_by


def name_index(entities: DataFrame, key: str, variants: list[tuple[str, int]]) -> DataFrame:
    """``variant, priority, key`` for variants that name one entity only.

    ``variants`` are columns with their priorities; each entity gives a row for
    each of them that isn't blank.
    """
    rows = entities.select(key, F.explode(F.array(*[F.struct(F.col(c).alias("variant"), F.lit(p).alias("priority")) for c, p in variants])).alias("v"))
    rows = rows.select("v.variant", "v.priority", key).where("variant IS NOT NULL AND variant <> ''")
    found = rows.groupBy("variant", "priority").agg(F.count_distinct(key).alias("__n"), F.min(key).alias(key))
    return found.where("__n = 1").drop("__n")


def cascade(mentions: DataFrame, entities: DataFrame, mention_id: str, key: str, ladder: list[tuple[str, str, float]]) -> DataFrame:
    """Resolve mentions by a ladder of (mention column, entity column, confidence).

    A mention takes the first step on which any entity has its value. If that is
    one entity, it is the answer; if it is several, the mention stays open, and
    no looser step is tried. Adds ``key, step, confidence``.
    """
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(m).alias("value")) for i, (m, _, _) in enumerate(ladder)]))
    asked = mentions.select(mention_id, tries.alias("t")).select(mention_id, "t.*").where("value IS NOT NULL AND value <> ''")
    known = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(e).alias("value")) for i, (_, e, _) in enumerate(ladder)]))
    known = entities.select(key, known.alias("t")).select(key, "t.*").where("value IS NOT NULL AND value <> ''")
    known = known.groupBy("step", "value").agg(F.count_distinct(key).alias("__n"), F.min(key).alias(key))
    first = first_by(asked.join(known, ["step", "value"]), [mention_id], [F.col("step")])
    sure = F.create_map(*[F.lit(x) for i, (_, _, c) in enumerate(ladder) for x in (i, c)])
    first = first.where("__n = 1").select(F.col(mention_id).alias("__m"), key, "step", sure[F.col("step")].alias("confidence"))
    return mentions.join(first, F.col(mention_id) == F.col("__m"), "left").drop("__m")


def by_key_then_name(rows: DataFrame, entities: DataFrame, row_id: str, key: str, slug: str, name: str) -> DataFrame:
    """By a slug that one entity has, else by a name that one has; ``learned`` says the slug can be written back.

    A slug or a name of several entities decides nothing, and every row stays one
    row. Of a slug that several have nothing is learned either.
    """
    single = lambda c, to, out: entities.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(to)).agg(F.count_distinct(key).alias("__n"), F.min(key).alias(out))
    by_slug = single(slug, "__slug", "__by_slug").withColumns({"__by_slug": F.when(F.col("__n") == 1, F.col("__by_slug")), "__shared": F.col("__n") > 1}).drop("__n")
    by_name = single(name, "__name", "__by_name").where("__n = 1").drop("__n")
    out = rows.join(by_slug, F.col(slug) == F.col("__slug"), "left").join(by_name, F.col(name) == F.col("__name"), "left")
    learned = F.col("__by_slug").isNull() & F.col("__by_name").isNotNull() & ~F.coalesce("__shared", F.lit(False))
    return out.select(*rows.columns, F.coalesce("__by_slug", "__by_name").alias(key), learned.alias("learned"))


def any_key(rows: DataFrame, keys: list[Column], row_id: str, entities: DataFrame, entity_key: str, key: str) -> DataFrame:
    """Pairs that agree on any of several keys, once each: an equality join on exploded keys."""
    asked = rows.select(row_id, F.explode(F.array_distinct(F.array(*keys))).alias("__k")).where("__k IS NOT NULL")
    return asked.join(entities.select(F.col(entity_key).alias("__k"), key), "__k").select(row_id, key).distinct()


def duplicate_pairs(a: DataFrame, b: DataFrame, key: str, name: Column) -> DataFrame:
    """``loser, winner``: entities of two sources with one normalised name."""
    left, right = a.select(F.col(key).alias("loser"), name.alias("__name")), b.select(F.col(key).alias("winner"), name.alias("__name"))
    return left.join(right, "__name").where("loser <> winner").select("loser", "winner")


def presiding(mentions: DataFrame, entities: DataFrame, mention_id: str, key: str, line: str, full: str, last: str) -> DataFrame:
    """The persons named in brackets behind a chair's title: by full name, else by a surname that one has.

    Lines of any other shape, and names that two have, stay open.
    """
    name = normalised_name(F.regexp_replace(presiding_name(line), r"^(?i)(mr|mrs|ms|miss|dr|hon)\.?\s+", ""))
    asked = mentions.withColumn("__name", F.nullif(name, F.lit(""))).withColumn("__last", last_token(F.col("__name")))
    return cascade(asked, entities, mention_id, key, [("__name", full, 1.0), ("__last", last, 0.9)]).drop("__name", "__last")


def valid_pairs(pairs: DataFrame, a: str, b: str, known: DataFrame, key: str) -> DataFrame:
    """``canonical_pairs`` of which both sides are ``key`` of ``known``: what a model made up goes."""
    ids = known.select(F.col(key).alias("__k")).distinct()
    out = canonical_pairs(pairs, a, b)
    for side in (a, b):
        out = out.join(ids, F.col(side) == F.col("__k"), "left_semi")
    return out


def canonical_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs, once each, without self pairs."""
    out = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    return out.distinct()


def pairs_within(rows: DataFrame, groups: list[str], key: str, a: str, b: str) -> DataFrame:
    """``canonical_pairs`` of the keys that share a group: each is made once, in its order.

    Only two keys that are both in several groups can meet more than once, and only
    such pairs are told apart; so no task holds all pairs. Null groups and keys pair with none.
    """
    own = F.struct(*groups)
    whole = rows.select(key, own.alias("__g")).where(F.col(key).isNotNull())
    for g in groups:
        whole = whole.where(F.col(f"__g.{g}").isNotNull())
    each = whole.groupBy(key).agg(F.collect_set("__g").alias("__all")).select(key, (F.size("__all") > 1).alias("__several"), F.explode("__all").alias("__g"))
    side = lambda name, flag: each.select(F.col(key).alias(name), F.col("__several").alias(flag), "__g")
    met = side(a, "__m").join(side(b, "__n"), "__g").where(F.col(a) < F.col(b))
    again = F.col("__m") & F.col("__n")
    return met.where(~again).select(a, b).unionByName(met.where(again).select(a, b).distinct())
