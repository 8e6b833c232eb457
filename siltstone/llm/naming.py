"""Exact deduplication by deterministic block naming (operator 2).

Every normalised text is cut into blocks of a fixed size. Sorting the distinct
blocks gives each an integer name; then the names of adjacent blocks are paired
and the distinct pairs sorted and named in turn, level by level, until one name
is left for each document. A name stands for exactly one string of blocks, so
two documents of one level and name are equal, with no reliance on a hash: a
hash orders blocks and pairs, and where two different ones share a hash, they
are sorted by themselves and get names of their own.

All steps are DataFrame operations. Only distinct blocks and pairs are sorted, so
copies of one text, however many, are one row there; names find their way back
to the rows by a join on the hash, whose rows are narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.columns import quoted, unused
from siltstone.llm.scratch import Scratch

BLOCK_CHARS = 2048
#: Distinct blocks are sorted in so many parts, by the leading bits of their hash.
BUCKET_BITS = 20
#: The characters of [\\x20\\x09-\\x0D].
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def blocks_of(body: Column, block_chars: int) -> Column:
    """Consecutive blocks of ``block_chars`` code points; an empty text is one empty block."""
    return F.when(body == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))


def hashed(*values: Column | str) -> Column:
    """What blocks and pairs are sorted by; two different ones may share it."""
    return F.xxhash64(*values)


def _named(rows: DataFrame, valued: DataFrame, values: list[str], place: list[str], scratch: Scratch, label: str) -> DataFrame:
    """Give equal ``values`` one positive name; a table of the columns of ``rows`` less ``key``, and ``name``.

    ``rows`` have the ``key`` of their values; ``valued`` have the values too, and
    ``place`` says which of them belong to which row. A name is a bucket's number
    and a place in its sorted order, so it does not depend on how tasks run.
    """
    distinct = valued.select("key", *values).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.shiftrightunsigned("key", 64 - BUCKET_BITS)
    before = Window.partitionBy(bucket).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    first = bucket * (1 << 40) + F.coalesce(F.sum("n").over(before), F.lit(0)) + 1
    names = scratch.keep(distinct.select(F.col("key").alias("of"), "n", first.alias("name")), f"{label}-names")
    out = rows.join(names, F.col("key") == F.col("of"))
    several = names.where("n > 1").select(F.col("of").alias("of2"))
    if several.isEmpty():
        return scratch.keep(out.select(*[c for c in rows.columns if c != "key"], "name"), label)
    # Different values of one hash: each takes its place among them.
    met = valued.join(several, F.col("key") == F.col("of2")).select(*place, "key", *values).distinct()
    ranked = met.select(*place, (F.dense_rank().over(Window.partitionBy("key").orderBy(*values)) - 1).alias("more"))
    ranked = scratch.keep(ranked.select(*[F.col(c).alias(f"p_{c}") for c in place], "more").distinct(), f"{label}-ranks")
    out = out.join(ranked, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in place], "left")
    name = F.col("name") + F.coalesce("more", F.lit(0))
    return scratch.keep(out.select(*[c for c in rows.columns if c != "key"], name.alias("name")), label)


def _identities(docs: DataFrame, facts: DataFrame, scratch: Scratch, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """``place, level, name`` for each row of ``facts``: texts are equal exactly if level and name are."""
    rows = facts.select("row_id", "row_key", "place", (F.size("keys") - 1).alias("last"), F.posexplode("keys").alias("at", "key"))
    bodies = docs.select(F.col(quoted(id_col)).alias("row_id"), row_key(text_col), normalised(F.col(quoted(text_col))).alias("body"))
    valued = bodies.select("row_id", "row_key", F.posexplode(blocks_of(F.col("body"), block_chars)).alias("at", "block")).withColumn("key", hashed("block"))
    names, level, done = _named(rows, valued, ["block"], ["row_id", "row_key", "at"], scratch, "level0"), 0, None
    while True:
        # The last name of a row is its identity; the others are paired with their neighbours.
        ended = names.where("last = 0").select("place", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        going = names.where("last > 0")
        if going.isEmpty():
            return done
        level += 1
        side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = going.groupBy("place", F.shiftright("last", 1).alias("last"), F.shiftright("at", 1).alias("at")).agg(side(0).alias("left"), side(1).alias("right"))
        pairs = scratch.keep(pairs.withColumn("key", hashed("left", "right")), f"pairs{level}")
        names = _named(pairs.drop("left", "right"), pairs, ["left", "right"], ["place", "at"], scratch, f"level{level}")


def row_key(text_col: str) -> Column:
    """A hash of the text that tells rows of one id apart."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return F.xxhash64(text, F.length(text)).alias("row_key")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are without white space. Of equal texts the row with
    the most code points stays, then the one with the smallest id; a null id is
    larger than any. Null texts are empty, and all empty texts are one group.
    ``group_size`` counts rows. Of rows repeated in id and text, all are
    ``kept`` if that id and text are what stays. An empty table gives an empty
    one; other columns are not read.
    """
    return _groups(docs, Scratch(docs.sparkSession, "exact"), id_col, text_col, block_chars).select(
        F.col("row_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"
    )


def _groups(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    bodies = docs.select(F.col(quoted(id_col)).alias("row_id"), row_key(text_col), F.coalesce(F.length(quoted(text_col)), F.lit(0)).alias("chars"), normalised(F.col(quoted(text_col))).alias("body"))
    keys = F.transform(blocks_of(F.col("body"), block_chars), lambda b: hashed(b))
    facts = bodies.select("row_id", "row_key", "chars", F.unhex(F.sha2("body", 256)).alias("digest"), keys.alias("keys"))
    facts = scratch.keep(facts.withColumn("place", F.monotonically_increasing_id()), "facts")
    named = _identities(docs, facts, scratch, id_col, text_col, block_chars).withColumnRenamed("place", "p")
    facts = scratch.keep(facts.drop("keys").join(named, F.col("place") == F.col("p")).drop("place", "p"), "named")
    rank = F.struct((-F.col("chars")).alias("less"), F.col("row_id").isNull().alias("none"), "row_id", "row_key")
    groups = facts.groupBy(F.col("level").alias("l"), F.col("name").alias("n")).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = scratch.keep(groups.select("l", "n", F.col("best.row_id").alias("keep"), F.col("best.row_key").alias("keep_key"), "size"), "groups")
    joined = facts.join(groups, (F.col("level") == F.col("l")) & (F.col("name") == F.col("n")), "left")
    alone = F.col("size").isNull()
    return joined.select(
        "row_id",
        "row_key",
        F.when(alone, F.col("row_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_id").eqNullSafe(F.col("keep")) & (F.col("row_key") == F.col("keep_key")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, once each, all columns as they are.

    Rows repeated in id and text are one row here; which of them stays is open
    if other columns differ. Nulls, empty and long texts, ties and empty tables
    are as in ``exact_groups``; other columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    groups = scratch.keep(_groups(docs, scratch, id_col, text_col, block_chars), "result")
    own_id, own_key = unused(docs, "id", "key")
    here = (F.col(quoted(id_col)).eqNullSafe(F.col(own_id))) & (row_key(text_col) == F.col(own_key))
    named = lambda rows: rows.select(F.col("row_id").alias(own_id), F.col("row_key").alias(own_key))
    kept = docs.join(named(groups.where("NOT kept").distinct()), here, "left_anti")
    twice = scratch.keep(groups.where("kept AND group_size > 1").groupBy("row_id", "row_key").count().where("count > 1"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(named(twice), here, "left_semi").withColumn(own_key, row_key(text_col)).dropDuplicates([id_col, own_key]).drop(own_key)
    return kept.join(named(twice), here, "left_anti").unionByName(once)
