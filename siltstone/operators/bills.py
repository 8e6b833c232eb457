"""Stages of bills from the pages that list them, by each page's own structure.

Three layouts: a bill's page with a table of two cells a row, a label and a date; a
dashboard of many bills, each stage a block with a code, a date and a status; and a
printed status table, in which a bill's dates stand in the order of its stages. A
page that has none of these is for ``chunks.stage_events``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.strings import collapse, decoded

#: The labels of a bill's page and the stages they stand for.
LABELS = {
    "first reading": "first_reading", "second reading": "second_reading", "second reading debates": "second_reading", "second reading passed": "second_reading_passed",
    "law amendments committee": "committee", "public bills committee": "committee", "private and local bills": "committee", "private & local bills": "committee",
    "committee of the whole house": "committee_whole", "third reading": "third_reading", "third reading debates": "third_reading", "royal assent": "royal_assent",
    "withdrawn": "withdrawn", "defeated": "defeated", "introduced": "introduced",
}
#: Labels that a page's legend repeats; without a date they are no event.
LEGEND = ("first reading", "second reading", "committee", "third reading", "royal assent")
#: The codes of a dashboard.
CODES = {"r1r": "first_reading", "r2r": "second_reading", "rcw": "committee", "r3r": "third_reading", "rra": "royal_assent", "rcf": "comes_into_force"}
#: The stages of a printed table's columns, in order.
COLUMNS = ("first_reading", "second_reading", "committee", "third_reading", "royal_assent", "in_effect")
#: The lines of a printed page's head, and how others of them begin; months in brackets begin some too.
HEAD_LINES = ("", "bill", "no.", "1st", "2nd", "committee/", "stage", "amend.", "reading", "concurrence", "and 3rd", "royal", "assent", "in", "effect", "reported", "government bills", "private bills", "private members bills", "private members' bills")
HEAD_BEGINNINGS = ("bill status 2", "legislative assembly of ", "status of bills", "first session", "second session", "third session", "fourth session", "fifth session", "title sponsor", "amended report")
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DATE = r"(?i)\b(" + "|".join(_MONTHS) + r")[a-z]*\.?\s+(\d{1,2})[.,]\s*(\d{4})\b"


def _day_of(text: Column) -> Column:
    """The first date in a text such as September 23, 2025 or Nov. 18. 2025; null without one."""
    month = F.array_position(F.lit(_MONTHS), F.lower(F.regexp_extract(text, _DATE, 1))).cast("string")
    parts = F.concat_ws("-", F.regexp_extract(text, _DATE, 3), month, F.regexp_extract(text, _DATE, 2))
    return F.try_to_timestamp(parts, F.lit("yyyy-M-d")).cast("date")


def _bare(html: Column) -> Column:
    return collapse(decoded(F.regexp_replace(html, r"<[^>]+>", " ")))


def _known(value: Column, known: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(value))


def _numbered(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events once each by stage and day, numbered in the order in which they stand."""
    once = events.groupBy(*keys, "stage", "day").agg(F.min("at").alias("at"), F.min_by("label", "at").alias("label"), F.min_by("status", "at").alias("status"))
    return once.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).alias("sequence"), "stage", "label", "day", "status")


def page_stages(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, sequence, stage, label, day, status`` of a bill's page: table rows of a label and what holds a date.

    Rows of another label are none, nor are a legend's, which have no date; other
    labels without a date are events of no day. A stage of one day counts once.
    """
    rows = pages.select(key, F.posexplode(F.split(html, "(?i)<tr")).alias("at", "r"))
    rows = rows.select(key, "at", F.regexp_extract_all("r", F.lit("(?is)<td[^>]*>(.*?)</td"), F.lit(1)).alias("cells")).where(F.size("cells") == 2)
    rows = rows.select(key, "at", _bare(F.col("cells")[0]).alias("label"), _bare(F.col("cells")[1]).alias("body"))
    rows = rows.withColumns({"stage": _known(F.col("label"), LABELS), "day": _day_of(F.col("body")), "status": F.lit(None).cast("string")})
    return _numbered(rows.where(F.col("stage").isNotNull() & (F.col("day").isNotNull() | ~F.lower("label").isin(*LEGEND))), [key])


def dashboard_stages(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, bill, sequence, stage, label, day, status`` of a dashboard: ``bill`` is the id of its anchor.

    A stage of a code that isn't known is ``other``. Blocks without a code, and what
    stands before the first bill, are none.
    """
    blocks = pages.select(key, F.explode(F.slice(F.split(html, '(?i)id="g(?=[0-9])'), 2, 1 << 20)).alias("b"))
    entries = blocks.select(key, F.substring_index("b", '"', 1).alias("bill"), F.posexplode(F.split("b", '(?i)class="b_entry')).alias("at", "e")).where("at > 0")
    value = lambda before, what: F.regexp_extract("e", f"(?is){before}{what}", 1)
    inside = lambda name: _bare(value(f'class="{name}"[^>]*>', "(.*?)</div"))
    rows = entries.withColumns({"code": value('class="reading ', r"(\w+)"), "label": decoded(value('title="', '([^"]*)'))}).where("code <> ''")
    rows = rows.withColumns({"stage": F.coalesce(_known(F.col("code"), CODES), F.lit("other")), "day": _day_of(inside("b_date")), "status": F.nullif(inside("b_status"), F.lit(""))})
    return _numbered(rows, [key, "bill"])


def printed_stages(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, bill, sequence, stage, label, day, status`` of a printed status table.

    A bill begins with its number and title; its dates follow in the order of the
    columns, and a date that stands there twice in a row is one. Page heads and
    titles between are left out. A formal bill has its first stage only.
    """
    plain = lambda line: F.lower(F.trim(line))
    head = lambda line: plain(line).isin(*HEAD_LINES) | reduce(lambda a, b: a | b, [F.startswith(plain(line), F.lit(x)) for x in (*HEAD_BEGINNINGS, *(f"({m}" for m in _MONTHS))])
    clean = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: ~head(line)), "\n")
    blocks = texts.select(key, F.explode(F.split(clean, r"(?m)^(?=\d{1,4}\s+[A-Z])")).alias("b")).where(F.col("b").rlike(r"^\d{1,4}\s+[A-Z]"))
    found = F.filter(F.transform(F.regexp_extract_all("b", F.lit(_DATE), F.lit(0)), _day_of), lambda d: d.isNotNull())
    once = F.filter(found, lambda d, i: (i == 0) | (d != F.get(found, i - 1)))
    rows = blocks.select(key, F.regexp_extract("b", r"^(\d+)", 1).alias("bill"), F.when(F.upper("b").contains("FORMAL BILL"), F.slice(once, 1, 1)).otherwise(F.slice(once, 1, len(COLUMNS))).alias("days"))
    each = rows.select(key, "bill", F.posexplode("days").alias("sequence", "day"))
    stage = F.get(F.lit(list(COLUMNS)), F.col("sequence"))
    return each.select(key, "bill", "sequence", stage.alias("stage"), F.initcap(F.replace(stage, F.lit("_"), F.lit(" "))).alias("label"), "day", F.lit(None).cast("string").alias("status"))
