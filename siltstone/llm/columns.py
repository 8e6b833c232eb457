"""Small helpers on columns and sizes that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name for select and expr, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(docs: DataFrame, *names: str) -> list[str]:
    """For each of ``names`` a name like it that no column of ``docs`` has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` less the columns with ``names``, whatever their case: an operator's own take their place."""
    gone = {n.lower() for n in names}
    return docs.select(*[quoted(c) for c in docs.columns if c.lower() not in gone])


def type_of(docs: DataFrame, column: str) -> str:
    return docs.select(quoted(column)).schema[0].dataType.simpleString()


def parts_for(docs: DataFrame, text_col: str, part_bytes: int, factor: float = 1.0) -> int:
    """So many partitions that each gets about ``part_bytes`` of ``factor`` times the text."""
    total = docs.select(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total * factor) // part_bytes))


#: What a task hands to Python at a time, at most: so its memory doesn't follow the texts' lengths.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def map_arrow(rows: DataFrame, run: Callable, schema: object) -> DataFrame:
    """``mapInArrow`` with small batches. The session's limits are lowered to these, never raised."""
    conf = rows.sparkSession.conf
    for key, most in BATCH_LIMITS.items():
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return rows.mapInArrow(run, schema)
