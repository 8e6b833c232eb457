"""What changed: between consecutive observations, and between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_previous(rows: DataFrame, keys: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    """Add ``prev``, the given columns of the row before (null for the first of a key)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("prev", F.lag(F.struct(*columns)).over(w))


def field_change(old: Column, new: Column, kind: str, severity: Column | str) -> Column:
    """A change record, or null if both are the same; null and empty are the same."""
    a, b = F.coalesce(old.cast("string"), F.lit("")), F.coalesce(new.cast("string"), F.lit(""))
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(a != b, F.struct(F.lit(kind).alias("kind"), a.alias("old"), b.alias("new"), level.alias("severity")))


def tier_change(old: Column, new: Column) -> Column:
    """Both must be known; two steps or more are major."""
    level = F.when(F.abs(new - old) >= 2, "major").otherwise("notable")
    return F.when(old.isNotNull() & new.isNotNull(), field_change(old, new, "tier_changed", level))


def set_change(old: Column, new: Column, kind: str = "ip_changed") -> Column:
    """A change of an unordered set; a new order is no change."""
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(F.coalesce(a, F.array().cast("array<string>")))), ",")
    return field_change(text(old), text(new), kind, "info")


def added_and_removed(old: Column, new: Column) -> Column:
    """What a set has gained and lost, sorted; nulls are empty sets."""
    some = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    return F.struct(F.array_sort(F.array_except(some(new), some(old))).alias("added"), F.array_sort(F.array_except(some(old), some(new))).alias("removed"))


def exploded(rows: DataFrame, changes: list[Column], keep: list[str]) -> DataFrame:
    """A row for each change that isn't null."""
    found = F.filter(F.array(*changes), lambda c: c.isNotNull())
    return rows.select(*keep, F.explode(found).alias("c")).select(*keep, "c.*")


#: The facts of a scan and how severe their changes are; the tier's depends on the step, sets are ``info``.
SCAN_FIELDS = {"country": "major", "city": "notable", "provider": "major", "cdn": "info", "cms": "info", "tls_issuer": "info"}


def scan_changes(scans: DataFrame, site: str = "site_id", at: str = "scanned_at") -> DataFrame:
    """Changes between each site's consecutive scans; the first scan has none.

    Facts of ``SCAN_FIELDS`` that the scans lack aren't compared. ``kind, old,
    new, severity`` and, for addresses, what was added and removed.
    """
    fields = [f for f in SCAN_FIELDS if f in scans.columns]
    rows = with_previous(scans, [site], [at], [*fields, "tier", "ips"]).where("prev IS NOT NULL")
    old, new = (lambda c: F.col(f"prev.{c}")), F.col
    changes = [field_change(old(c), new(c), f"{c}_changed", SCAN_FIELDS[c]) for c in fields]
    changes += [tier_change(old("tier"), new("tier")), set_change(old("ips"), new("ips"))]
    rows = rows.withColumn("ip_sets", added_and_removed(old("ips"), new("ips")))
    out = exploded(rows, changes, [site, at, "ip_sets"])
    moved = F.col("kind") == "ip_changed"
    return out.select(site, at, "kind", "old", "new", "severity", F.when(moved, F.col("ip_sets.added")).alias("added"), F.when(moved, F.col("ip_sets.removed")).alias("removed"))


def roster_changes(before: DataFrame, after: DataFrame, key: str, fields: dict[str, tuple[str, str]], complete: bool = True) -> DataFrame:
    """Changes between two rosters: new, retired, and each of ``fields`` (its kind and severity).

    Values are trimmed and empty ones are null. A new entry has no other change.
    Nobody retires unless ``after`` is ``complete``.
    """
    clean = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    old = before.select(F.col(key).alias("__k"), F.lit(True).alias("__was"), *[clean(f).alias(f"old_{f}") for f in fields])
    new = after.select(key, F.lit(True).alias("__is"), *[clean(f).alias(f"new_{f}") for f in fields])
    both = new.join(old, F.col(key) == F.col("__k"), "full_outer").withColumn(key, F.coalesce(key, "__k"))
    record = lambda kind, level: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("old"), F.lit("").alias("new"), F.lit(level).alias("severity"))
    seen = F.col("__was").isNotNull() & F.col("__is").isNotNull()
    changes = [F.when(F.col("__was").isNull(), record("newly_elected", "major"))]
    if complete:
        changes.append(F.when(F.col("__is").isNull(), record("retired", "notable")))
    changes += [F.when(seen, field_change(F.col(f"old_{f}"), F.col(f"new_{f}"), kind, level)) for f, (kind, level) in fields.items()]
    return exploded(both, changes, [key])
