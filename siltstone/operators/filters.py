"""The conjunctive filter of a search request, as columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A request may name so many entities at most.
MOST_ENTITIES = 10


@dataclass(frozen=True)
class SearchFilter:
    """What a request restricts; None restricts nothing.

    ``columns`` maps the names below to the columns of a table.
    """

    language: str | None = None
    level: str | None = None
    region: str | None = None
    party: str | None = None
    entities: tuple[int | str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def _column(self, name: str) -> Column:
        return F.col(self.columns.get(name, name))

    def conditions(self) -> list[Column]:
        out = [self._column(n) == v for n in ("language", "level", "region", "party") if (v := getattr(self, n)) is not None]
        if ids := list(dict.fromkeys(self.entities)):
            if len(ids) > MOST_ENTITIES:
                raise ValueError(f"at most {MOST_ENTITIES} entities")
            out.append(self._column("entity").isin(ids))
        day = self._column("date")
        if self.date_from:
            out.append(day >= F.lit(self.date_from).cast("timestamp_ntz"))
        if self.date_to:  # the whole last day
            out.append(day < F.lit(self.date_to).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
        return out

    def any_structural(self) -> bool:
        return bool(self.conditions())

    def apply(self, rows: DataFrame) -> DataFrame:
        return reduce(lambda df, c: df.where(c), self.conditions(), rows)


def require_something(search: str | None, request: SearchFilter) -> None:
    """A request needs words or at least one restriction."""
    if not (search or "").strip() and not request.any_structural():
        raise ValueError("give a search text or at least one filter")


def similarity_floor(asked: float | None, least: float = 0.45) -> float:
    return max(least, asked or 0.0)


def optional_equals(column: str, value: object) -> Column:
    """True for all rows if no value is given."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)
