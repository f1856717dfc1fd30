"""What the parser makes: statements, and the parts of a query."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.aggregates import Agg
from ..functions.predicates import Op


@dataclass(frozen=True)
class Scan:
    table: str
    alias: str


@dataclass(frozen=True)
class Filter:
    column: str
    op: Op
    value: Any


@dataclass(frozen=True)
class Join:
    left: str
    op: Op
    right: str | Query  # a column, or a subquery


@dataclass(frozen=True)
class Item:
    column: str  # "*" for all
    fn: Agg | None = None


@dataclass
class Query:
    items: list[Item]
    scans: list[Scan]
    filters: list[Filter] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    group: str | None = None
    order: str | None = None
    ascending: bool = True

    @property
    def aggregate(self) -> Item | None:
        return next((i for i in self.items if i.fn), None)


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple | None = None
    query: Query | None = None


@dataclass(frozen=True)
class Delete:
    table: Scan
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Control:
    """BEGIN (set transaction), COMMIT or ROLLBACK."""

    what: str
