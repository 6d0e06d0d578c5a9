"""The state of a compilation: a DataFrame and what its columns mean."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import Val

_fresh = itertools.count()


class CompileError(ValueError):
    """The query has no plan: it is wrong, or outside what can be planned."""


def fresh(hint: str = "c") -> str:
    return f"_{hint}{next(_fresh)}"


@dataclass(frozen=True)
class Node:
    """A node as columns: of a table row (``source`` a Table) or of an arbor (an Arbor); or a constant place."""

    kind: str  # root, tables, row, arbor
    source: object
    columns: dict[str, str] = field(default_factory=dict)
    catalog: object = None

    def col(self, name: str) -> Column:
        return F.col(self.columns[name])


@dataclass(frozen=True)
class Key:
    """One column of an order."""

    name: str
    descending: bool = False
    nulls_last: bool = False

    def sort(self, flip: bool = False) -> Column:
        c = F.col(self.name)
        if self.descending != flip:
            return c.desc_nulls_last() if self.nulls_last != flip else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last != flip else c.asc_nulls_first()


@dataclass(frozen=True)
class Group:
    """Rows of ``base`` in groups of equal ``keys`` (register name, column); reduced when the next stage says how."""

    base: State
    keys: tuple[tuple[str, str], ...]
    first: str | None = None  # where a stage has dropped members: the group's first place before


@dataclass(frozen=True)
class State:
    df: DataFrame
    node: Node | None = None
    topic: Val | None = None
    regs: tuple[tuple[str, Val], ...] = ()
    order: tuple[Key, ...] = ()
    marks: tuple[tuple[str, Node], ...] = ()
    witnesses: tuple[Node, ...] = ()
    captures: str | None = None
    edge: str | None = None
    edges: str | None = None  # all crossings that ended here, merged by the last hop
    group: Group | None = None
    window: tuple | None = None
    outer: State | None = None

    def but(self, **changes) -> State:
        return replace(self, **changes)

    def add(self, v: Val, hint: str = "v") -> tuple[State, Val]:
        """The state with v as a column of its own."""
        name = fresh(hint)
        return self.but(df=self.df.withColumn(name, v.col)), Val(F.col(name), v.type, v.literal, v.value)

    def rank(self) -> Column | None:
        """One ascending sort value of the order, if it is ascending throughout."""
        if not self.order or any(k.descending for k in self.order):
            return None
        if any(k.nulls_last for k in self.order):
            return F.struct(*[x for k in self.order for x in (F.col(k.name).isNull().alias(f"{k.name}_n"), F.col(k.name))])
        return F.struct(*[F.col(k.name) for k in self.order])

    def sorts(self, flip: bool = False) -> list[Column]:
        return [k.sort(flip) for k in self.order] or [F.lit(0)]
