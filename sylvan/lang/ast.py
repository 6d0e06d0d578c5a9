"""Syntax trees of queries.  All nodes are immutable values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Matcher:
    kind: str  # name, glob, regex, any
    text: str = ""


@dataclass(frozen=True)
class Step:
    """One hop: axis, what its targets must match, and which of them stay."""

    axis: str  # child desc parent anc next prev follow precede out in both resolve rresolve group mark
    matcher: Matcher = Matcher("any")
    traits: tuple = ()  # conjunction of alternatives: ((negated, name), ...)
    preds: tuple = ()
    reach: str = ""  # "", "?", "!"
    leaf: bool = False
    prop: str = ""  # resolve: the property
    alts: tuple = ()  # group: alternative step tuples
    low: int = 1  # group: repetitions
    high: int | None = 1
    push: tuple = ()  # group: ((name, expr), ...)


@dataclass(frozen=True)
class Projection:
    kind: str  # prop default meta ameta edge edges
    name: str = ""


@dataclass(frozen=True)
class Path:
    anchor: tuple = ()  # () here, ("root",), ("mark", name or number)
    steps: tuple = ()
    projection: Projection | None = None


@dataclass(frozen=True)
class Stage:
    pipe: str  # | @| $|
    op: str  # filter nav push pushtopic expr call spread at slice subst
    name: str = ""
    args: tuple = ()
    expr: object = None


@dataclass(frozen=True)
class Query:
    branches: tuple
    correlations: tuple = ()  # ((outer, Query), ...)
    pipeline: tuple = ()


@dataclass(frozen=True)
class Lit:
    value: object
    quoted: bool = False


@dataclass(frozen=True)
class Shaped:
    """A bare literal with a shape: an instant, a span of time or a quantity."""

    kind: str
    text: str


@dataclass(frozen=True)
class Ref:
    """topic, ord, reg, regs, record, capture, input, witness, edge, edges."""

    kind: str
    key: object = None
    path: Path | None = None


@dataclass(frozen=True)
class Outer:
    expr: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Interp:
    parts: tuple


@dataclass(frozen=True)
class Rec:
    fields: tuple  # ((name, expr), ...)


@dataclass(frozen=True)
class Inline:
    """(expr | stage @| stage): a pipeline within an expression."""

    expr: object
    stages: tuple


@dataclass(frozen=True)
class Range:
    low: int | None
    high: int | None


@dataclass(frozen=True)
class Sub:
    """A subcontext: a whole query as a value."""

    query: Query


@dataclass(frozen=True)
class Fragment:
    name: str
    params: tuple
    body: str
    kind: str = "def"  # def macro
    aware: bool = False
    extra: tuple = field(default=())


def walk(node):
    """The node and all nodes below it."""
    yield node
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif hasattr(node, "__dataclass_fields__"):
        for name in node.__dataclass_fields__:
            x = getattr(node, name)
            if isinstance(x, tuple) or hasattr(x, "__dataclass_fields__"):
                yield from walk(x)
