"""A query as data: its syntax tree in JSON, which shreds into an arbor."""

from __future__ import annotations

import json


def as_value(x):
    if isinstance(x, tuple):
        return [as_value(v) for v in x]
    if hasattr(x, "__dataclass_fields__"):
        return {"kind": type(x).__name__.lower()} | {n: as_value(getattr(x, n)) for n in x.__dataclass_fields__ if getattr(x, n) not in ((), "", None)}
    return x


def as_json(query) -> str:
    return json.dumps(as_value(query))
