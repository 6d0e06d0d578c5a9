"""Quantities: a magnitude in base units and the unit it was written in."""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import readings
from .readings import Val

TYPE = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("base", T.StringType()), T.StructField("written", T.DoubleType()), T.StructField("unit", T.StringType())])

# SI prefixes, and units by base unit and factor.
PREFIXES = {"y": 1e-24, "z": 1e-21, "a": 1e-18, "f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "da": 1e1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18, "Z": 1e21, "Y": 1e24}
SI = {"m": ("m", 1.0), "g": ("kg", 1e-3), "s": ("s", 1.0), "A": ("A", 1.0), "K": ("K", 1.0), "mol": ("mol", 1.0), "cd": ("cd", 1.0), "Hz": ("Hz", 1.0), "N": ("N", 1.0), "Pa": ("Pa", 1.0), "J": ("J", 1.0), "W": ("W", 1.0), "C": ("C", 1.0), "V": ("V", 1.0), "F": ("F", 1.0), "L": ("m3", 1e-3), "B": ("B", 1.0)}
OTHER = {"KiB": ("B", 2.0**10), "MiB": ("B", 2.0**20), "GiB": ("B", 2.0**30), "TiB": ("B", 2.0**40), "PiB": ("B", 2.0**50), "min": ("s", 60.0), "h": ("s", 3600.0), "d": ("s", 86400.0), "t": ("kg", 1000.0), "in": ("m", 0.0254), "ft": ("m", 0.3048), "yd": ("m", 0.9144), "mi": ("m", 1609.344), "nmi": ("m", 1852.0), "lb": ("kg", 0.45359237), "oz": ("kg", 0.028349523125), "gal": ("m3", 0.003785411784)}


def unit(name: str) -> tuple[str, float] | None:
    """Base unit and factor of a unit, compound ones with a slash included."""
    if "/" in name:
        parts = [unit(p) for p in name.split("/")]
        if len(parts) != 2 or None in parts:
            return None
        return f"{parts[0][0]}/{parts[1][0]}", parts[0][1] / parts[1][1]
    if name in OTHER:
        return OTHER[name]
    if name in SI:
        return SI[name]
    for n in (2, 1):
        if name[:n] in PREFIXES and name[n:] in SI:
            base, factor = SI[name[n:]]
            return base, PREFIXES[name[:n]] * factor
    return None


def _known() -> list[str]:
    simple = [*OTHER, *SI, *(p + u for p in PREFIXES for u in SI)]
    return simple


_SLOTS = 512


def once(c: Column, f) -> Column:
    """``f`` of the value of ``c``, worked out once a row: a column is planned again wherever it is read."""
    return F.transform(F.array(c), f)[0]


def both(a: Val, b: Val, f) -> Column:
    """``f`` of two quantities' structs, each worked out once; constants stay constants."""
    if a.literal:
        return f(a.col, b.col) if b.literal else once(b.col, lambda y: f(a.col, y))
    return once(a.col, lambda x: f(x, b.col)) if b.literal else once(F.struct(a.col.alias("a"), b.col.alias("b")), lambda p: f(p["a"], p["b"]))


@cache
def _slots() -> str:
    slots: list[dict] = [{} for _ in range(_SLOTS)]
    for u in _known():
        base, factor = unit(u)
        slots[zlib.crc32(u.encode()) % _SLOTS][u] = {"factor": factor, "base": base}
    return json.dumps(slots)


def _lookup(name: Column) -> Column:
    """Factor and base of a simple unit.  A map is searched key by key, so the units are dealt to small maps by a hash; all fold to one literal."""
    slots = F.from_json(F.lit(_slots()), "array<map<string,struct<factor:double,base:string>>>")
    return slots[(F.crc32(name) % _SLOTS).cast("int")][name]


def parse_literal(text: str) -> Val | None:
    m = re.fullmatch(r"\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-zµ][\w/µ]*)\s*", text)
    found = unit(m[2]) if m else None
    if not found:
        return None
    n = float(m[1])
    return Val(F.struct(F.lit(n * found[1]).alias("value"), F.lit(found[0]).alias("base"), F.lit(n).alias("written"), F.lit(m[2]).alias("unit")), TYPE, True, text)


def is_quantity(v: Val) -> bool:
    return v.struct and v.type.names == TYPE.names


def parse(c: Column) -> Column:
    """Text such as ``5km`` or ``90 km/h`` as a quantity; null where it is none."""
    pattern = r"^\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-zµ]+(?:/[A-Za-zµ]+)?)\s*$"

    def scaled(n: Column, name: Column, u: Column) -> Column:
        value = n * u["factor"]
        return F.when(value.isNotNull(), F.struct(value.alias("value"), u["base"].alias("base"), n.alias("written"), name.alias("unit")))

    def read(w: Column) -> Column:
        sides = F.struct(*(_lookup(F.substring_index(w["name"], "/", k)).alias(side) for k, side in ((1, "top"), (-1, "bottom"))))
        compound = once(sides, lambda u: F.struct((u["top"]["factor"] / u["bottom"]["factor"]).alias("factor"), F.concat(u["top"]["base"], F.lit("/"), u["bottom"]["base"]).alias("base")))
        n = F.when(w["n"] != "", w["n"].try_cast("double"))
        return once(F.struct(n.alias("n"), F.when(F.contains(w["name"], F.lit("/")), compound).otherwise(_lookup(w["name"])).alias("u")), lambda r: scaled(r["n"], w["name"], r["u"]))

    words = lambda t: F.struct(F.regexp_extract(t, pattern, 1).alias("n"), F.regexp_extract(t, pattern, 2).alias("name"))
    return once(once(c, words), read)


def convert(q: Column, name: str) -> Column:
    found = unit(name)
    if found is None:
        raise ValueError(f"unknown unit {name!r}")
    return once(q, lambda x: F.when(x["base"] == found[0], F.struct(x["value"].alias("value"), x["base"].alias("base"), (x["value"] / found[1]).alias("written"), F.lit(name).alias("unit"))))


def equal(a: Val, b: Val) -> Column:
    return both(a, b, lambda x, y: F.coalesce((x["base"] == y["base"]) & (x["value"] == y["value"]), F.lit(False)))


def less(op: str, a: Val, b: Val) -> Column:
    """Order of quantities with the same base; any other pair is false."""
    number = lambda q: Val(q["value"], T.DoubleType())
    return both(a, b, lambda x, y: F.coalesce(x["base"] == y["base"], F.lit(False)) & readings.less(op, number(x), number(y)))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """Same base for sums, numbers for products; anything else is null."""
    none = Val(F.lit(None).cast(TYPE), TYPE)
    scale = lambda q, f: once(q, lambda x: F.struct((x["value"] * f).alias("value"), x["base"].alias("base"), (x["written"] * f).alias("written"), x["unit"].alias("unit")))

    def total(x: Column, y: Column) -> Column:
        value = x["value"] + y["value"] * (1.0 if op == "+" else -1.0)
        return F.when(x["base"] == y["base"], F.struct(value.alias("value"), x["base"].alias("base"), (value * x["written"] / x["value"]).alias("written"), x["unit"].alias("unit")))

    if is_quantity(a) and is_quantity(b):
        return Val(both(a, b, total), TYPE) if op in "+-" else none
    if is_quantity(a) and b.numeric and op in ("*", "div"):
        return Val(scale(a.col, b.col.cast("double") if op == "*" else 1 / b.col.cast("double")), TYPE)
    if is_quantity(b) and a.numeric and op == "*":
        return Val(scale(b.col, a.col.cast("double")), TYPE)
    return none


def show(q: Column) -> Column:
    written = lambda n: F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))
    return once(q, lambda x: F.concat(written(x["written"]), x["unit"]))
