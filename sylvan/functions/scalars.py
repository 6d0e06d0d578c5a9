"""The scalar functions: each takes the topic and its arguments, and gives one value.

Text functions read null as empty text.  Functions in ``EXPANDING`` give a list that becomes rows.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import encoding, quantity, temporal
from .readings import Val, display, instant, iso, number, text

STRING, LONG, DOUBLE, STRINGS = T.StringType(), T.LongType(), T.DoubleType(), T.ArrayType(T.StringType())
EXPANDING = ("lines", "words", "split")
_registered: dict = {}


def register_function(name: str, function, result: T.DataType) -> None:
    """Adds a function of one Column, for instance a pandas UDF, to the language."""
    if name in SCALARS or name in _registered:
        raise ValueError(f"{name!r} is taken")
    _registered[name] = lambda v, a: Val(function(v.col), result)


def show(v: Val):
    """Display text, with quantities and durations in their own forms."""
    if v.duration:
        return temporal.show(v)
    if quantity.is_quantity(v):
        return quantity.show(v.col)
    return text(v)


def _text(f, kind=STRING):
    return lambda v, a: Val(f(F.coalesce(show(v), F.lit(""))), kind, costly=quantity.is_quantity(v))


def _constant(a, k, what, default=None):
    if k < len(a):
        return a[k].value
    if default is None:
        raise ValueError(f"{what} is missing")
    return default


def _non_empty(c):
    return F.filter(c, lambda x: x != "")


def _lines(c):
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n"))


def _round(v, a):
    if quantity.is_quantity(v):
        return _written(F.round, v, a)
    n = number(v)
    if n is None:
        return Val(F.lit(None).cast("long"), LONG)
    if not a:
        return Val(F.round(n.cast("double")).cast("long"), LONG)
    return Val(F.round(n.cast("double"), int(a[0].value)), DOUBLE)


def _written(f, v, a):
    places = int(a[0].value) if a else 0
    amount = lambda q: f(q["written"], places) if places else f(q["written"]).cast("double")
    rounded = lambda q: F.struct((amount(q) * q["value"] / q["written"]).alias("value"), q["base"].alias("base"), amount(q).cast("double").alias("written"), q["unit"].alias("unit"))
    return Val(quantity.once(v.col, rounded), quantity.TYPE)


def _whole(f):
    def run(v, a):
        if quantity.is_quantity(v):
            return _written(f, v, ())
        n = number(v)
        return Val(f(n.cast("double")).cast("long") if n is not None else F.lit(None).cast("long"), LONG)

    return run


def _abs(v, a):
    n = number(v)
    if n is None:
        return Val(F.lit(None).cast("double"), DOUBLE)
    return Val(F.abs(n), LONG if v.integral else DOUBLE) if v.numeric else Val(F.abs(n), DOUBLE)


def _datetime(v, a):
    t = instant(v)
    return Val(t if t is not None else F.lit(None).cast("timestamp"), T.TimestampType())


def _strftime(v, a):
    return Val(F.date_format(_datetime(v, ()).col, temporal.pattern(_constant(a, 0, "a format"))), STRING)


def _strptime(v, a):
    return Val(F.try_to_timestamp(F.when(F.length(text(v)) > 0, text(v)), F.lit(temporal.pattern(_constant(a, 0, "a format")))), T.TimestampType())


def _default(v, a):
    other = a[0]
    if v.null:
        return other
    if v.text and not other.text:
        return Val(F.coalesce(v.col, show(other)), STRING)
    return Val(F.coalesce(v.col, other.col.cast(v.type) if not (v.numeric and other.numeric) else other.col), v.type)


def _decode(v, a):
    name = _constant(a, 0, "an encoding")
    if name == "json":
        return Val(F.try_parse_json(text(v)), T.VariantType())
    if name in ("yaml", "toml", "xml"):
        from .structured import to_json

        return Val(F.try_parse_json(to_json(name)(text(v))), T.VariantType())
    return Val(encoding.decode(text(v), name), STRING)


def _json(v, a):
    if v.text:
        c = F.to_json(F.struct(v.col.alias("x")), {"ignoreNullFields": "false"})
        return Val(F.regexp_extract(c, r'^\{"x":(?s)(.*)\}$', 1), STRING)
    c = F.to_json(F.struct(v.col.alias("x")), {"ignoreNullFields": "false"})
    c = F.regexp_extract(c, r'^\{"x":(.*)\}$', 1)
    return Val(_spaced(c) if v.struct or v.array else c, STRING)


def _spaced(c):
    """Spaces after the separators of compact JSON, outside texts."""
    return F.regexp_replace(c, r'([,:])(?=(?:[^"\\]|\\.|"(?:[^"\\]|\\.)*")*$)', "$1 ")


def _substitute(v, pattern: str, replacement: str, flags: str) -> Val:
    c = F.coalesce(show(v), F.lit(""))
    p = ("(?i)" if "i" in flags else "") + pattern
    replacement = re.sub(r"\$\{(\d+)\}", r"$\1", replacement)
    costly = quantity.is_quantity(v) or v.costly
    if "g" in flags:
        return Val(F.regexp_replace(c, p, replacement), STRING, costly=costly)
    first = lambda x: _first_only(x, p, replacement)
    return Val(quantity.once(c, first) if costly else first(c), STRING, costly=costly)


def _first_only(c, pattern: str, replacement: str):
    at = F.regexp_instr(c, F.lit(pattern))
    found = F.regexp_substr(c, F.lit(pattern))
    done = F.regexp_replace(found, pattern, replacement)
    return F.when((at == 0) | found.isNull(), c).otherwise(F.concat(F.substr(c, F.lit(1), at - 1), done, F.substr(c, at + F.length(found))))


SCALARS = {
    "upper": _text(F.upper),
    "lower": _text(F.lower),
    "trim": _text(lambda c: F.regexp_replace(c, r"^[\s  - 　]+|[\s  - 　]+$", "")),
    "chars": _text(lambda c: F.length(c).cast("long"), LONG),
    "wc": _text(lambda c: F.size(_non_empty(F.split(c, r"\s+"))).cast("long"), LONG),
    "lines": _text(_lines, STRINGS),
    "words": _text(lambda c: _non_empty(F.split(c, r"\s+")), STRINGS),
    "split": lambda v, a: Val(F.split(text(v), re.escape(_constant(a, 0, "a separator", ","))), STRINGS),
    "sha256": _text(lambda c: F.sha2(c, 256)),
    "base64": _text(encoding.base64),
    "base64url": _text(encoding.base64url),
    "base32": _text(encoding.base32),
    "crockford32": _text(encoding.crockford32),
    "hex": _text(lambda c: F.lower(F.hex(c))),
    "decode": _decode,
    "json": _json,
    "default": _default,
    "round": _round,
    "floor": _whole(F.floor),
    "ceil": _whole(F.ceil),
    "abs": _abs,
    "datetime": _datetime,
    "isoformat": lambda v, a: Val(iso(_datetime(v, ()).col), STRING),
    "strftime": _strftime,
    "strptime": _strptime,
    "duration": lambda v, a: temporal.duration(v),
    "quantity": lambda v, a: Val(quantity.parse(text(v)), quantity.TYPE) if not quantity.is_quantity(v) else v,
    "convert": lambda v, a: Val(quantity.convert((v if quantity.is_quantity(v) else Val(quantity.parse(text(v)), quantity.TYPE)).col, _constant(a, 0, "a unit")), quantity.TYPE),
    **{n: (lambda n: lambda v, a: temporal.part(n, v))(n) for n in ("year", "month", "day", "hour", "minute", "second", "weekday", "date", "epoch", "isodate", "isomonth", "isoweek")},
    **{n: (lambda n: lambda v, a: temporal.of_number(n, v))(n) for n in ("seconds", "minutes", "hours", "days")},
}


def known(name: str) -> bool:
    return name in SCALARS or name in _registered


def apply(name: str, v: Val, args: list[Val]) -> Val:
    f = SCALARS.get(name) or _registered.get(name)
    if f is None:
        raise ValueError(f"unknown function {name!r}")
    return f(v, args)


def substitute(v: Val, pattern: str, replacement: str, flags: str) -> Val:
    return _substitute(v, pattern, replacement, flags)


__all__ = ["EXPANDING", "apply", "display", "known", "register_function", "show", "substitute"]
