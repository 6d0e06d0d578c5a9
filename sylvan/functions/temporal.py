"""Instants and spans of time as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readings import Val, instant, number, seconds

# Seconds of the units of spans, and pattern letters of the strftime directives.
UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "sec": 1, "second": 1, "seconds": 1, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800, "week": 604800, "weeks": 604800}
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "e": "d"}
_ISO = r"^P(?:(\d+(?:\.\d+)?)W)?(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def literal_seconds(text: str) -> float | None:
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", text)
    if not parts or any(u not in UNITS for _, u in parts) or re.sub(r"[\d.\sa-z]", "", text):
        return None
    return sum(float(n) * UNITS[u] for n, u in parts)


def span(c: Column) -> Column:
    """Seconds as an interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


def span_of_text(c: Column) -> Column:
    """ISO 8601 durations and spans such as ``5d3h5min``; null where the text is neither."""
    part = lambda k: F.coalesce(F.regexp_extract(c, _ISO, k).try_cast("double"), F.lit(0.0))
    iso = part(1) * 604800 + part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    token = r"(\d+(?:\.\d+)?)\s*(" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"
    table = F.create_map(*[x for u, s in UNITS.items() for x in (F.lit(u), F.lit(float(s)))])
    numbers, units = F.regexp_extract_all(c, F.lit(token), F.lit(1)), F.regexp_extract_all(c, F.lit(token), F.lit(2))
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("double") * table[u]), F.lit(0.0), lambda a, x: a + x)
    whole = c.rlike(r"^\s*(?:" + token + r"\s*)+$")
    return F.when(c.rlike(_ISO) & c.rlike(r"\d"), span(iso)).when(whole, span(total))


def duration(v: Val) -> Val:
    kind = T.DayTimeIntervalType()
    if v.duration:
        return v
    if v.numeric:
        return Val(span(v.col), kind)
    return Val(span_of_text(v.col.cast("string")), kind)


def show(v: Val) -> Column:
    """ISO 8601 text of a duration."""
    total = seconds(v)
    days = F.floor(total / 86400)
    rest = total - days * 86400
    hours = F.floor(rest / 3600)
    minutes = F.floor((rest - hours * 3600) / 60)
    secs = F.round(rest - hours * 3600 - minutes * 60, 6)
    piece = lambda n, u: F.when(n != 0, F.concat(n.cast("long").cast("string"), F.lit(u))).otherwise(F.lit(""))
    s = F.when(secs != 0, F.concat(F.regexp_replace(secs.cast("decimal(18,6)").cast("string"), r"\.?0+$", ""), F.lit("S"))).otherwise(F.lit(""))
    clock = F.concat(piece(hours, "H"), piece(minutes, "M"), s)
    return F.when(total == 0, F.lit("PT0S")).otherwise(F.concat(F.lit("P"), piece(days, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(F.lit(""))))


def pattern(fmt: str) -> str:
    out, i = [], 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            d = fmt[i + 1]
            if d == "%":
                out.append("'%'")
            elif d in DIRECTIVES:
                out.append(DIRECTIVES[d])
            else:
                raise ValueError(f"unknown directive %{d}")
            i += 2
            continue
        out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
        i += 1
    return "".join(out)


def part(name: str, v: Val) -> Val:
    t = instant(v)
    whole = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    if t is None:
        t = F.lit(None).cast("timestamp")
    if name in whole:
        return Val(whole[name](t).cast("long"), T.LongType())
    if name == "weekday":
        return Val((F.weekday(t) + 1).cast("long"), T.LongType())
    if name == "date":
        return Val(F.date_trunc("day", t), T.TimestampType())
    if name == "epoch":
        return Val(F.floor(F.unix_micros(t) / 1_000_000).cast("long"), T.LongType())
    if name == "isodate":
        return Val(F.date_format(t, "yyyy-MM-dd"), T.StringType())
    if name == "isomonth":
        return Val(F.date_format(t, "yyyy-MM"), T.StringType())
    if name == "isoweek":
        return Val(F.when(t.isNotNull(), F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t))), T.StringType())
    raise ValueError(name)


def of_number(name: str, v: Val) -> Val:
    n = number(v)
    return Val(span((n if n is not None else F.lit(None).cast("double")) * {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[name]), T.DayTimeIntervalType())
