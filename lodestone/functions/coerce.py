"""Coercion of stored values to declared types, and symbolic time bounds.

A value that is missing or does not coerce is null here, and null means "not in the index".
"""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import Refused

TYPES = ("i64", "f64", "str", "vector")
_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?((inf|infinity)|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def coerced(col: Column, kind: str, source: str = "string") -> Column:
    """col (of Spark type `source`) as i64, f64 or str; null where it doesn't coerce."""
    if kind == "str":
        return col.cast("string")
    if kind == "i64":
        if source in ("tinyint", "smallint", "int", "bigint"):
            return col.cast("long")
        text = F.trim(col.cast("string"))
        return F.when(text.rlike(_INT), text.try_cast("long"))
    if kind == "f64":
        if source in ("float", "double"):
            return F.when(~F.isnan(col), col.cast("double"))
        if source in ("tinyint", "smallint", "int", "bigint"):
            return col.cast("double")
        text = F.lower(F.trim(col.cast("string")))
        value = F.when(text.rlike("inf"), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(text.try_cast("double"))
        return F.when(text.rlike(_FLOAT), value)
    raise Refused(f"TYPE {kind} is not one of {', '.join(TYPES)}")


_UNIT = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}


def add_months(t: dt.datetime, n: int) -> dt.datetime:
    """n months later; the day is clamped to the month's end."""
    y, m = divmod(t.year * 12 + t.month - 1 + n, 12)
    return t.replace(year=y, month=m + 1, day=min(t.day, calendar.monthrange(y, m + 1)[1]))


def time_bound(text: str, now: dt.datetime) -> int:
    """'@now', '@now-3d', '@now+2mo', '@2024-01-31' or '@2024-01-31T10:00:00' -> Unix seconds; `now` is injected."""
    if m := re.fullmatch(r"@now(?:([+-])(\d+)(s|m|h|d|w|mo|y))?", text):
        if not m[1]:
            out = now
        else:
            n = int(m[2]) * (1 if m[1] == "+" else -1)
            out = now + dt.timedelta(seconds=n * _UNIT[m[3]]) if m[3] in _UNIT else add_months(now, n * (12 if m[3] == "y" else 1))
    else:
        try:
            out = dt.datetime.strptime(text, "@%Y-%m-%dT%H:%M:%S" if "T" in text else "@%Y-%m-%d")
        except ValueError as e:
            raise Refused(f"{text} is no time bound") from e
    return calendar.timegm(out.timetuple())


def bound(value, kind: str, now: dt.datetime | None = None):
    """A query bound as a Python value of the index's type."""
    if isinstance(value, str) and value.startswith("@"):
        if kind != "i64":
            raise Refused(f"time bound {value} needs an i64 field")
        return time_bound(value, now or dt.datetime.now(dt.UTC).replace(tzinfo=None))
    try:
        if kind == "i64":
            if isinstance(value, str) and not re.fullmatch(_INT, value.strip()):
                raise ValueError(value)
            return int(value)
        if kind == "f64":
            out = float(value)
            if out != out:
                raise ValueError(value)
            return out
    except ValueError as e:
        raise Refused(f"bound {value!r} is not of type {kind}") from e
    return str(value)
