"""PostgreSQL-flavoured scalar functions as Column expressions; no UDFs.

Where a Spark built-in means the same it is used as it is; the others are rewritten here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import Refused


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---- strings ----

lower, upper, reverse, md5 = F.lower, F.upper, F.reverse, F.md5


def initcap(s: Column) -> Column:
    """Words begin after anything that isn't alphanumeric."""
    runs = F.regexp_extract_all(s, F.lit(r"([\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2147483647)))), "")


def length(s: Column) -> Column:
    return F.char_length(s)


def concat(*xs) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *[_c(x).cast("string") for x in xs])


def concat_ws(sep, *xs) -> Column:
    """A null separator gives null; null arguments are skipped."""
    return F.call_function("concat_ws", _c(sep), *[_c(x).cast("string") for x in xs])


def btrim(s: Column, chars=None) -> Column:
    """Strips a set of characters; blanks only, if none is given."""
    return F.btrim(s, _c(chars if chars is not None else " "))


def ltrim(s: Column, chars=None) -> Column:
    return F.ltrim(s, _c(chars if chars is not None else " "))


def rtrim(s: Column, chars=None) -> Column:
    return F.rtrim(s, _c(chars if chars is not None else " "))


def replace(s: Column, old, new) -> Column:
    return F.replace(s, _c(old), _c(new))


translate = F.translate


def repeat(s: Column, n) -> Column:
    return F.repeat(s, _c(n))


def split_part(s: Column, sep, n: int) -> Column:
    if n == 0:
        raise Refused("split_part: field 0")
    return F.split_part(s, _c(sep), _c(n))


def _pad(s: Column, n, fill, left: bool) -> Column:
    n, fill = _c(n), _c(fill)
    padded = F.call_function("lpad" if left else "rpad", s, n, fill)
    return F.when(n <= 0, F.when(s.isNotNull(), "")).when(F.char_length(fill) == 0, F.substring(s, F.lit(1), n)).otherwise(padded)


def lpad(s: Column, n, fill=" ") -> Column:
    """Cuts on the right if s is longer; an empty fill pads nothing."""
    return _pad(s, n, fill, True)


def rpad(s: Column, n, fill=" ") -> Column:
    return _pad(s, n, fill, False)


def strpos(s: Column, part) -> Column:
    return F.call_function("instr", s, _c(part))


def left(s: Column, n) -> Column:
    """Negative n: all but the last |n| characters."""
    n = _c(n)
    return F.substring(s, F.lit(1), F.when(n < 0, F.greatest(F.char_length(s) + n, F.lit(0))).otherwise(n))


def right(s: Column, n) -> Column:
    n, size = _c(n), F.char_length(s)
    take = F.when(n < 0, F.greatest(size + n, F.lit(0))).otherwise(F.least(n, size))
    return F.when(take == 0, F.when(s.isNotNull(), "")).otherwise(F.substring(s, size - take + 1, take))


def substr(s: Column, start, count=None) -> Column:
    """Characters of [start, start + count) that exist; start may be 0 or below."""
    start = _c(start)
    first = F.greatest(start, F.lit(1))
    if count is None:
        return F.substring(s, first, F.lit(2147483647))
    count = _c(count)
    checked = F.when(count < 0, F.raise_error(F.lit("negative substring length")).cast("int")).otherwise(count)
    return F.substring(s, first, F.greatest(start + checked - first, F.lit(0)))


def format_(template: str, *xs) -> Column:
    """%s, %I, %L, %% and %n$X of a constant template. Null: '' for %s, NULL for %L, an error for %I."""
    out, at, k = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?(.)", template):
        out.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[2] == "%":
            out.append(F.lit("%"))
            continue
        k = int(m[1]) if m[1] else k + 1
        if m[2] not in "sIL" or not 1 <= k <= len(xs):
            raise Refused(f"format: {m[0]}")
        x = _c(xs[k - 1]).cast("string")
        if m[2] == "s":
            out.append(F.coalesce(x, F.lit("")))
        elif m[2] == "L":
            out.append(F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")))
        else:
            plain = F.when(x.rlike("^[a-z_][a-z0-9_]*$"), x).otherwise(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))
            out.append(F.when(x.isNull(), F.raise_error(F.lit("null identifier in format"))).otherwise(plain))
    out.append(F.lit(template[at:]))
    return F.concat(*out)


# ---- numbers ----


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def round_(x: Column, scale: int = 0) -> Column:
    """Half away from zero after shifting in double precision."""
    shift = F.lit(10.0**scale)
    y = x.cast("double") * shift
    return F.when(y >= 0, F.floor(y + 0.5)).otherwise(F.ceil(y - 0.5)).cast("double") / shift


def trunc(x: Column, scale: int = 0) -> Column:
    shift = F.lit(10.0**scale)
    return F.signum(x) * F.floor(F.abs(x.cast("double") * shift)).cast("double") / shift


abs_ = F.abs


def sign(x: Column) -> Column:
    return F.signum(x).cast("long")


def sqrt(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("square root of a negative number")).cast("double")).otherwise(F.sqrt(x))


def mod(a: Column, b) -> Column:
    """Sign of the dividend; ANSI mode raises on 0."""
    return a % _c(b)


def div(a: Column, b) -> Column:
    """Integer division, cut toward zero."""
    b = _c(b)
    return ((a - a % b) / b).cast("long")


def power(a: Column, b, whole: bool = False) -> Column:
    """whole: both are integers and b is not negative; the result is an integer, out of range is an error."""
    out = F.pow(a, _c(b))
    return out.cast("long") if whole else out


# ---- nulls and logic ----

coalesce, greatest, least = F.coalesce, F.greatest, F.least


def nullif(a: Column, b) -> Column:
    return F.nullif(a, _c(b))


_TRUE, _FALSE = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"), ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")


def to_bool(s: Column) -> Column:
    """PostgreSQL's words for true and false; anything else is an error."""
    w = F.lower(F.trim(s))
    return F.when(w.isin(*_TRUE), True).when(w.isin(*_FALSE), False).when(s.isNotNull(), F.raise_error(F.concat(F.lit("no boolean: "), s)).cast("boolean"))


def to_int(x: Column) -> Column:
    """Doubles round half away from zero."""
    return round_(x).cast("long")


def bool_text(x: Column) -> Column:
    return x.cast("string")


def render_float(x: Column) -> Column:
    """Whole numbers below 1e15 print without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


# ---- dates and times (timestamps without zone or in UTC) ----

_FIELDS = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "doy": F.dayofyear}


def date_part(part: str, x: Column) -> Column:
    """A field as a double; dow counts from Sunday = 0."""
    part = part.lower()
    if part == "dow":
        return (F.dayofweek(x) - 1).cast("double")
    if part == "second":
        return (F.unix_micros(x.cast("timestamp")) % F.lit(60_000_000)) / F.lit(1e6)
    if part == "epoch":
        return F.unix_micros(x.cast("timestamp")) / F.lit(1e6)
    if part not in _FIELDS:
        raise Refused(f"date_part: {part}")
    return _FIELDS[part](x).cast("double")


def extract(part: str, x: Column, is_date: bool = False) -> Column:
    if is_date and part.lower() in ("hour", "minute", "second"):
        raise Refused(f"extract: a date has no {part}")
    return date_part(part, x)


def date_trunc(part: str, x: Column) -> Column:
    if part.lower() not in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
        raise Refused(f"date_trunc: {part}")
    return F.date_trunc(part, x)


def interval(months=0, days=0, micros=0) -> Column:
    """An interval keeps its three parts apart."""
    return F.struct(_c(months).cast("int").alias("months"), _c(days).cast("int").alias("days"), _c(micros).cast("long").alias("micros"))


def add_interval(ts: Column, iv: Column, times: int = 1) -> Column:
    """Months (clamped to the month's end), then days, then microseconds."""
    t = ts.cast("timestamp")
    day = F.date_add(F.add_months(t.cast("date"), iv["months"] * times), iv["days"] * times)
    within = F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + within + iv["micros"] * times)


def ts_minus(a: Column, b: Column) -> Column:
    """Difference of timestamps: whole days and microseconds."""
    d = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    days = (F.signum(d.cast("double")) * F.floor(F.abs(d) / F.lit(86_400_000_000))).cast("long")
    return interval(0, days, d - days * 86_400_000_000)


def date_minus(a: Column, b: Column) -> Column:
    return F.datediff(a, b).cast("long")


def add_intervals(a: Column, b: Column, sign_: int = 1) -> Column:
    return interval(a["months"] + b["months"] * sign_, a["days"] + b["days"] * sign_, a["micros"] + b["micros"] * sign_)


def interval_part(part: str, iv: Column) -> Column:
    """Parts are taken apart; epoch counts months of 30 days and years of 365.25."""
    m, d, u = iv["months"], iv["days"], iv["micros"]
    cut = lambda x, n: F.signum(x.cast("double")) * F.floor(F.abs(x) / n)
    years = cut(m, 12)
    parts = {"year": years, "month": m - years * 12, "day": d, "hour": cut(u, 3_600_000_000), "minute": cut(u % 3_600_000_000, 60_000_000), "second": (u % 60_000_000) / F.lit(1e6), "epoch": years * 31_557_600.0 + (m - years * 12) * 2_592_000.0 + d * 86_400.0 + u / F.lit(1e6)}
    if part.lower() not in parts:
        raise Refused(f"extract: {part} of an interval")
    return parts[part.lower()].cast("double")


def age(a: Column, b: Column) -> Column:
    """a - b in calendar months, then days and microseconds; swapped operands change every sign."""
    a, b = a.cast("timestamp"), b.cast("timestamp")
    back = a < b
    hi, lo = F.greatest(a, b), F.least(a, b)
    within = lambda t: F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))
    micros = within(hi) - within(lo)
    borrow_day = F.when(micros < 0, 1).otherwise(0)
    micros = micros + borrow_day * 86_400_000_000
    days = F.dayofmonth(hi) - F.dayofmonth(lo) - borrow_day
    borrow_month = F.when(days < 0, 1).otherwise(0)
    # a borrowed month has the days of the earlier date's month
    days = days + borrow_month * F.dayofmonth(F.last_day(lo))
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) - borrow_month
    s = F.when(back, -1).otherwise(1)
    return interval(months * s, days * s, micros * s)


def render_interval(iv: Column) -> Column:
    """'1 year 2 mons 3 days 04:05:06'; zero is 00:00:00."""
    m, d, u = iv["months"], iv["days"], iv["micros"]
    cut = lambda x, n: (F.signum(x.cast("double")) * F.floor(F.abs(x) / n)).cast("long")
    years, months = cut(m, 12), m - cut(m, 12) * 12
    named = lambda x, one, many: F.when(x != 0, F.concat(x.cast("string"), F.when(x == 1, F.lit(" " + one)).otherwise(F.lit(" " + many))))
    t, rest = F.abs(u), F.abs(u) % 1_000_000
    clock = F.concat(F.when(u < 0, "-").otherwise(""), F.lpad(F.floor(t / 3_600_000_000).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(t / 60_000_000 % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(t / 1_000_000 % 60).cast("string"), 2, "0"), F.when(rest > 0, F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), 6, "0"), F.lit("0")))).otherwise(""))
    return F.concat_ws(" ", named(years, "year", "years"), named(months, "mon", "mons"), named(d, "day", "days"), F.when((u != 0) | ((m == 0) & (d == 0)), clock))


def year_text(ts: Column) -> Column:
    """As DuckDB's %Y: four digits at least, no plus from 10000 on; 1 BC is 0000, 2 BC is -1."""
    y = F.year(ts)
    return F.when(y.between(0, 9999), F.lpad(y.cast("string"), 4, "0")).otherwise(y.cast("string"))


# Template words of to_char and codes of date_format, and Spark's pattern of each. Years of four digits are year_text().
_CHAR = {"YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "Mon": "MMM", "AM": "a", "PM": "a"}
_PERCENT = {"m": "MM", "d": "dd", "H": "HH", "i": "mm", "s": "ss", "M": "MMMM", "b": "MMM", "p": "a", "f": "SSSSSS"}


def to_char(ts: Column, template: str) -> Column:
    """Month is padded to nine characters; letters that are no template word are refused."""
    out, at = [], 0
    for m in re.finditer(r"YYYY|YY|MM|DD|HH24|HH12|MI|SS|MS|US|Month|Mon|AM|PM|[A-Za-z]+|[^A-Za-z]+", template):
        w, at = m[0], m.end()
        if w == "Month":
            out.append(F.rpad(F.date_format(ts, "MMMM"), 9, " "))
        elif w == "YYYY":
            out.append(year_text(ts))
        elif w in _CHAR:
            out.append(F.date_format(ts, _CHAR[w]))
        elif w[0].isalpha():
            raise Refused(f"to_char: {w}")
        else:
            out.append(F.lit(w))
    return F.concat(*out) if at else F.lit("")


def date_format(ts: Column, template: str) -> Column:
    """MySQL codes."""
    out = []
    for m in re.finditer(r"%(.)|[^%]+", template):
        if not m[1]:
            out.append(F.lit(m[0]))
        elif m[1] == "%":
            out.append(F.lit("%"))
        elif m[1] == "Y":
            out.append(year_text(ts))
        elif m[1] in _PERCENT:
            out.append(F.date_format(ts, _PERCENT[m[1]]))
        else:
            raise Refused(f"date_format: %{m[1]}")
    return F.concat(*out)


def unix_timestamp(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def from_unixtime(secs: Column, template: str | None = None) -> Column:
    ts = F.timestamp_seconds(secs.cast("long"))
    return date_format(ts, template) if template else ts


# ---- regular expressions ----


def _pattern(p: str, flags: str) -> str:
    if set(flags) - set("gi"):
        raise Refused(f"regexp flags {flags}")
    return ("(?i)" if "i" in flags else "") + p


def regexp_replace(s: Column, pattern: str, to: str, flags: str = "") -> Column:
    r"""The first match only, unless flag g; \1 .. \9 and \& in `to`."""
    p = _pattern(pattern, flags)
    java = lambda shift: re.sub(r"\\([0-9&\\])|([$\\])", lambda m: "\\" + m[2] if m[2] else "\\\\" if m[1] == "\\" else f"${{g0}}" if m[1] == "&" else f"${int(m[1]) + shift}", to)  # noqa: E731, F541
    if "g" in flags:
        return F.regexp_replace(s, p, java(0).replace("${g0}", "$0"))
    first = re.sub(r"^\(\?i\)", "", p)
    return F.regexp_replace(s, f"{'(?i)' if 'i' in flags else ''}^((?s:.*?))(?<g0>{first})", "$1" + java(2))


def regexp_matches(s: Column, pattern: str, flags: str = "") -> Column:
    """Groups of the only match as an array of text (the whole match without groups); none or several are errors."""
    p = _pattern(pattern, flags)
    groups = re.compile(pattern).groups
    n = F.regexp_count(s, F.lit(p))
    got = F.array(*[F.regexp_extract(s, p, k) for k in (range(1, groups + 1) if groups else [0])])
    many = n != 1 if "g" in flags else n < 1
    return F.when(many, F.raise_error(F.lit("regexp_matches: not one row")).cast("array<string>")).otherwise(got)


def regexp_split_to_array(s: Column, pattern: str, flags: str = "") -> Column:
    return F.split(s, _pattern(pattern, flags))


def braces(a: Column) -> Column:
    """An array as {a,b}."""
    return F.concat(F.lit("{"), F.array_join(a, ","), F.lit("}"))
