"""Functions of the embedded-database dialect as Spark Columns.

Where the two dialects agree there is nothing here; each builder covers a
difference: case of LIKE, GLOB, integer division, NULL instead of an error,
``substr`` from zero, scalar minimum and maximum with NULL, logarithms, date
modifiers that overflow into the next month, window frames by groups.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- comparison -------------------------------------------------------------


def like(x: ColumnLike, pattern: str) -> Column:
    """LIKE without regard to the case of ASCII letters."""
    return F.translate(_c(x), UPPER, LOWER).like(pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\"))


def glob(x: ColumnLike, pattern: str) -> Column:
    """GLOB: ``*``, ``?`` and bracketed sets, by case, over the whole text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{inner}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return _c(x).rlike(f"(?s)\\A{out}\\z")


def compare_mixed(number: ColumnLike, text: ColumnLike) -> Column:
    """``=`` of a number and a text of another storage class: never equal, never an error."""
    return F.when(_c(number).isNull() | _c(text).isNull(), None).otherwise(F.lit(False))


# ---- arithmetic -------------------------------------------------------------


def divide(a: ColumnLike, b: ColumnLike, integral: bool) -> Column:
    """``/``: toward zero for integers; NULL where the divisor is zero."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, _int_div(a, b)) if integral else F.try_divide(a, b)


def _int_div(a: Column, b: Column) -> Column:
    q = F.floor(F.try_divide(F.abs(a).cast("decimal(20,0)"), F.abs(b).cast("decimal(20,0)")))
    return (q * F.signum(a) * F.signum(b)).cast("long")


def modulo(a: ColumnLike, b: ColumnLike) -> Column:
    """``%`` with the sign of the dividend; NULL for a zero divisor."""
    return F.try_mod(_c(a), _c(b))


def scalar_max(*xs: ColumnLike) -> Column:
    """``max(a, b, ...)``: NULL if any is NULL."""
    return F.when(_none_null(xs), F.greatest(*map(_c, xs)))


def scalar_min(*xs: ColumnLike) -> Column:
    return F.when(_none_null(xs), F.least(*map(_c, xs)))


def _none_null(xs: tuple[ColumnLike, ...]) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & _c(x).isNotNull()
    return out


def log(x: ColumnLike, base: float | None = None) -> Column:
    """``log(x)`` is base ten; ``log(b, x)`` has its base first. NULL outside the domain."""
    x = _c(x)
    value = F.log10(x) if base is None else F.log(x) / F.log(F.lit(float(base)))
    return F.when(x > 0, value)


def trunc(x: ColumnLike) -> Column:
    x = _c(x)
    return F.signum(x) * F.floor(F.abs(x))


def sqrt(x: ColumnLike) -> Column:
    return F.when(_c(x) >= 0, F.sqrt(_c(x)))


# ---- text -------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(x: ColumnLike) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(_c(x), UPPER, LOWER)


def upper(x: ColumnLike) -> Column:
    return F.translate(_c(x), LOWER, UPPER)


def substr(x: ColumnLike, start: int, length: int | None = None) -> Column:
    """Characters from ``start``, counted from 1, or from the end if negative.

    Position 0 stands before the first character and uses up one of ``length``; a
    negative length takes the characters before the start.
    """
    x = _c(x)
    n = F.char_length(x)
    first = F.lit(start) if start >= 0 else n + F.lit(start + 1)
    if length is None:
        return F.substring(x, F.greatest(first, F.lit(1)), n)
    low, high = (first, first + F.lit(length)) if length >= 0 else (first + F.lit(length), first)
    low, high = F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1))
    return F.substring(x, low, high - low)


def concat(*xs: ColumnLike) -> Column:
    """``concat``: NULL counts as empty (unlike ``||``)."""
    return F.concat_ws("", *(_c(x).cast("string") for x in xs))


def char(*codes: int) -> Column:
    return F.lit("".join(map(chr, codes)))


def unicode(x: ColumnLike) -> Column:
    """The first character's code point; NULL for an empty text."""
    return F.when(F.char_length(_c(x)) > 0, F.ascii(_c(x)))


def quote(x: ColumnLike) -> Column:
    """A text as an SQL literal; NULL as the word."""
    x = _c(x)
    return F.when(x.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")))


def zeroblob(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def typeof(df: DataFrame, name: str) -> Column:
    """The storage class of a column's value."""
    kind = df.schema[name].dataType.typeName()
    by = {"long": "integer", "integer": "integer", "short": "integer", "byte": "integer", "boolean": "integer",
          "double": "real", "float": "real", "binary": "blob"}
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.lit(by.get(kind, "text")))


# ---- aggregates -------------------------------------------------------------


def total(x: ColumnLike) -> Column:
    """The sum as a double, 0.0 over no value."""
    return F.coalesce(F.sum(_c(x).cast("double")), F.lit(0.0))


def group_concat(x: ColumnLike, separator: str = ",", order: ColumnLike | None = None) -> Column:
    """Joined non-null values, in the order of ``order`` (none: unspecified)."""
    if order is None:
        return F.array_join(F.collect_list(_c(x).cast("string")), separator)
    pairs = F.sort_array(F.collect_list(F.when(_c(x).isNotNull(), F.struct(_c(order).alias("o"), _c(x).cast("string").alias("v")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["v"]), separator))


def json_group_array(x: ColumnLike) -> Column:
    """A JSON array of the values, ordered by value."""
    return F.to_json(F.sort_array(F.collect_list(_c(x))))


def json_group_object(key: ColumnLike, value: ColumnLike) -> Column:
    """A JSON object of the pairs, ordered by key."""
    pairs = F.sort_array(F.collect_list(F.struct(_c(key).alias("k"), _c(value).alias("v"))))
    return F.to_json(F.map_from_entries(pairs))


# ---- windows ----------------------------------------------------------------


def groups_frame(df: DataFrame, partition: list[str], order: list[str], start: int, end: int, **aggregates: Column) -> DataFrame:
    """Aggregates over a GROUPS frame: a RANGE over the dense rank of the order."""
    rank = F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order))
    frame = Window.partitionBy(*partition).orderBy("_group").rangeBetween(start, end)
    return df.withColumn("_group", rank).withColumns({k: a.over(frame) for k, a in aggregates.items()}).drop("_group")


def excluding_current(aggregate: Column, value: ColumnLike, window: Window) -> Column:
    """A sum or count over a frame, without the current row."""
    return aggregate.over(window) - F.coalesce(_c(value), F.lit(0))


# ---- dates ------------------------------------------------------------------

MODIFIER = re.compile(r"^([+-]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?$")


def moment(x: ColumnLike, *modifiers: str) -> Column:
    """A timestamp moved by modifiers, applied from left to right.

    ``+n units``, ``start of month|year|day``, ``weekday n``. Months and years keep
    the day of the month and overflow: January 31 plus a month is March 2 or 3.
    """
    at = _c(x).cast("timestamp")
    for m in modifiers:
        if m.startswith("start of "):
            at = F.date_trunc(m.removeprefix("start of "), at)
        elif m.startswith("weekday "):
            ahead = F.pmod(F.lit(int(m.removeprefix("weekday ")) + 1) - F.dayofweek(at), F.lit(7))
            at = at + F.make_dt_interval(ahead)
        elif found := MODIFIER.match(m):
            n, unit = float(found[1]), found[2]
            if unit in ("month", "year"):
                months = int(n) * (12 if unit == "year" else 1)
                first = F.date_trunc("month", at)
                at = F.add_months(first, months).cast("timestamp") + (at - first)
            else:
                seconds = n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
                at = at + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
        else:
            raise ValueError(f"unknown modifier {m!r}")
    return at


def date(x: ColumnLike, *modifiers: str) -> Column:
    return F.date_format(moment(x, *modifiers), "yyyy-MM-dd")


def time(x: ColumnLike, *modifiers: str) -> Column:
    return F.date_format(moment(x, *modifiers), "HH:mm:ss")


def datetime(x: ColumnLike, *modifiers: str) -> Column:
    return F.date_format(moment(x, *modifiers), "yyyy-MM-dd HH:mm:ss")


def unixepoch(x: ColumnLike, *modifiers: str) -> Column:
    return F.unix_seconds(moment(x, *modifiers))


def julianday(x: ColumnLike, *modifiers: str) -> Column:
    return F.unix_micros(moment(x, *modifiers)) / F.lit(86_400_000_000.0) + F.lit(2440587.5)


# Conversions of the strftime function and their formats here.
FORMATS = {
    "%d": "dd", "%H": "HH", "%I": "hh", "%j": "DDD", "%m": "MM", "%M": "mm", "%S": "ss", "%Y": "yyyy",
    "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%p": "a", "%f": "ss.SSS",
}


def strftime(pattern: str, x: ColumnLike, *modifiers: str) -> Column:
    at, parts = moment(x, *modifiers), []
    for part in re.split(r"(%.)", pattern):
        if part in FORMATS:
            parts.append(F.date_format(at, FORMATS[part]))
        elif part == "%s":
            parts.append(F.unix_seconds(at).cast("string"))
        elif part == "%w":
            parts.append((F.dayofweek(at) - 1).cast("string"))
        elif part == "%u":
            parts.append((F.weekday(at) + 1).cast("string"))
        elif part == "%J":
            parts.append(julianday(x, *modifiers).cast("string"))
        elif part == "%%":
            parts.append(F.lit("%"))
        elif part:
            parts.append(F.lit(part))
    return F.concat(*parts) if parts else F.lit("")


def timediff(a: ColumnLike, b: ColumnLike) -> Column:
    """``+YYYY-MM-DD HH:MM:SS.SSS`` that, added to ``b``, gives ``a``."""
    a, b = _c(a).cast("timestamp"), _c(b).cast("timestamp")
    late, early = F.greatest(a, b), F.least(a, b)
    months = F.floor(F.months_between(late, early)).cast("int")
    first = F.date_trunc("month", early)
    moved = F.add_months(first, months).cast("timestamp") + (early - first)
    over = moved > late
    months = F.when(over, months - 1).otherwise(months)
    moved = F.add_months(first, months).cast("timestamp") + (early - first)
    micros = F.unix_micros(late) - F.unix_micros(moved)
    days = F.floor(micros / 86_400_000_000).cast("int")
    millis = F.floor(micros / 1000).cast("long") % 86_400_000
    return F.format_string(
        "%s%04d-%02d-%02d %02d:%02d:%02d.%03d",
        F.when(a < b, F.lit("-")).otherwise(F.lit("+")),
        F.floor(months / 12).cast("int"), (months % 12).cast("int"), days,
        F.floor(millis / 3_600_000).cast("int"), (F.floor(millis / 60_000) % 60).cast("int"),
        (F.floor(millis / 1000) % 60).cast("int"), (millis % 1000).cast("int"),
    )
