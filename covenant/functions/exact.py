"""Exact values: numbers of any size, instants to the nanosecond, row keys.

Numbers and timestamps are carried as the text they were written with. What they
compare, order, group and join by is a key: text whose byte order is the order of
the values. Keys are built from built-in functions, so they stay in the JVM and are
sorted and shuffled like any string.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal, Inexact, localcontext

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The written forms of the types.
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
INTEGER = r"^-?(0|[1-9][0-9]*)$"
FLOAT = r"^-?(0|[1-9][0-9]*)(\.[0-9]+([eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+)$"
DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ULID = r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"

#: Added to exponents so that they are positive and of one width.
BIAS, WIDE = 5_000_000_000, 10
SECONDS_BIAS = 100_000_000_000
#: Numbers further from one than this many digits keep their exponent when normalised.
LONGEST = 4000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_number(x: Column | str) -> Column:
    return _c(x).rlike(NUMBER)


def _parts(x: Column) -> tuple[Column, Column, Column]:
    """Whether negative, the significant digits, and the place of the first one.

    The value is 0.d1d2d3... times ten to the place; no digits mean zero.
    """
    zero = F.lit("0")
    body = F.translate(F.ltrim(x, F.lit("-")), "E", "e")
    mantissa = F.substring_index(body, "e", 1)
    power = F.when(F.locate("e", body) > 0, F.translate(F.substring_index(body, "e", -1), "+", "").try_cast("long"))
    whole = F.substring_index(mantissa, ".", 1)
    fraction = F.when(F.locate(".", mantissa) > 0, F.substring_index(mantissa, ".", -1)).otherwise("")
    led = F.ltrim(F.concat(whole, fraction), zero)
    # leading zeros are as many as the digits lost by taking them off
    place = F.char_length(led) - F.char_length(fraction) + F.coalesce(power, F.lit(0))
    return x.startswith("-"), F.rtrim(led, zero), place


def _with_parts(x: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """``f`` of a number's parts, each worked out once: bound by a one-element transform.

    Inlined, each part would be worked out wherever it is named, which takes twice as
    long as the transform's interpreted body.
    """
    negative, digits, place = _parts(x)
    parts = F.struct(negative.alias("negative"), digits.alias("digits"), place.alias("place"))
    return F.get(F.transform(F.array(parts), lambda p: f(p["negative"], p["digits"], p["place"])), F.lit(0))


def number_key(x: Column | str) -> Column:
    """A key by exact value: numbers first, then other texts in byte order; null for null."""
    x = _c(x).cast("string")

    def key(negative: Column, digits: Column, place: Column) -> Column:
        body = F.concat(F.lpad((place + F.lit(BIAS)).cast("string"), WIDE, "0"), digits)
        swapped = F.concat(F.lit("0"), F.translate(body, "0123456789", "9876543210"), F.lit("~"))
        return F.when(digits == "", F.lit("1")).when(negative, swapped).otherwise(F.concat(F.lit("2"), body))

    return F.when(x.isNull(), None).when(is_number(x), _with_parts(x, key)).otherwise(F.concat(F.lit("3"), x))


def normalized_number(x: Column | str) -> Column:
    """``1e2`` as 100, ``1.50`` as 1.5, ``-0`` as 0; other texts as they are."""
    x = _c(x).cast("string")
    zeros = lambda k: F.repeat(F.lit("0"), F.least(F.greatest(k, F.lit(0)), F.lit(LONGEST)).cast("int"))

    def text(negative: Column, digits: Column, place: Column) -> Column:
        n = F.char_length(digits)
        plain = (
            F.when(place <= 0, F.concat(F.lit("0."), zeros(-place), digits))
            .when(place >= n, F.concat(digits, zeros(place - n)))
            .otherwise(F.concat(F.substring(digits, F.lit(1), place.cast("int")), F.lit("."), F.substring(digits, place.cast("int") + 1, n)))
        )
        far = F.concat(digits, F.lit("e"), (place - n).cast("string"))
        value = F.when(F.abs(place) > LONGEST, far).otherwise(plain)
        return F.when(digits == "", F.lit("0")).otherwise(F.concat(F.when(negative, "-").otherwise(""), value))

    return F.when(is_number(x), _with_parts(x, text)).otherwise(x)


def once(x: Column | str, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` names it: bound by a one-element transform."""
    return F.get(F.transform(F.array(_c(x)), f), F.lit(0))


def instant_key(x: Column | str) -> Column:
    """A key by the instant a timestamp names, to any fraction; other texts after, by bytes.

    The text is named several times: one that takes long to make is bound by :func:`once`.
    """
    x = _c(x)
    second = F.concat(F.upper(F.substring(x, 1, 19)), F.upper(F.regexp_extract(x, TIMESTAMP, 2)))
    at = F.unix_seconds(F.try_to_timestamp(second, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    fraction = F.rtrim(F.rtrim(F.regexp_extract(x, TIMESTAMP, 1), F.lit("0")), F.lit("."))
    # null where no instant is named, as a part of it is
    key = F.concat(F.lit("1"), F.lpad((at + F.lit(SECONDS_BIAS)).cast("string"), 12, "0"), fraction)
    return F.coalesce(F.when(x.rlike(TIMESTAMP), key), F.concat(F.lit("2"), x))


def utc(x: Column | str) -> Column:
    """A timestamp's text in UTC, as keys spell it; other texts as they are."""
    x = _c(x)

    def text(key: Column) -> Column:
        seconds = F.substring(key, 2, 12).try_cast("long") - F.lit(SECONDS_BIAS)
        shown = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(key.startswith("1"), F.concat(shown, F.substring(key, F.lit(14), F.char_length(key)), F.lit("Z")))

    return F.coalesce(once(instant_key(x), text), x)


NUMERIC_TYPES = {"int", "integer", "float", "number", "decimal"}


def component(x: Column | str, kind: str) -> Column:
    """A key component: numbers normalised, timestamps in UTC, all else verbatim."""
    x = _c(x)
    if kind == "int":  # a 64-bit integer has one spelling
        return x.cast("string")
    if kind in NUMERIC_TYPES:
        return normalized_number(x)
    return utc(x) if kind == "timestamp" else x.cast("string")


def key_of(columns: list[tuple[Column | str, str]]) -> Column:
    """A row's key: the JSON array of its components; null if any is null."""
    parts, known = [], F.lit(True)
    for x, kind in columns:
        parts.append(component(x, kind))
        known = known & _c(x).isNotNull()
    bare = NUMERIC_TYPES - {"decimal"}
    quoted = [p if k in bare else F.regexp_replace(F.to_json(F.array(p)), r"^\[|\]$", "") for p, (_, k) in zip(parts, columns)]
    return F.when(known, F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")))


def sort_key(x: Column | str, kind: str) -> Column:
    """What a column of a contract type compares and orders by."""
    if kind in ("decimal", "integer"):
        return number_key(x)
    return instant_key(x) if kind == "timestamp" else _c(x)


def typed_equal(a: Column | str, b: Column | str, kind: str) -> Column:
    """Equality under a type, null equal to null."""
    return sort_key(a, kind).eqNullSafe(sort_key(b, kind))


# ---- exact arithmetic -------------------------------------------------------


def _exact() -> Context:
    """Enough digits that sums and products of any texts here are exact."""
    return Context(prec=100_000, Emax=MAX_EMAX, Emin=MIN_EMIN, traps=[Inexact])


def plain(value: Decimal) -> str:
    text = format(value, "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def _arithmetic(op):
    @F.pandas_udf(StringType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        with localcontext(_exact()):
            return pd.Series([None if x is None or y is None else plain(op(Decimal(x), Decimal(y))) for x, y in zip(a, b)])

    return lambda a, b: run(_c(a).cast("string"), _c(b).cast("string"))


#: Sums, differences and products of numbers or their texts, exact at any size.
dec_add = _arithmetic(lambda x, y: x + y)
dec_sub = _arithmetic(lambda x, y: x - y)
dec_mul = _arithmetic(lambda x, y: x * y)


def dec_cmp(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by exact value; built-in functions only."""
    a, b = number_key(a), number_key(b)
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0))


#: ``dec_sum`` splits a number into limbs of this many digits.
LIMB = 9


def dec_sum(df: DataFrame, keys: list[str], column: str, alias: str, before: int = 4, after: int = 4) -> DataFrame:
    """The exact sum of each group, as text; null where all are null.

    Numbers are cut into limbs of nine digits on both sides of the point, limbs
    are summed as integers (a partial aggregate, in generated code), and a group's
    few limb sums are put together at the end. Values beyond ``before`` or
    ``after`` limbs make the query fail rather than round.
    """
    # step by step, so that each part of a number is worked out once
    x = F.col("_x")
    parts = df.select(*keys, F.col(column).cast("string").alias("_x"))
    parts = parts.withColumns(dict(zip(("_negative", "_digits", "_place"), _parts(x))))
    digits, place = F.col("_digits"), F.col("_place")
    fits = is_number(x) & ((digits == "") | (place <= LIMB * before) & (F.char_length(digits) - place <= LIMB * after))
    lead = (F.lit(LIMB * before) - F.least(F.greatest(place, F.lit(-LIMB * after)), F.lit(LIMB * before))).cast("int")
    row = F.rpad(F.concat(F.repeat(F.lit("0"), lead), digits), LIMB * (before + after), "0")
    refused = F.raise_error(F.concat(F.lit("dec_sum can't hold "), x)).cast("string")
    parts = parts.withColumn("_row", F.when(x.isNotNull(), F.when(fits, row).otherwise(refused)))
    sign = F.when(F.col("_negative"), -1).otherwise(1)
    limbs = [F.sum(F.substring("_row", 1 + LIMB * i, LIMB).cast("long") * sign).alias(f"_limb{i}") for i in range(before + after)]
    sums = parts.groupBy(*keys).agg(*limbs)

    @F.pandas_udf(StringType())
    def joined(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns):
            if values[0] is None or pd.isna(values[0]):
                out.append(None)
                continue
            with localcontext(_exact()):
                whole = sum(int(v) * 10 ** (LIMB * (len(values) - 1 - i)) for i, v in enumerate(values))
                out.append(plain(Decimal(whole).scaleb(-LIMB * after)))
        return pd.Series(out)

    return sums.select(*keys, joined(*(F.col(f"_limb{i}") for i in range(before + after))).alias(alias))


#: Texts that are Python strings at one time while a batch is normalised.
NFC_SLICE = 64


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    done, changed = [], False
    for at in range(0, len(texts), NFC_SLICE):
        part = texts.slice(at, NFC_SLICE)
        before = part.to_pylist()
        after = [None if x is None else unicodedata.normalize("NFC", x) for x in before]
        if after != before:
            part, changed = pa.array(after, texts.type), True
        done.append(part)
    return pa.concat_arrays(done) if changed else texts


def nfc(x: Column | str) -> Column:
    """Normalisation form C; texts of ASCII alone are their own and don't go to Python."""
    x = _c(x)
    ascii = F.octet_length(x) == F.char_length(x)
    return F.when(ascii, x).otherwise(_nfc(F.when(~ascii, x)))


# ---- conversions ------------------------------------------------------------

#: Conversions that can be lossless, by source and target type.
LOSSLESS = {
    ("string", "bool"), ("string", "int"), ("string", "float"), ("string", "number"), ("string", "integer"),
    ("string", "decimal"), ("string", "uuid"), ("string", "ulid"), ("int", "decimal"), ("number", "decimal"),
    ("integer", "decimal"), ("float", "decimal"), ("int", "string"), ("number", "string"), ("integer", "string"),
    ("decimal", "string"), ("uuid", "string"), ("ulid", "string"), ("int", "number"), ("int", "integer"),
}


def lossless_convert(x: Column | str, source: str, target: str) -> Column:
    """The value's text under another type where nothing is lost, else null."""
    x = _c(x).cast("string")
    if source == target:
        return x
    if (source, target) not in LOSSLESS:
        return F.lit(None).cast("string")
    if target == "bool":
        return F.when(x.isin("true", "false"), x)
    if target == "int":
        return F.when(x.rlike(INTEGER) & (x != "-0") & x.try_cast("long").isNotNull(), x)
    if target == "integer":
        return F.when(x.rlike(INTEGER) & (x != "-0"), x)
    if target == "float":
        return F.when(x.rlike(FLOAT), x)
    if target == "number":
        return F.when(is_number(x), x)
    if target == "decimal":
        return F.when(is_number(x), normalized_number(x))
    if target == "uuid":
        return F.when(F.lower(x).rlike(UUID), F.lower(x))
    if target == "ulid":
        return F.when(F.upper(x).rlike(ULID), F.upper(x))
    return x


# ---- keys of single values --------------------------------------------------


def number_key_of(text: str) -> str:
    """:func:`number_key` of one text, for literals and parameters."""
    import re

    if not re.match(NUMBER, text):
        return "3" + text
    value = Decimal(text)
    if not value:
        return "1"
    digits = "".join(map(str, value.as_tuple().digits)).lstrip("0")
    place = len(digits) + value.as_tuple().exponent
    body = str(place + BIAS).rjust(WIDE, "0") + digits.rstrip("0")
    if value > 0:
        return "2" + body
    return "0" + body.translate(str.maketrans("0123456789", "9876543210")) + "~"


def instant_key_of(text: str) -> str:
    """:func:`instant_key` of one text."""
    import datetime as dt
    import re

    m = re.match(TIMESTAMP, text)
    if not m:
        return "2" + text
    try:
        at = dt.datetime.fromisoformat(text[:19].upper() + m[2].upper().replace("Z", "+00:00"))
    except ValueError:
        return "2" + text
    fraction = (m[1] or "").rstrip("0")
    seconds = int((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds())
    return "1" + str(seconds + SECONDS_BIAS).rjust(12, "0") + ("" if fraction == "." else fraction)
