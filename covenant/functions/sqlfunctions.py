"""Functions that Spark SQL lacks, registered in a session by name, Arrow-batched."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from . import exact, jsons

#: Limbs of nine digits before and after the point that an exact sum holds.
BEFORE, AFTER = 8, 8


def _plain(v: object) -> object:
    """A Spark value as JSON has it."""
    if v is None or isinstance(v, float) and v != v:
        return None
    return v.item() if isinstance(v, np.generic) else v


def _value(flag: str, v: object) -> object:
    v = _plain(v)
    return jsons.loads(v) if flag == "j" and v is not None else v


def _rowwise(kind, one: Callable):
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns):
            try:
                out.append(one(*values))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)


def _decimal(op: Callable):
    def one(a, b):
        if a is None or b is None:
            return None
        with localcontext(exact._exact()):  # noqa: SLF001
            return exact.plain(op(Decimal(a), Decimal(b)))

    return _rowwise(StringType(), one)


def _limbs(x: str | None) -> list[int] | None:
    """A number's nine-digit limbs, highest first, each with the number's sign."""
    if x is None:
        return None
    with localcontext(exact._exact()):  # noqa: SLF001
        scaled = Decimal(x).scaleb(exact.LIMB * AFTER)
        if scaled != scaled.to_integral_value() or abs(scaled) >= Decimal(10) ** (exact.LIMB * (BEFORE + AFTER)):
            raise OverflowError(f"dec_sum can't hold {x}")
        digits = str(abs(int(scaled))).rjust(exact.LIMB * (BEFORE + AFTER), "0")
    sign = -1 if x.startswith("-") else 1
    return [sign * int(digits[i : i + exact.LIMB]) for i in range(0, len(digits), exact.LIMB)]


def _joined(sums) -> str | None:
    if sums is None or sums[0] is None or sums[0] != sums[0]:
        return None
    with localcontext(exact._exact()):  # noqa: SLF001
        whole = sum(int(v) * 10 ** (exact.LIMB * (len(sums) - 1 - i)) for i, v in enumerate(sums))
        return exact.plain(Decimal(whole).scaleb(-exact.LIMB * AFTER))


def _edited(make: bool, replace: bool):
    def one(flags, x, *pairs):
        if x is None:
            return None
        v = jsons.loads(x)
        for i in range(0, len(pairs) - 1, 2):
            v = jsons.edited(v, jsons.steps(pairs[i]), _value(flags[i + 2], pairs[i + 1]), make, replace)
        return jsons.dumps(v)

    return one


def _removed(x, *paths):
    if x is None:
        return None
    v = jsons.loads(x)
    for p in paths:
        v = jsons.removed(v, jsons.steps(p))
    return jsons.dumps(v)


def _type(x, path):
    if x is None:
        return None
    there, v = jsons._at(jsons.loads(x), jsons.steps(path))  # noqa: SLF001
    return jsons.type_name(v) if there else None


def _error(x):
    import json

    if x is None:
        return None
    try:
        json.loads(x)
    except json.JSONDecodeError as e:
        return e.pos + 1
    return 0


def _object(flags, *pairs):
    return jsons.dumps({str(_plain(pairs[i])): _value(flags[i + 1], pairs[i + 1]) for i in range(0, len(pairs) - 1, 2)})


def functions() -> dict[str, object]:
    text = StringType()
    names = jsons.ROW.fieldNames()
    table = lambda deep: _rowwise(ArrayType(jsons.ROW), lambda t: [dict(zip(names, r)) for r in jsons.rows_of(t, deep)])
    normal = lambda x: None if x is None else __import__("unicodedata").normalize("NFC", x)
    return {
        "covenant_number_key": _rowwise(text, lambda x: None if x is None else exact.number_key_of(x)),
        "covenant_instant_key": _rowwise(text, lambda x: None if x is None else exact.instant_key_of(x)),
        "covenant_nfc": _rowwise(text, normal),
        "covenant_dec_add": _decimal(lambda a, b: a + b),
        "covenant_dec_sub": _decimal(lambda a, b: a - b),
        "covenant_dec_mul": _decimal(lambda a, b: a * b),
        "covenant_limbs": _rowwise(ArrayType(LongType()), _limbs),
        "covenant_dec_join": _rowwise(text, _joined),
        "covenant_json_minified": _rowwise(text, lambda x: None if x is None else jsons.dumps(jsons.loads(x))),
        "covenant_json_array": _rowwise(text, lambda flags, *xs: jsons.dumps([_value(f, v) for f, v in zip(flags, xs)])),
        "covenant_json_object": _rowwise(text, _object),
        "covenant_json_set": _rowwise(text, _edited(True, True)),
        "covenant_json_insert": _rowwise(text, _edited(True, False)),
        "covenant_json_replace": _rowwise(text, _edited(False, True)),
        "covenant_json_remove": _rowwise(text, _removed),
        "covenant_json_patch": _rowwise(text, lambda x, p: None if x is None or p is None else jsons.dumps(jsons.patched(jsons.loads(x), jsons.loads(p)))),
        "covenant_json_pretty": _rowwise(text, lambda x: None if x is None else jsons.pretty(jsons.loads(x))),
        "covenant_json_quote": _rowwise(text, lambda x: jsons.dumps(_plain(x))),
        "covenant_json_type": _rowwise(text, _type),
        "covenant_json_error_position": _rowwise(LongType(), _error),
        "covenant_json_each": table(False),
        "covenant_json_tree": table(True),
    }


def register(spark: SparkSession, wanted: set[str]) -> None:
    """Registers those of the names that the session doesn't have yet."""
    missing = [n for n in sorted(wanted) if not spark.catalog.functionExists(n)]
    if missing:
        made = functions()
        for n in missing:
            spark.udf.register(n, made[n])
