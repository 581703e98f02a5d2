"""Calls of the dialect's functions, said in Spark SQL."""

from __future__ import annotations

import re

from ..functions.sqlfunctions import AFTER, BEFORE
from .sqlfront import QueryError
from .translate import AGGREGATES, EXACT, LOWER, UPPER, E, Scope, Translator, folded, glob, like, name, text

#: Functions that Spark has under the same name and with the same meaning, and what they give.
SAME = {
    **dict.fromkeys("abs".split()),
    **dict.fromkeys("length octet_length instr row_number rank dense_rank ntile ascii".split(), "int"),
    **dict.fromkeys("percent_rank cume_dist acos acosh asin asinh atan atan2 atanh cos cosh degrees exp pi pow power radians sin sinh tan tanh".split(), "real"),
    **dict.fromkeys("replace hex repeat reverse lpad rpad".split(), "text"),
    **dict.fromkeys("lag lead first_value last_value nth_value coalesce nullif".split()),
}
MODIFIER = re.compile(r"^([+-]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?$")
# Conversions of the strftime function and their formats here.
FORMATS = {"%d": "dd", "%H": "HH", "%I": "hh", "%j": "DDD", "%m": "MM", "%M": "mm", "%S": "ss", "%Y": "yyyy", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%p": "a", "%f": "ss.SSS"}


def called(tr: Translator, s: Scope, function: str) -> E:
    """The call whose name has been read and whose bracket comes next."""
    tr.needs("(")
    aggregate = function in AGGREGATES
    held = s.in_aggregate
    distinct, order, args = False, "", []
    if function in ("min", "max"):  # of one argument an aggregate, of several a function
        aggregate = _single(tr)
    s.in_aggregate = held or aggregate
    if tr.takes("*"):
        args = [E("*")]
    else:
        distinct = tr.takes("DISTINCT")
        while tr.peek().text not in (")", "") and tr.peek().word != "ORDER":
            args.append(tr.expr(s))
            if not tr.takes(","):
                break
        if tr.takes("ORDER", "BY"):
            order = tr.ordered(s, [])
    tr.needs(")")
    out = _made(tr, function, args, aggregate, distinct, order)
    if tr.takes("FILTER", "("):
        tr.needs("WHERE")
        out.sql = _filtered(out.sql, tr.expr(s).sql)
        tr.needs(")")
    s.in_aggregate = held
    out.aggregate = aggregate or any(x.aggregate for x in args)
    if tr.takes("OVER"):
        if tr.takes("("):
            over = f"({tr.window(s)})"
            tr.needs(")")
        else:
            over = name(tr.next().text)
        if out.key:
            out.key = f"{out.key} OVER {over}"
        wrapped = re.match(r"coalesce\((sum\(.*\)), 0D\)$", out.sql)
        out.sql = f"coalesce({wrapped[1]} OVER {over}, 0D)" if wrapped else f"{out.sql} OVER {over}"
        out.aggregate = any(x.aggregate for x in args)
    return out


def _filtered(sql: str, condition: str) -> str:
    wrapped = re.match(r"coalesce\((sum\(.*\)), 0D\)$", sql)
    if wrapped:
        return f"coalesce({wrapped[1]} FILTER (WHERE {condition}), 0D)"
    wrapped = re.match(r"(covenant_\w+)\((\w+\(.*\))\)$", sql)
    return f"{wrapped[1]}({wrapped[2]} FILTER (WHERE {condition}))" if wrapped else f"{sql} FILTER (WHERE {condition})"


def _single(tr: Translator) -> bool:
    depth, k = 1, 0
    while depth and tr.peek(k).kind != "none":
        t = tr.peek(k)
        depth += (t.text == "(") - (t.text == ")")
        if depth == 1 and t.text == ",":
            return False
        k += 1
    return True


def _made(tr: Translator, f: str, a: list[E], aggregate: bool, distinct: bool, order: str) -> E:
    one = a[0] if a else E("")
    x = [e.sql for e in a]
    each = "DISTINCT " if distinct else ""
    exact = one.kind in EXACT and one.key
    if f == "count":
        return E(f"count({each}{tr.keyed(one) if distinct else one.sql})", "int")
    if f in ("sum", "avg"):
        kind = "int" if f == "sum" and one.kind == "int" else "real"
        return E(f"{f}({each}{tr.number(one)})", kind)
    if f == "total":
        return E(f"coalesce(sum({each}cast({tr.number(one)} AS double)), 0D)", "real")
    if f in ("min", "max"):
        if aggregate:
            return E(f"{f}_by({one.sql}, {one.key})", one.kind, f"{f}({one.key})") if exact else E(f"{f}({one.sql})", one.kind)
        kind = next((e.kind for e in a if e.kind in EXACT and e.key), None)
        none = " OR ".join(f"{e} IS NULL" for e in x)
        best = "greatest" if f == "max" else "least"
        if kind:
            keys = [tr.key_of(e, kind) for e in a]
            pairs = ", ".join(f"struct({k} AS k, cast({e.sql} AS string) AS v)" for k, e in zip(keys, a))
            return E(f"if({none}, NULL, {best}({pairs}).v)", kind, f"if({none}, NULL, {best}({', '.join(keys)}))")
        return E(f"if({none}, NULL, {best}({', '.join(x)}))", one.kind if len({e.kind for e in a}) == 1 else None)
    if f in ("group_concat", "string_agg"):
        within = f" WITHIN GROUP (ORDER BY {order})" if order else ""
        return E(f"listagg({each}cast({one.sql} AS string), {x[1] if len(x) > 1 else repr(',')}){within}", "text")
    if f in ("json_group_array", "jsonb_group_array"):
        return E(f"to_json(collect_list({each}{one.sql}))", "text", json=True)
    if f in ("json_group_object", "jsonb_group_object"):
        return E(f"to_json(map_from_entries(collect_list(struct({x[0]}, {x[1]}))))", "text", json=True)
    if f == "dec_sum":
        # limbs are summed as integers, by partial aggregates; a group's few sums are put together
        limb = tr.call("covenant_limbs", f"cast({one.sql} AS string)")
        sums = ", ".join(f"sum({each}{limb}[{i}])" for i in range(BEFORE + AFTER))
        return E(tr.call("covenant_dec_join", f"array({sums})"), "number")
    if f in ("dec_add", "dec_sub", "dec_mul"):
        return E(tr.call(f"covenant_{f}", *(f"cast({e} AS string)" for e in x)), "number")
    if f == "dec_cmp":
        p, q = (tr.key_of(e, "number") for e in a)
        return E(f"CASE WHEN {p} < {q} THEN -1 WHEN {p} > {q} THEN 1 WHEN {p} = {q} THEN 0 END", "int")
    if f == "nfc":
        return E(tr.call("covenant_nfc", f"cast({one.sql} AS string)"), "text")
    if f == "round":
        digits = x[1] if len(x) > 1 else "0"
        return E(f"round(cast({tr.number(one)} AS double), {digits})", "real")
    if f == "sign":
        return E(f"cast(sign({tr.number(one)}) AS int)", "int")
    if f in ("ceil", "ceiling", "floor"):
        return E(x[0] if one.kind == "int" else f"cast({f}({tr.number(one)}) AS double)", one.kind or "real")
    if f == "trunc":
        return E(x[0] if one.kind == "int" else f"(sign({x[0]}) * floor(abs({x[0]})))", one.kind or "real")
    if f == "mod":
        return E(f"try_mod(cast({tr.number(one)} AS double), cast({tr.number(a[1])} AS double))", "real")
    if f == "sqrt":
        return E(f"if({x[0]} >= 0, sqrt({x[0]}), NULL)", "real")
    if f in ("ln", "log", "log10", "log2"):
        base = {"ln": None, "log10": "10", "log2": "2", "log": x[0] if len(x) == 2 else "10"}[f]
        v = x[-1]
        made = f"ln({v})" if base is None else f"log10({v})" if base == "10" else f"log2({v})" if base == "2" else f"(ln({v}) / ln({base}))"
        return E(f"if({v} > 0, {made}, NULL)", "real")
    if f in ("likely", "unlikely", "likelihood"):
        return one
    if f in ("iif", "if"):
        kinds = {e.kind for e in a[1:]}
        rest = x if len(x) > 2 else [*x, "NULL"]
        made = rest[-1] if len(rest) % 2 else "NULL"
        for c, v in reversed(list(zip(rest[0 : len(rest) - len(rest) % 2 : 2], rest[1::2]))):
            made = f"if({c}, {v}, {made})"
        return E(made, kinds.pop() if len(kinds) == 1 else None)
    if f in ("coalesce", "ifnull", "nullif"):
        kinds = {e.kind for e in a if e.sql.upper() != "NULL"}
        kind = kinds.pop() if len(kinds) == 1 else None
        same = "coalesce" if f == "ifnull" else f
        if f == "nullif":
            p, q = tr.pair(a[0], a[1])
            return E(f"if({p} = {q}, NULL, {x[0]})", one.kind, one.key and f"if({p} = {q}, NULL, {one.key})")
        key = f"coalesce({', '.join(e.key for e in a)})" if kind in EXACT and all(e.key for e in a) else None
        return E(f"{same}({', '.join(x)})", kind if key or kind not in EXACT else "text", key)
    if f == "concat":
        return E(f"concat_ws('', {', '.join(f'cast({e} AS string)' for e in x)})", "text")
    if f == "concat_ws":
        return E(f"concat_ws({x[0]}, {', '.join(f'cast({e} AS string)' for e in x[1:])})", "text")
    if f == "length":
        return E(f"char_length(cast({x[0]} AS string))" if one.kind != "blob" else f"octet_length({x[0]})", "int")
    if f == "lower":
        return E(folded(x[0]), "text")
    if f == "upper":
        return E(f"translate(cast({x[0]} AS string), '{LOWER}', '{UPPER}')", "text")
    if f in ("trim", "ltrim", "rtrim"):
        side = {"trim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[f]
        return E(f"trim({side} {x[1] if len(x) > 1 else repr(' ')} FROM {x[0]})", "text")
    if f in ("substr", "substring"):
        return E(_substr(*x), "text")
    if f == "char":
        return E("concat('', " + ", ".join(f"decode(unhex(lpad(hex({e}), 8, '0')), 'UTF-32')" for e in x) + ")", "text")
    if f == "unicode":
        return E(f"if(char_length({x[0]}) > 0, ascii({x[0]}), NULL)", "int")
    if f == "hex":
        return E(f"hex(cast({x[0]} AS binary))" if one.kind == "blob" else f"hex(cast({x[0]} AS string))", "text")
    if f == "unhex":
        return E(f"unhex({x[0]})", "blob")
    if f == "zeroblob":
        return E(f"unhex(repeat('00', {x[0]}))", "blob")
    if f == "quote":
        if one.kind in ("int", "real"):
            return E(f"coalesce(cast({x[0]} AS string), 'NULL')", "text")
        if one.kind == "blob":
            return E(f"coalesce(concat('X\\'', hex({x[0]}), '\\''), 'NULL')", "text")
        return E(f"coalesce(concat('\\'', replace({x[0]}, '\\'', '\\'\\''), '\\''), 'NULL')", "text")
    if f == "typeof":
        kind = {"int": "integer", "bool": "integer", "real": "real", "blob": "blob", None: None}.get(one.kind, "text")
        if kind is None:
            by = "('tinyint', 'smallint', 'int', 'bigint', 'boolean')"
            return E(f"CASE WHEN {x[0]} IS NULL THEN 'null' WHEN typeof({x[0]}) IN {by} THEN 'integer' WHEN typeof({x[0]}) IN ('double', 'float') THEN 'real' WHEN typeof({x[0]}) = 'binary' THEN 'blob' ELSE 'text' END", "text")
        return E(f"if({x[0]} IS NULL, 'null', '{kind}')", "text")
    if f == "like":
        return E(like(a[1].sql, a[0], a[2] if len(a) > 2 else None), "bool")
    if f == "glob":
        if a[0].literal is None:
            raise QueryError("QUERY_UNSUPPORTED", "glob needs a literal pattern")
        return E(f"(cast({x[1]} AS string) RLIKE {text(glob(a[0].literal))})", "bool")
    if f in ("format", "printf"):
        return E(f"format_string({', '.join(x)})", "text")
    if f in ("date", "time", "datetime", "julianday", "unixepoch", "strftime", "timediff"):
        return _dated(tr, f, a)
    if f.startswith("json"):
        return _json(tr, f.replace("jsonb", "json", 1), a)
    if f == "soundex":
        return E(f"if(soundex({x[0]}) RLIKE '^[A-Z]', soundex({x[0]}), '?000')", "text")
    if f in SAME or f.startswith("covenant_"):
        kind = SAME.get(f) or (one.kind if f in ("abs", "lag", "lead", "first_value", "last_value", "nth_value") and one.kind not in EXACT else None)
        args = [tr.number(one), *x[1:]] if f == "abs" else x
        key = f"{f}({', '.join([one.key, *x[1:]])})" if exact and f in ("first_value", "last_value", "nth_value", "lag", "lead") else None
        return E(f"{f}({', '.join(args)})", one.kind if key else kind, key)
    return E(f"{f}({each}{', '.join(x)})")


def _substr(x: str, start: str, length: str | None = None) -> str:
    """Characters from ``start``; position 0 stands before the first and uses up one."""
    n = f"char_length({x})"
    first = f"if({start} >= 0, {start}, {n} + {start} + 1)"
    if length is None:
        return f"substring({x}, greatest({first}, 1), {n})"
    low, high = f"least({first}, {first} + {length})", f"greatest({first}, {first} + {length})"
    return f"substring({x}, greatest({low}, 1), greatest({high}, 1) - greatest({low}, 1))"


def _moment(x: E, modifiers: list[E]) -> str:
    at = "current_timestamp()" if x.literal is not None and x.literal.lower() == "now" else f"timestamp_seconds({x.sql})" if any(m.literal == "unixepoch" for m in modifiers) else f"cast({x.sql} AS timestamp)"
    for m in modifiers:
        how = (m.literal or "").strip().lower()
        if how in ("unixepoch", "utc", "auto"):
            continue
        if how.startswith("start of "):
            at = f"date_trunc('{how.removeprefix('start of ')}', {at})"
        elif how.startswith("weekday "):
            at = f"({at} + make_dt_interval(pmod({int(how.removeprefix('weekday ')) + 1} - dayofweek({at}), 7)))"
        elif found := MODIFIER.match(how):
            n, unit = float(found[1]), found[2]
            if unit in ("month", "year"):
                first = f"date_trunc('month', {at})"
                at = f"(cast(add_months({first}, {int(n) * (12 if unit == 'year' else 1)}) AS timestamp) + ({at} - {first}))"
            else:
                seconds = n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
                at = f"({at} + make_dt_interval(0, 0, 0, cast({seconds} AS decimal(18, 6))))"
        else:
            raise QueryError("QUERY_UNSUPPORTED", f"the modifier {m.literal!r}")
    return at


def _dated(tr: Translator, f: str, a: list[E]) -> E:
    if f == "timediff":
        raise QueryError("QUERY_UNSUPPORTED", "timediff stands in DataFrame queries only")
    pattern, rest = (a[0].literal, a[1:]) if f == "strftime" else (None, a)
    at = _moment(rest[0] if rest else E("", literal="now"), rest[1:])
    julian = f"(unix_micros({at}) / 86400000000D + 2440587.5D)"
    if f == "julianday":
        return E(julian, "real")
    if f == "unixepoch":
        return E(f"unix_seconds({at})", "int")
    if f != "strftime":
        made = {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "datetime": "yyyy-MM-dd HH:mm:ss"}[f]
        return E(f"date_format({at}, '{made}')", "text")
    parts = ["''"]
    special = {"%s": f"cast(unix_seconds({at}) AS string)", "%w": f"cast(dayofweek({at}) - 1 AS string)", "%u": f"cast(weekday({at}) + 1 AS string)", "%J": f"cast({julian} AS string)", "%%": "'%'"}
    for part in re.split(r"(%.)", pattern or ""):
        if part in FORMATS:
            parts.append(f"date_format({at}, '{FORMATS[part]}')")
        elif part:
            parts.append(special.get(part) or text(part))
    return E(f"concat({', '.join(parts)})", "text")


def _json(tr: Translator, f: str, a: list[E]) -> E:
    x = [e.sql for e in a]
    flags = text("".join("j" if e.json else "v" for e in a))
    if f == "json":
        return E(tr.call("covenant_json_minified", x[0]), "text", json=True)
    if f == "json_valid":
        return E(f"(try_parse_json({x[0]}) IS NOT NULL)", "bool")
    if f == "json_extract":
        if len(a) == 2:
            return E(f"get_json_object({x[0]}, {x[1]})", "text")
        return E(tr.call("covenant_json_array", text("j" * (len(a) - 1)), *(f"to_json(try_variant_get(try_parse_json({x[0]}), {p}, 'variant'))" for p in x[1:])), "text", json=True)
    if f == "json_array_length":
        v = x[0] if len(a) == 1 else f"get_json_object({x[0]}, {x[1]})"
        return E(f"if({v} IS NULL, NULL, coalesce(json_array_length({v}), 0))", "int")
    if f in ("json_array", "json_object", "json_set", "json_insert", "json_replace"):
        return E(tr.call(f"covenant_{f}", flags, *x), "text", json=True)
    if f in ("json_remove", "json_patch", "json_pretty", "json_quote"):
        return E(tr.call(f"covenant_{f}", *x), "text", json=f in ("json_remove", "json_patch"))
    if f == "json_type":
        return E(tr.call("covenant_json_type", *(x if len(x) > 1 else [x[0], "'$'"])), "text")
    if f == "json_error_position":
        return E(tr.call("covenant_json_error_position", x[0]), "int")
    raise QueryError("QUERY_UNSUPPORTED", f"{f} is no function")
