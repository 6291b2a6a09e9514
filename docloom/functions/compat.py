"""Scalar and aggregate functions whose rules differ from Spark's own.

Each is a composition of built-in functions with the documented rule: prefix
casts, substrings counted through zero, least and greatest that turn null with
any null, C-style formats, calendar modifiers that overflow into the next
month. What Spark has under the same rules is used directly.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FORMAT = re.compile(r"%[-+0 #]*\d*(?:\.\d+)?([a-zA-Z%])")


def substr(x: Column, start: int, size: int | None = None) -> Column:
    """Substring from 1, from the end if negative; 0 counts as one before 1."""
    if start == 0 and size is not None:
        return F.substring(x, 1, max(0, size - 1))
    if start < 0:
        # Positions before the text use up the size.
        begin = F.length(x) + start + 1
        taken = F.lit(2**31 - 1) if size is None else F.lit(size)
        return F.substring(x, F.greatest(begin, F.lit(1)), F.greatest(taken + F.least(begin - 1, F.lit(0)), F.lit(0)))
    return F.substring(x, max(1, start), 2**31 - 1 if size is None else size)


def glob(x: Column, pattern: str) -> Column:
    """Case-sensitive match of ``*``, ``?`` and ``[...]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "^!" else body) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c)
        i += 1
    return x.rlike(rf"(?s)\A{out}\z")


def like(x: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(x, upper, lower).like(pattern.translate(str.maketrans(upper, lower)))


def cast_integer(x: Column) -> Column:
    """The leading integer of a text, 0 if none."""
    return F.coalesce(F.regexp_extract(x.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def cast_real(x: Column) -> Column:
    """The leading number of a text, 0.0 if none."""
    return F.coalesce(F.regexp_extract(x.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def maximum(*xs: Column) -> Column:
    """Greatest argument; null if any is null."""
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(F.greatest(*xs))


def minimum(*xs: Column) -> Column:
    """Least argument; null if any is null."""
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(F.least(*xs))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def rounded(x: Column, digits: int = 0) -> Column:
    """Half away from zero, always a double."""
    return F.round(x.cast("double"), digits)


def divide(a: Column, b: Column, integral: bool) -> Column:
    """Truncating for integers, exact for all of 64 bits; null on zero."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b, F.lit(0)).cast("bigint")) if integral else F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; null on zero."""
    return F.when(b != 0, a % b)


def quote(x: Column) -> Column:
    """A text as an SQL literal."""
    return F.when(x.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")))


def typeof(doc: Column, path: str = "$") -> Column:
    """null, integer, real, text, true, false, object or array of a JSON value."""
    v = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    kind = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null")
        .when(kind == "BIGINT", "integer")
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "real")
        .when(kind == "STRING", "text")
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "true").otherwise("false"))
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
    )


def char(*codes: int) -> Column:
    """Code points as a text."""
    return F.lit("".join(map(chr, codes)))


def unicode(x: Column) -> Column:
    """Code point of the first character."""
    return F.when(F.length(x) > 0, F.ascii(x))


def total(x: Column) -> Column:
    """Sum as a double; 0.0 over no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, separator: str = ",") -> Column:
    """Texts of a group in order, joined; null over no values."""
    return F.array_join(F.when(F.count(x) > 0, F.array_sort(F.collect_list(x.cast("string")))), separator)


def group_array(x: Column) -> Column:
    """Values of a group, in order, as a JSON array."""
    return F.to_json(F.array_sort(F.collect_list(x)))


def group_object(key: Column, value: Column) -> Column:
    """Pairs of a group, in order of key, as a JSON object."""
    pairs = F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v"))))
    return F.to_json(F.map_from_entries(pairs))


def json_valid(x: Column) -> Column:
    return F.try_parse_json(x).isNotNull()


def json_extract(x: Column, path: str) -> Column:
    """The value at a path as text."""
    return F.get_json_object(x, path)


def json_patch(doc: Column, patch: Column) -> Column:
    """Top-level members of ``patch`` put over those of ``doc``; nulls remove."""
    raw = "map<string,variant>"
    base, over = F.from_json(doc, raw), F.from_json(patch, raw)
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.to_json(F.map_concat(kept, F.map_filter(over, lambda _, v: v.isNotNull() & ~F.is_variant_null(v))))


def json_set(doc: Column, key: str, value: Column) -> Column:
    """Set one top-level member."""
    return json_patch(doc, F.to_json(F.create_map(F.lit(key), value)))


def json_insert(doc: Column, key: str, value: Column) -> Column:
    """Set one top-level member where there is none."""
    held = F.map_contains_key(F.from_json(doc, "map<string,variant>"), F.lit(key))
    return F.when(held, doc).otherwise(json_set(doc, key, value))


def json_replace(doc: Column, key: str, value: Column) -> Column:
    """Set one top-level member where there is one."""
    held = F.map_contains_key(F.from_json(doc, "map<string,variant>"), F.lit(key))
    return F.when(held, json_set(doc, key, value)).otherwise(doc)


def json_remove(doc: Column, key: str) -> Column:
    """Remove one top-level member."""
    base = F.from_json(doc, "map<string,variant>")
    return F.to_json(F.map_filter(base, lambda k, _: k != key))


def julianday(ts: Column) -> Column:
    """Days since noon of 24 November 4714 BC."""
    seconds = F.unix_micros(ts.cast("timestamp")) / 1e6
    return seconds / 86400.0 + 2440587.5


def unixepoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


#: C date formats and Spark's patterns for them.
DATE_FORMATS = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%p": "a", "%I": "hh",
}


def strftime(fmt: str, ts: Column) -> Column:
    """A timestamp in a C date format."""
    out, i = [], 0
    while i < len(fmt):
        code = fmt[i : i + 2]
        if code == "%s":
            out.append(unixepoch(ts).cast("string"))
        elif code == "%w":
            out.append((F.dayofweek(ts) - 1).cast("string"))
        elif code == "%%":
            out.append(F.lit("%"))
        elif code in DATE_FORMATS:
            out.append(F.date_format(ts, DATE_FORMATS[code]))
        else:
            out.append(F.lit(fmt[i]))
            i -= 1
        i += 2
    return F.concat(*out)


def add_months(ts: Column, months: int) -> Column:
    """Months later; a day that the month lacks runs over into the next."""
    first = F.add_months(F.trunc(ts, "month"), months)
    return F.date_add(first, F.dayofmonth(ts) - 1)


def start_of(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def next_weekday(ts: Column, day: int) -> Column:
    """The same day or the next one with weekday ``day`` (0: Sunday)."""
    return F.date_add(ts, F.pmod(F.lit(day) - (F.dayofweek(ts) - 1), F.lit(7)))


def printf(fmt: str, *xs: Column) -> Column:
    """C-style format; numbers for ``%f``, ``%e`` and ``%g`` become doubles."""
    codes = [m for m in _FORMAT.findall(fmt) if m != "%"]
    if len(codes) != len(xs):
        raise ValueError(f"{fmt!r} takes {len(codes)} values")
    cast = {"d": "bigint", "i": "bigint", "x": "bigint", "X": "bigint", "o": "bigint", "f": "double", "e": "double", "g": "double", "s": "string", "c": "string"}
    return F.format_string(fmt.replace("%i", "%d"), *[x.cast(cast[c]) for c, x in zip(codes, xs)])


def timediff(a: Column, b: Column) -> Column:
    """``a - b`` as ``+DDDD HH:MM:SS`` in days."""
    seconds = F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))
    n = F.abs(seconds)
    return F.concat(
        F.when(seconds < 0, "-").otherwise("+"),
        F.format_string("%04d %02d:%02d:%02d", F.floor(n / 86400), F.floor(n / 3600) % 24, F.floor(n / 60) % 60, n % 60),
    )


def json_quote(x: Column) -> Column:
    """A value as JSON text."""
    inner = F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(inner, F.lit(6), F.length(inner) - 6)


def json_array_length(x: Column, path: str = "$") -> Column:
    """Members of the array at a path; 0 for another value."""
    at = F.get_json_object(x, path)
    return F.when(at.isNotNull(), F.coalesce(F.json_array_length(at), F.lit(0)))


def json_each(df: DataFrame, column: str) -> DataFrame:
    """One row per member of the JSON value in ``column``: ``pos, key, value``."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.try_parse_json(F.col(column).outer())))


def octet_length(x: Column) -> Column:
    return F.octet_length(x)


def concat(*xs: Column) -> Column:
    """Texts joined, nulls left out."""
    return F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs])
