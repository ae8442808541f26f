"""Column expressions with Python's rules for nulls, NaN, types and division, where these differ from SQL's."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _family(a: Column) -> Column:
    """Numbers of all kinds are one family of types; a bare null is of none. Spark folds this to a constant."""
    kind = F.typeof(a)
    return F.when(kind.rlike("int$|^(double|float|decimal.*)$"), "number").when(kind == "void", F.lit(None)).otherwise(kind)


def eq(a: Column, b) -> Column:
    """a == b: null equals null, NaN equals nothing, and a value never equals one of another type, as 5 and '5'."""
    b = _c(b)
    differ = F.coalesce(_family(a) != _family(b), F.lit(False))
    return F.when(differ, a.isNull() & b.isNull()).otherwise(a.eqNullSafe(b) & ~_nan(a))


def ne(a: Column, b) -> Column:
    return ~eq(a, b)


def _nan(a: Column) -> Column:
    """Whether a is a NaN of a floating type; the text "NaN" is a text like any other."""
    return F.when(F.typeof(a).isin("float", "double"), F.coalesce(F.isnan(a.try_cast("double")), F.lit(False))).otherwise(False)


def _ordered(a: Column, b, how) -> Column:
    """A comparison that is False, not null, where either side is null or NaN."""
    b = _c(b)
    return F.coalesce(how(a, b) & ~_nan(a) & ~_nan(b), F.lit(False))


def lt(a: Column, b) -> Column:
    return _ordered(a, b, lambda x, y: x < y)


def le(a: Column, b) -> Column:
    return _ordered(a, b, lambda x, y: x <= y)


def gt(a: Column, b) -> Column:
    return _ordered(a, b, lambda x, y: x > y)


def ge(a: Column, b) -> Column:
    return _ordered(a, b, lambda x, y: x >= y)


def is_null(a: Column) -> Column:
    return a.isNull()


def fill_null(a: Column, value) -> Column:
    """Only nulls are filled; NaN is a value."""
    return F.coalesce(a, _c(value))


def add(a: Column, b, kind: str = "number") -> Column:
    """Sum of numbers, or concatenation of strings or arrays (kind "text"); null if either side is null."""
    return a + _c(b) if kind == "number" else F.concat(a, _c(b))


def sub(a: Column, b) -> Column:
    return a - _c(b)


def mul(a: Column, b, kind: str = "number") -> Column:
    """Product, or a string repeated b times (kind "text")."""
    return a * _c(b) if kind == "number" else F.repeat(a, _c(b))


def div(a: Column, b) -> Column:
    """a / b; NaN where b is 0, even for null a."""
    b = _c(b)
    return F.when(b == 0, F.lit(NAN)).otherwise(a / b)


def floor_div(a: Column, b) -> Column:
    """Quotient rounded towards minus infinity, as a double; NaN where b is 0, either side is NaN, or a is infinite."""
    b = _c(b)
    x, y = a.cast("double"), b.cast("double")
    q = x / F.when(y != 0, y)
    # a double from 2 ** 53 on is whole; 0 keeps its sign; a finite number by an infinite one is 0 or, with unlike signs, just below
    whole = F.when((F.abs(q) >= float(1 << 53)) | (x == 0), q).when(F.abs(y) == float("inf"), F.when((x < 0) != (y < 0), -1.0).otherwise(0.0)).otherwise(F.floor(q).cast("double"))
    return F.when((y == 0) | F.isnan(x) | F.isnan(y) | (F.abs(x) == float("inf")), F.lit(NAN)).otherwise(whole)


def as_type(a: Column, kind: str) -> Column:
    """Conversion that gives null where the value doesn't convert."""
    return a.try_cast(kind)


def as_text(a: Column, kind: str = "string") -> Column:
    """Text as Python writes it: True and False for booleans."""
    return F.initcap(a.cast("string")) if kind == "boolean" else a.cast("string")


def strip(a: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(a, r"^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def contains_ci(a: Column, pattern: str) -> Column:
    """Whether the regular expression is found, whatever the case; False for null."""
    return F.coalesce(a.rlike(f"(?i){pattern}"), F.lit(False))


def split_plain(a: Column, delimiter: str) -> Column:
    """Split at a plain string, not at a regular expression."""
    return F.split(a, "\\Q" + delimiter + "\\E")


def sha256_chain(a: Column, rounds: int) -> Column:
    """`rounds` of SHA-256, each over the raw digest of the one before, as hex; the value itself for no round."""
    if rounds < 1:
        return a
    return functools.reduce(lambda h, _: F.sha2(F.unhex(h), 256), range(rounds - 1), F.sha2(a.cast("binary"), 256))


def truthy(a: Column, kind: str) -> Column:
    """Python truth: not null, and neither false nor 0 nor an empty text."""
    return F.coalesce(a if kind == "boolean" else a != "" if kind == "string" else a != 0, F.lit(False))


def as_json(*columns: Column | str) -> Column:
    """The columns as a JSON object; null fields are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def bucket_label(a: Column, bounds: list[float]) -> Column:
    """Label of the first bound that is at least the value, `+Inf` beyond all; null stays null."""
    out = F.when(a.isNull(), F.lit(None).cast("string"))
    for b in bounds:
        out = out.when(le(a, b), F.lit(f"{b:g}"))
    return out.otherwise("+Inf")
