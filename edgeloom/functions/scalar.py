"""Column expressions for the rules by which a script in a browser compares, converts and tests values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a string may look like to be read as a number, after trimming.
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)")
#: What counts as white space.
_SPACE = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_RADIX = {"0x": 16, "0o": 8, "0b": 2}


def truthy(column: Column, number: bool = False) -> Column:
    """Neither null nor empty (for numbers: nor zero). Never null itself."""
    return F.coalesce(column != F.lit(0 if number else ""), F.lit(False))


def contains_literal(column: Column, text: str) -> Column:
    """The text occurs in the column: case-sensitive, without wildcards, without Unicode normalisation."""
    return F.contains(column, F.lit(text))


def js_string(column: Column) -> Column:
    """The column as text, null as the word null."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def regex_find(column: Column, pattern: str) -> Column:
    """The pattern matches somewhere in the column; null is searched as the word null. A pattern that is no pattern raises an error
    when the query runs. Patterns are those of Java, which agree with a browser's but for rare constructs."""
    return F.rlike(js_string(column), F.lit(pattern))


def as_number(text: str) -> float | None:
    """The number that a string is in a loose comparison: trimmed, empty is 0, hexadecimal, octal and binary forms count; None if it is none."""
    text = text.strip(_SPACE)
    if not text:
        return 0.0
    if text[:2].lower() in _RADIX:
        try:
            return float(int(text[2:], _RADIX[text[:2].lower()])) if re.fullmatch("[0-9a-fA-F]+", text[2:]) else None
        except ValueError:
            return None
    if text.lstrip("+-") == "Infinity" and len(text) <= 9:
        return float(text)
    return float(text) if _DECIMAL.fullmatch(text) else None


def loose_equal(column: Column, value: str | int | float, number: bool = False) -> Column:
    """== between a column and a parameter. number: the column holds numbers, so a string parameter is read as one.
    A null column equals nothing."""
    if not number:
        text = value if isinstance(value, str) else str(value)
        return F.coalesce(column == F.lit(text), F.lit(False))
    wanted = as_number(value) if isinstance(value, str) else float(value)
    return F.lit(False) if wanted is None else F.coalesce(column.cast("double") == F.lit(wanted), F.lit(False))


def leading_int(value: Column | str):
    """The whole number that a string starts with, after white space and a sign, decimal or hexadecimal after 0x; null if it starts with none. Of a column as an int column
    (null beyond its range), of a string as an int."""
    start = rf"^[{_SPACE}]*"
    if isinstance(value, str):
        found = re.match(start + r"([+-]?)(?:0[xX]([0-9a-fA-F]+)|([0-9]+))", value)
        if not found:
            return None
        number = int(found[2], 16) if found[2] else int(found[3])
        return -number if found[1] == "-" else number
    sign = F.when(F.regexp_extract(value, start + "([+-]?)", 1) == "-", -1).otherwise(1)
    digits = F.regexp_extract(value, start + "[+-]?0[xX]0*([0-9a-fA-F]+)", 1)
    # Fifteen digits fit a long; longer ones are beyond an int anyhow.
    hexadecimal = F.when(F.length(digits) <= 15, F.conv(digits, 16, 10).try_cast("long"))
    decimal = F.regexp_extract(value, start + "[+-]?([0-9]+)", 1).try_cast("long")
    return (sign * F.when(digits != "", hexadecimal).otherwise(decimal)).try_cast("int")


def default_to(column: Column, other: Column) -> Column:
    """The column, or other where it is null or empty."""
    return F.coalesce(F.nullif(column, F.lit("")), other)


def escape_quotes(text: str) -> str:
    """A backslash before each quotation mark and apostrophe."""
    return re.sub(r"""(["'])""", r"\\\1", text)
