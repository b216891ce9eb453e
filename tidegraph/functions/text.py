"""Scalar text and number functions."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_value(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: what a lambda's body says of other columns is computed anew for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def trimmed(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def normalised_title(s: Column, case_sensitive: bool = False) -> Column:
    return s if case_sensitive else F.upper(s)


def without_brackets(s: Column) -> Column:
    """Without bracketed parts and the spaces before them."""
    return F.regexp_replace(s, r" *\([^)]*\)", "")


def escaped_html(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("`", "&#x60;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def page_link(title: Column, base: str) -> Column:
    """An HTML link to a page of an encyclopedia at base."""
    return F.concat(F.lit(f'<a href="{quote(base, safe=":/")}'), F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit('">'), escaped_html(title), F.lit("</a>"))


def significant(x: Column, digits: int) -> Column:
    """x rounded to that many significant digits; 0 and null stay."""
    power = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), power)
    return F.when(x == 0, x).otherwise(F.round(x * scale) / scale)


def optional_number(s: Column) -> Column:
    """Empty is 0; a plain decimal its value; all else null."""
    return with_value(s, lambda x: F.when(x == "", F.lit(0.0)).when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double")))


def plain_number(x: Column) -> Column:
    """A number of few digits as text, without a trailing ".0"."""
    return F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")


def two_digits(x: Column) -> Column:
    """x to two significant digits, trailing zeros kept; with an exponent below 1e-6 and from 100 on."""
    r = significant(x, 2)
    power = F.floor(F.log10(F.abs(r))).cast("int")
    fixed = F.lit(None).cast("string")
    for e in range(-6, 2):
        fixed = F.when(power == e, F.format_string(f"%.{1 - e}f", r)).otherwise(fixed)
    tail = F.concat(F.format_string("%.1f", r / F.pow(F.lit(10.0), power)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))
    return F.when(x == 0, "0.0").otherwise(F.coalesce(fixed, tail))


def percent_influence(influence: Column, rank: Column) -> Column:
    """The quotient to two significant digits with a percent sign (it is not multiplied by 100); null for a rank of 0."""
    return F.concat(two_digits(F.try_divide(influence, rank)), F.lit("%"))


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0
