"""Coordinates from templates and infobox fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions.text import optional_number, trimmed, with_value

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def decimal_degrees(lat: tuple[Column, Column, Column, Column], long: tuple[Column, Column, Column, Column], strict: bool = False) -> Column:
    """(lat, long) from degrees, minutes, seconds and hemisphere as text: empty parts are 0, S and W turn the sign, minutes are added to
    degrees whatever their sign; null where a part is no number or both degrees are empty. With strict, as the first programs had it, parts
    that are no numbers are 0 and only bad seconds of the longitude give null."""
    zero = F.lit(0.0)

    def one(parts: tuple[Column, ...], negative: str) -> Column:
        d, m, s = (optional_number(trimmed(p)) for p in parts[:3])
        if strict:
            d, m, s = F.coalesce(d, zero), F.coalesce(m, zero), F.coalesce(s, zero) if negative == "S" else s
        return with_value(d + m / 60 + s / 3600, lambda value: F.when(parts[3].startswith(negative), -value).otherwise(value))

    def both(x: Column) -> Column:
        ok = x["lat"].isNotNull() & x["long"].isNotNull() & (F.lit(strict) | ~((trimmed(lat[0]) == "") & (trimmed(long[0]) == "")))
        return F.when(ok, x)

    return with_value(F.struct(one(lat, "S").alias("lat"), one(long, "W").alias("long")), both)


def from_template(template: Column, strict: bool = False) -> Column:
    """(lat, long) from the parameters of {{coord|...}}: 2, 4, 6 or 8 of them from the first number on, up to the first that is neither
    a number nor exactly N, E, S or W; null for other counts."""

    def is_number(p: Column) -> Column:
        return p.rlike(NUMBER)

    def used(parts: Column) -> Column:
        start = F.array_position(F.transform(parts, is_number), True).cast("int")

        def run(rest: Column) -> Column:
            end = F.array_position(F.transform(rest, lambda p: ~(is_number(p) | p.isin("N", "E", "S", "W"))), True).cast("int")
            return F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest)

        return with_value(F.when(start > 0, F.slice(parts, F.greatest(start, F.lit(1)), F.size(parts))), run)

    def read(x: Column) -> Column:
        e, n = F.lit(""), F.size(x)
        at = lambda *ks: tuple(e if k is None else F.get(x, F.lit(k)) for k in ks)
        # which of the parameters are degrees, minutes, seconds and hemisphere, by their number
        places = {2: ((0, None, None, None), (1, None, None, None)), 4: ((0, None, None, 1), (2, None, None, 3)), 6: ((0, 1, None, 2), (3, 4, None, 5)), 8: ((0, 1, 2, 3), (4, 5, 6, 7))}
        out = F.lit(None)
        for count, (lat, long) in places.items():
            out = F.when(n == count, decimal_degrees(at(*lat), at(*long), strict)).otherwise(out)
        return out

    return with_value(with_value(F.transform(F.split(template, r"\|"), trimmed), used), read)


#: Patterns of coordinate templates, and the infobox fields of each part.
COORD, PARAMETERS = r"(?id)\{\{coord(.*?)\}\}", r"(?id)\{\{(?:coords?|coor d?m?s?2?) *[|](.*)?\}\}"
TEMPLATE_FIELDS = ("coordinates", "coord", "coordinate")
FIELDS = {
    "lat": (("latd", "lat_d", "lat_degrees", "latdegrees"), ("latm", "lat_m", "lat_minutes", "latminutes"), ("lats", "lat_s", "lat_seconds", "latseconds"), ("latNS", "lat_NS", "lat_direction", "latdirection")),
    "long": (("longd", "long_d", "long_degrees", "longdegrees"), ("longm", "long_m", "long_minutes", "longminutes"), ("longs", "long_s", "long_seconds", "longseconds"), ("longEW", "long_EW", "long_direction", "longdirection")),
}


def from_text(text: Column, strict: bool = False) -> Column:
    """(lat, long) of the first coord template, which must say title and no LAT."""
    first = F.regexp_extract(text, COORD, 0)
    return F.when(first.contains("title") & ~first.contains("LAT"), from_template(F.regexp_extract(first, PARAMETERS, 1), strict))


def from_infobox(attributes: Column) -> Column:
    """(lat, long) of an infobox: of its coordinates template, or of its degree fields, which must both be there."""
    field = lambda keys: F.coalesce(*[attributes[k] for k in keys], F.lit(""))
    template = from_template(F.regexp_extract(field(TEMPLATE_FIELDS), PARAMETERS, 1))
    return F.coalesce(template, from_fields([field(x) for side in ("lat", "long") for x in FIELDS[side]]))


def from_fields(fields: list[Column], strict: bool = False) -> Column:
    """(lat, long) of the four fields of the latitude and the four of the longitude; both must have degrees."""
    at = lambda x, *ks: tuple(F.get(x, F.lit(k)) for k in ks)
    return with_value(F.array(*fields), lambda x: F.when((F.get(x, F.lit(0)) != "") & (F.get(x, F.lit(4)) != ""), decimal_degrees(at(x, 0, 1, 2, 3), at(x, 4, 5, 6, 7), strict)))


def coordinate(text: Column, attributes: Column, infobox_first: bool = False) -> Column:
    both = [from_text(text), from_infobox(attributes)]
    return F.coalesce(*(reversed(both) if infobox_first else both))


def raw_field(text: Column, names: tuple[str, ...]) -> Column:
    """The trimmed rest, up to a bar, of the first "| name = " in raw page text, of any of the names in either case; empty without. There
    must be a space behind the equals sign."""
    return trimmed(F.regexp_extract(text, rf"(?i)[|] *(?:{'|'.join(names)}) *= ([^|]*)", 1))


def from_raw_infobox(text: Column, strict: bool = False) -> Column:
    """(lat, long) by patterns over raw page text: of the first coordinates template that a field holds, or else of the degree fields, which
    must both be there."""
    template = F.regexp_extract(text, rf"(?id)[|] *(?:{'|'.join(TEMPLATE_FIELDS)}) *= *(\{{\{{.*?\}}\}})", 1)
    fields = [raw_field(text, x) for side in ("lat", "long") for x in FIELDS[side]]
    return F.coalesce(from_template(F.regexp_extract(template, PARAMETERS, 1), strict), from_fields(fields, strict))


def coordinate_raw(text: Column, strict: bool = False) -> Column:
    """(lat, long) as the legacy pipeline takes them: the infobox's by patterns, then the text's."""
    return F.coalesce(from_raw_infobox(text, strict), from_text(text, strict))
