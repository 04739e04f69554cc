"""Column expressions on raw log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for trimming.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def without_line_end(c: Column) -> Column:
    return F.rtrim(c, F.lit("\r\n"))


def is_ipv4_shaped(c: Column) -> Column:
    """Four groups of one to three digits; their values are not looked at."""
    return c.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & ~c.endswith("\n")


def is_ipv4(c: Column) -> Column:
    """Four octets up to 255 without leading zeros."""
    return c.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$") & ~c.endswith("\n")


def is_ip(c: Column) -> Column:
    """An IPv4 address, or text that has the form of an IPv6 one."""
    return is_ipv4(c) | (c.contains(":") & c.rlike(r"^[0-9A-Fa-f:.]{2,45}$"))


def integer(c: Column) -> Column:
    """A signed decimal integer as long; anything else, or one that doesn't fit, is 0."""
    return F.coalesce(F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long")), F.lit(0).cast("long"))


def found(keys: Column, values: Column, key: str) -> Column:
    """The value beside the first key of that name; '' if there is none."""
    return F.coalesce(F.get(values, (F.array_position(keys, key) - 1).cast("int")), F.lit(""))


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def has_any(c: Column, *parts: str) -> Column:
    out = c.contains(parts[0])
    for p in parts[1:]:
        out = out | c.contains(p)
    return out


def choose(pairs: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def mapped(c: Column, table: dict, otherwise: object) -> Column:
    """A value looked up in a small constant table."""
    flat = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(flat, c), otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def entries(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is not empty."""
    flat = [x for k, v in pairs for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull() & (v != ""))
