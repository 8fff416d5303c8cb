"""Atomic operators as column functions. Truth is 0 or 1; the undefined value is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth(c: Column) -> Column:
    return c.cast("long")


def plus(a, b):
    return a + b


def minus(a, b):
    return a - b


def times(a, b):
    return a * b


def divide(a: Column, b: Column) -> Column:
    """Real quotient; undefined for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def int_divide(a: Column, b: Column) -> Column:
    """Quotient truncated toward zero, exact on 64 bits; undefined for 0."""
    whole, by = a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long"))
    return ((whole - whole % by).cast("decimal(20,0)") / by.cast("decimal(20,0)")).cast("long")


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; undefined for 0."""
    return F.try_mod(a, b)


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def max_or(a, b):
    return F.greatest(a, b)


def min_and(a, b):
    return F.least(a, b)


def equal(a, b):
    return truth(a == b)


def less(a, b):
    return truth(a < b)


def more(a, b):
    return truth(a > b)


def match_scalar(a: Column, b: Column) -> Column:
    """Numbers match within 1e-8 + 1e-5 of the second's size."""
    return truth(F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b))


def negate(a):
    return -a


def floor(a: Column) -> Column:
    return F.floor(a).cast("long")


def reciprocal(a: Column) -> Column:
    return F.try_divide(F.lit(1.0), a.cast("double"))


def not_(a: Column) -> Column:
    return truth(a == 0)


def not_text(a: Column) -> Column:
    return truth(F.length(a) == 0)


def undefined(a: Column) -> Column:
    return truth(a.isNull())


def atom_list(a: Column) -> Column:
    """An empty list is an atom, any other is not."""
    return truth(F.size(a) == 0)


def char(n: Column) -> Column:
    """The character of a code point, over all of Unicode."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


def code_point(s: Column) -> Column:
    return F.ascii(s).cast("long")


def size_number(a: Column) -> Column:
    return F.abs(a)


def format_(a: Column, symbol: bool = False) -> Column:
    return F.concat(F.lit(":"), a.cast("string")) if symbol else a.cast("string")


def form_int(s: Column) -> Column:
    return s.try_cast("long")


def form_real(s: Column) -> Column:
    return s.try_cast("double")


def pad(s: Column, width: int) -> Column:
    """Pads to |width|, never cuts: on the right for positive widths, on the left for negative ones."""
    size = F.greatest(F.lit(abs(width)), F.length(s))
    return F.rpad(s, size, F.lit(" ")) if width >= 0 else F.lpad(s, size, F.lit(" "))


def fixed(x: Column, width: int, digits: int) -> Column:
    """A number with `digits` decimals, right-justified."""
    return pad(F.format_string(f"%.{digits}f", x), -width)


def conditional(*parts) -> Column:
    """conditional(c1, v1, c2, v2, ..., otherwise)"""
    out = F.when(parts[0], parts[1])
    for c, v in zip(parts[2:-1:2], parts[3:-1:2], strict=True):
        out = out.when(c, v)
    return out.otherwise(parts[-1])


# strings as lists of characters


def rotate_text(s: Column, n: int) -> Column:
    """+n brings the last n characters to the front, -n the first n to the back."""
    k = F.pmod(F.lit(n), F.greatest(F.length(s), F.lit(1)))
    return F.concat(F.right(s, k), F.left(s, F.length(s) - k))


def take_text(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n)) if n >= 0 else F.right(s, F.lit(-n))


def drop_text(s: Column, n: int) -> Column:
    return F.substring(s, n + 1, 1 << 30) if n >= 0 else F.left(s, F.greatest(F.length(s) + n, F.lit(0)))


def split_text(s: Column, n: int) -> Column:
    """Segments of n characters; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.ceil(F.length(s) / n).cast("int") - 1)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda g: F.substr(s, g * n + 1, F.lit(n))))


def overwrite_text(s: Column, new: str, at: int) -> Column:
    """Puts `new` at position `at`; the text grows where it is too short."""
    return F.overlay(F.rpad(s, F.greatest(F.length(s), F.lit(at)), F.lit(" ")), F.lit(new), F.lit(at + 1))


def find_text(s: Column, part: str) -> Column:
    """All positions of `part`, overlapping ones too."""
    n = len(part)
    places = F.sequence(F.lit(0), F.greatest(F.length(s) - n, F.lit(0)))
    return F.filter(places, lambda i: F.substr(s, i + 1, F.lit(n)) == F.lit(part)).cast("array<long>")


def unique_chars(s: Column) -> Column:
    """Distinct characters in order of appearance."""
    return F.array_join(F.array_distinct(F.split(s, "")), "")


def code_points(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
