"""Column functions on text: white space, cleaning, chunk windows, ids, numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str methods see it; Java's \\s is ASCII only.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[^\s\x1c-\x1f\x85\p{Z}]+"
#: A float literal of Python: underscores between digits, no type suffix.
_DIGITS = r"\d+(?:_\d+)*"
FLOAT = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def clean(c: Column) -> Column:
    """White space, then double quotes, then single quotes, then white space, off both ends."""
    for mark in (SPACE, '"', "'", SPACE):
        c = F.regexp_replace(c, rf"\A(?:{mark})+|(?:{mark})+\z", "")
    return c


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row: a lambda over a larger array
    would otherwise work it out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(c: Column) -> Column:
    """How many words `words` finds, without the array of them."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def window_count(n: Column, size: int = 512, overlap: int = 64) -> Column:
    """How many windows n words make."""
    last = F.ceil(F.greatest(n - size, F.lit(0)) / max(1, size - overlap)).cast("int")
    return F.when(n > 0, last + 1).otherwise(0)


def windows(ws: Column, size: int = 512, overlap: int = 64) -> Column:
    """Overlapping windows of a word array, each joined by single spaces; the last
    is the first that reaches the end. An empty array has none."""
    step = max(1, size - overlap)

    def cut(w: Column) -> Column:
        n = window_count(F.size(w), size, overlap)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))

    return bound(ws, cut)


def generated_id(source: Column, title: Column, number: Column) -> Column:
    digest = F.substring(F.md5(F.concat(source, F.lit("::"), title).cast("binary")), 1, 8)
    return F.concat_ws("_", source, digest, number.cast("string"))


def to_float(c: Column, default: float = 1.0) -> Column:
    """As Python reads a float literal; anything else is the default."""
    text = strip(c)
    word = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    sign = F.when(F.startswith(text, F.lit("-")), -1.0).otherwise(1.0)
    number = F.regexp_replace(text, "_", "").try_cast("double")
    plain = F.regexp_like(c, F.lit(r"\A[0-9]{1,15}\z"))  # most are; they need one look instead of six
    out = F.when(plain, c.try_cast("double")).when(F.regexp_like(text, F.lit(FLOAT)), number)
    out = out.when(word.isin("inf", "infinity"), sign * F.lit(float("inf"))).when(word == "nan", F.lit(float("nan")))
    return F.coalesce(out, F.lit(default))


def hashed_uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) from an md5 of the parts: the same in any partitioning,
    attempt or engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
