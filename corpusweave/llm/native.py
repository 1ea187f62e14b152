"""Helpers for operators that stay inside DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\u000b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body refers to it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def chars_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among `chars`."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def running(values: Column, join: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each value of an array, what `join` (associative) makes of `start` and all values before
    it. Arrays are built in steps of the square root of their length, so nobody copies the square."""

    def part(xs: Column) -> Column:
        """struct(last, before) of a short array."""
        step = lambda acc, x: F.struct(join(acc["last"], x).alias("last"), F.concat(acc["before"], F.array(acc["last"])).alias("before"))
        return F.aggregate(xs, F.struct(start.alias("last"), F.slice(F.array(start), 1, 0).alias("before")), step)

    def of(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1), lambda k: part(F.slice(xs, k * width + 1, width)))
        joined = let(parts, lambda ps: let(part(F.transform(ps, lambda p: p["last"])), lambda heads: F.flatten(F.transform(ps, lambda p, k: F.transform(p["before"], lambda b: join(F.get(heads["before"], k), b))))))
        return F.when(F.size(xs) > 0, joined).otherwise(F.slice(F.array(start), 1, 0))

    return let(values, of)


PIECE = 4096


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters, in which places are found fast."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The characters from start to before end of a text that pieces() has cut."""
    some = F.transform(
        F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")),
        lambda k: F.substring(F.get(parts, k), F.greatest(start - k * PIECE, F.lit(0)) + 1, F.least(end - k * PIECE, F.lit(PIECE)) - F.greatest(start - k * PIECE, F.lit(0))),
    )
    return F.when(end > start, F.array_join(some, "")).otherwise("")
