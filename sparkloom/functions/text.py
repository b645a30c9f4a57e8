"""Text expressions with the meaning that source files and markdown ask for (FN-01..FN-14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column, chars: str = BLANKS) -> Column:
    """``c`` without any of ``chars`` at its ends; SQL's trim takes spaces only."""
    return F.btrim(c, F.lit(chars))


def strip_long(c: Column, chars: str = BLANKS) -> Column:
    """``strip`` for long texts: Spark's trim of an end lists the places of all characters, so texts that need none get none.

    ``c`` stands in it for each of ``chars``, so it should be a column or short.
    """
    blank = reduce(lambda a, b: a | b, [F.endswith(c, F.lit(x)) for x in chars])
    return F.when(blank, strip(c, chars)).otherwise(F.ltrim(c, F.lit(chars)))


def longer(c: Column, n: int) -> Column:
    """Whether a text has more than ``n`` code points; they are counted only where its bytes leave it open."""
    size = F.octet_length(c)
    return (size > n) & ((size > 4 * n) | (F.length(c) > n))


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, rounded down (PRJ-08)."""
    return F.floor(F.length(c) / 4).cast("int")


def title(c: Column) -> Column:
    """Every run of letters capitalised, wherever it starts (FN-05); initcap looks at white space only."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda x: F.initcap(x)), "")


def line_at(content: Column, start: Column) -> Column:
    """The line, from 1, of the character at ``start``, from 1 (EXT-14)."""
    return F.size(F.split(F.substring(content, F.lit(1), start - 1), "\n"))


def short_hash(c: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def unix_lines(c: Column) -> Column:
    """Line ends as a text reader gives them."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def shortened(c: Column, limit: int, tail: str) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(tail))).otherwise(c)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, even where inner lambdas use it."""
    return F.transform(F.array(value), body)[0]


#: Elements that a running sum copies at a time; appending to one long array would copy it each time.
_RUN = 64


def running(values: Column) -> Column:
    """For every element of an integer array the sum of those before it, without walks that grow with the square."""
    number = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)

    def sums(a: Column, start: Column) -> Column:
        zero = F.struct(start.alias("n"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, zero, lambda s, x: F.struct((s["n"] + x).alias("n"), F.array_append(s["out"], s["n"]).alias("out")), lambda s: s["out"])

    def of(v: Column) -> Column:
        groups = F.transform(F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int"))).otherwise(F.array().cast("array<int>")), lambda g: F.slice(v, g * _RUN + 1, F.lit(_RUN)))
        return let(groups, lambda gs: F.flatten(F.zip_with(gs, sums(F.transform(gs, number), F.lit(0)), sums)))

    return let(values, of)


def pieces(content: Column, pattern: str, mark: str = "") -> Column:
    """The text cut before every match: ``array<struct<start,line,before,text>>``, the part before the first included.

    ``start`` and ``line`` count from 1; ``before`` is the part before.  Matches are those that a
    left-to-right scan finds, not the places where a look-ahead holds.  ``mark`` stands in every match,
    so that a text without it need not be searched.
    """
    gaps, matches = F.split(content, pattern, -1), F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    cut = let(F.concat(F.array(F.lit("")), matches), lambda m: F.zip_with(m, gaps, lambda x, gap: F.concat(x, gap)))
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def placed(c: Column) -> Column:
        rows = F.arrays_zip(running(F.transform(c, F.length)).alias("start"), running(F.transform(c, lines)).alias("line"), F.concat(F.array(F.lit("")), c).alias("before"), c.alias("text"))
        return F.transform(F.slice(rows, F.lit(1), F.size(c)), lambda r: F.struct((r["start"] + 1).alias("start"), (r["line"] + 1).alias("line"), r["before"].alias("before"), r["text"].alias("text")))

    # most texts have no match, and need none of the copies that cutting and counting make
    found = F.contains(content, F.lit(mark)) & content.rlike(pattern) if mark else content.rlike(pattern)
    whole = F.array(F.struct(F.lit(1).alias("start"), F.lit(1).alias("line"), F.lit("").alias("before"), content.alias("text")))
    return F.when(found, let(cut, placed)).otherwise(F.when(content.isNotNull(), whole))
