"""Separators as evidence: which colon, dash or at-sign really divides a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .spans import find_all
from .text import bracket_depth, word_count


def colon_is_key(label: Column, like_rows: Column | int = 0) -> Column:
    """Whether a colon after this label divides it from a value: short labels do, longer ones only where at
    least two rows nearby are labelled alike."""
    s, rows = P.strip(label), like_rows if isinstance(like_rows, Column) else F.lit(like_rows)
    short = (word_count(s) <= 7) & (F.length(s) <= 50)
    return (F.length(s) > 0) & ~s.rlike(r"(?U)^\d{1,2}$") & (bracket_depth(s) == 0) & ~F.lower(s).rlike(r"^(http|www\.)") & (short | ((rows >= 2) & (F.length(s) <= 80)))


def dash_is_range(left: Column, right: Column) -> Column:
    return P.is_date(left) & P.is_date(right)


def split_on(text: Column, pattern: str) -> Column:
    """struct(left, right, left_start, left_end, right_start, right_end) at the first separator outside
    brackets; null without one or with an empty side."""
    first = F.get(F.filter(find_all(text, pattern), lambda m: bracket_depth(F.substring(text, F.lit(1), m["start"])) == 0), F.lit(0))
    raw_left, raw_right = F.left(text, first["start"]), F.substring(text, first["end"] + 1, F.length(text))
    left, right = P.strip(raw_left), P.strip(raw_right)
    a = F.length(raw_left) - F.length(F.regexp_replace(raw_left, r"(?U)^\s+", ""))
    b = first["end"] + F.length(raw_right) - F.length(F.regexp_replace(raw_right, r"(?U)^\s+", ""))
    return F.when(
        first.isNotNull() & (left != "") & (right != ""),
        F.struct(left.alias("left"), right.alias("right"), a.alias("left_start"), (a + F.length(left)).alias("left_end"), b.alias("right_start"), (b + F.length(right)).alias("right_end")),
    )


def at_split(text: Column) -> Column:
    return split_on(text, P.AT)


def dash_split(text: Column) -> Column:
    """A dash that divides fields, not dates."""
    s = split_on(text, P.SPACED_DASH)
    return F.when(s.isNotNull() & ~dash_is_range(s["left"], s["right"]), s)


def key_value(text: Column, bulleted: Column | None = None) -> Column:
    """struct(label, body, method) of a skills line: colon, then tab, then dash. A dash between dates never
    counts, and after a bullet the body must list things."""
    parts = lambda p: (F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2))
    made = lambda p, how: F.struct(P.strip(parts(p)[0]).alias("label"), P.strip(parts(p)[1]).alias("body"), F.lit(how).alias("method"))
    colon, tab, dash = made(P.KEY_COLON, "colon"), made(P.KEY_TAB, "tab"), made(P.KEY_DASH, "dash")
    lists = F.lit(True) if bulleted is None else ~bulleted | dash["body"].rlike("[,;]")
    return F.coalesce(
        F.when(text.rlike(P.KEY_COLON) & colon_is_key(parts(P.KEY_COLON)[0]), colon),
        F.when(text.rlike(P.KEY_TAB), tab),
        F.when(text.rlike(P.KEY_DASH) & ~dash_is_range(dash["label"], dash["body"]) & lists, dash),
    )
