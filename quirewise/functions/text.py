"""Cleaning and text scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

# Labels of the profile's fields, lower case, spaces single.
ATTRIBUTE_LABELS = {
    "date_of_birth": ("date of birth", "birth date", "dob", "d.o.b", "d.o.b."),
    "age": ("age", "current age"),
    "gender": ("gender", "sex"),
    "marital_status": ("marital status", "martial status", "civil status", "marital"),
    "visa_status": ("visa", "visa status", "visa type", "work visa", "immigration status", "residency visa", "work authorization", "right to work"),
    "nationality": ("nationality", "citizenship", "citizenship status"),
    "current_income": ("current salary", "present salary", "current income", "current pay", "monthly salary", "monthly income", "last drawn salary", "salary", "income"),
    "current_package": ("current package", "annual package", "total package", "compensation package", "total compensation", "current ctc", "ctc", "package"),
}
_EDGE = " \t,;:-–—" + P.INVISIBLE


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often and in whatever branches f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def without_invisibles(text: Column) -> Column:
    return F.translate(text, P.INVISIBLE, "")


def is_blank(text: Column) -> Column:
    """Nothing but white space and characters that render as nothing."""
    return F.length(F.translate(text, P.BLANK, "")) == 0


def clean(text: Column) -> Column:
    """The output's cleaning: two invisible characters go, then white space at the ends."""
    return P.strip(F.translate(text, "​﻿", ""))


def heading_text(text: Column) -> Column:
    """A heading without its number and invisible characters, never emptied by that."""
    bare = P.strip(without_invisibles(text))
    return F.coalesce(F.nullif(F.regexp_replace(bare, P.ORDINAL, ""), F.lit("")), bare)


def furniture_key(text: Column) -> Column:
    """Page headers and footers that differ in numbers or spacing share a key."""
    return P.strip(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)\d+", "#"))


def attribute_kind(label: Column) -> Column:
    """The profile field that a label names; any other label counts as current_residence."""
    folded = F.lower(P.strip(F.regexp_replace(label, r"(?U)\s+", " ")))
    kind = F.lit("current_residence")
    for name, labels in ATTRIBUTE_LABELS.items():
        kind = F.when(folded.isin(*labels), name).otherwise(kind)
    return kind


def bracket_depth(text: Column) -> Column:
    """Round and square brackets still open at the end; a closing one too many counts for nothing."""
    marks = F.split(F.regexp_replace(text, r"[^()\[\]]", ""), "")
    return F.aggregate(marks, F.lit(0), lambda d, c: F.when(c.isin("(", "["), d + 1).when(c.isin(")", "]"), F.greatest(d - 1, F.lit(0))).otherwise(d))


def trim_brackets(text: Column, rounds: int = 6) -> Column:
    """Drops brackets at the ends whose partner is missing, and punctuation beside them."""
    strip = lambda c: F.btrim(c, F.lit(_EDGE))
    state = strip(text)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        state,
        lambda s, _: strip(F.when(s.rlike(r"^[)\]]"), F.substring(s, 2, 1 << 30)).when(s.rlike(r"[(\[]$") & (bracket_depth(s) > 0), F.left(s, F.length(s) - 1)).otherwise(s)),
    )


def rounded(x: Column, places: int = 2) -> Column:
    """Half to even."""
    return F.bround(x, places)


def human_size(n: Column) -> Column:
    """Bytes as a label in decimal units."""
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1_000_000, F.concat(F.bround(n / 1000, 0).cast("long").cast("string"), F.lit(" kB"))).when(n < 1_000_000_000, F.concat(F.bround(n / 1_000_000, 0).cast("long").cast("string"), F.lit(" MB"))).otherwise(F.concat(F.format_number(n / 1_000_000_000, 1), F.lit(" GB")))


def stages(spec: Column) -> Column:
    """'1-3,5' as its sorted numbers; null for an empty part, a number outside 1 to 5 or a range that runs backwards."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    fine = F.forall(parts, lambda p: p.rlike("^[1-5]$") | (p.rlike("^[1-5]-[1-5]$") & (F.substring(p, 1, 1) <= F.substring(p, 3, 1))))
    numbers = F.flatten(F.transform(parts, lambda p: F.sequence(F.substring(p, 1, 1).cast("int"), F.substring(p, -1, 1).cast("int"))))
    return F.when(fine, F.array_sort(F.array_distinct(numbers)))


def mask(text: Column, spans: Column) -> Column:
    """Blanks the (start, end) spans with spaces; offsets of the rest hold."""
    return F.aggregate(spans, text, lambda t, s: F.overlay(t, F.repeat(F.lit(" "), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))


def outside(text: Column, spans: Column) -> Column:
    return P.strip(F.regexp_replace(mask(text, spans), r"(?U)\s+", " "))


def trimmed_label(text: Column, start: Column) -> Column:
    """struct(text, start, end): a span without separators at its ends, offsets narrowed."""
    edge = F.lit(" \t|,;:•·-–—()")
    left = F.ltrim(text, edge)
    whole = F.rtrim(left, edge)
    at = start + F.length(text) - F.length(left)
    return F.struct(whole.alias("text"), at.alias("start"), (at + F.length(whole)).alias("end"))


def without_marker(text: Column) -> Column:
    return P.strip(F.regexp_replace(P.strip(text), P.BULLET, ""))


def joined(values: Column, sep: str = " · ") -> Column:
    """Non-blank values, joined."""
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), sep)


def upper_ratio(text: Column) -> Column:
    """Upper-case letters over letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(F.lit(0.0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def meaningful(text: Column) -> Column:
    """Letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
