"""Claims: spans of a line, each taken by the strongest evidence that asks for it.

A claim is (doc_id, line_index, kind, start, end, text, tier, seq, method). Tiers run 1 to 6, strongest
first; within one, seq is the order of asking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import complement, find_all
from ..functions.text import attribute_kind

TIERS = ("deterministic", "context", "ner", "semantic", "geometry", "unresolved")
# What in a method's name tells its tier.
TIER_MARKERS = {1: ("regex", "pattern", "delimiter", "marker", "annotation"), 2: ("context",), 3: ("ner", "distilbert"), 4: ("minilm", "semantic"), 5: ("geometry", "metadata"), 6: ("unclassified",)}
LINE = ["doc_id", "line_index"]


def tier_of(method: Column) -> Column:
    """The weakest tier that a method's name speaks of; 6 if none."""
    m = F.lower(method)
    named = [F.when(m.rlike("|".join(words)), tier).otherwise(0) for tier, words in TIER_MARKERS.items()]
    weakest = F.greatest(*named)
    return F.when(weakest > 0, weakest).otherwise(6)


def model_backed(method: Column) -> Column:
    """Whether a model had any part in it."""
    return F.lower(method).rlike("|".join(TIER_MARKERS[3] + TIER_MARKERS[4]))


def pattern_claims(lines: DataFrame, pattern: str, kind: str, tier: int = 1, method: str = "regex", order: int = 0) -> DataFrame:
    """One claim for each match in ``lines`` (doc_id, line_index, text); seq is (order, start)."""
    found = lines.where(F.col("text").rlike(pattern)).select(*LINE, F.explode(find_all(F.col("text"), pattern)).alias("m"))
    return found.select(*LINE, F.lit(kind).alias("kind"), "m.start", "m.end", "m.text", F.lit(tier).alias("tier"), (F.lit(order * 1_000_000) + F.col("m.start")).alias("seq"), F.lit(method).alias("method"))


def labelled_claims(lines: DataFrame, order: int = 0) -> DataFrame:
    """Claims of 'label: value' for the labels of a profile: the span covers both, the text is the value."""
    found = lines.where(F.col("text").rlike(P.LABELLED)).select(*LINE, F.explode(find_all(F.col("text"), P.LABELLED)).alias("m"))
    value = P.strip(F.regexp_extract("m.text", P.LABELLED, 2))
    label = F.regexp_extract("m.text", P.LABELLED, 1)
    out = found.select(*LINE, attribute_kind(label).alias("kind"), "m.start", "m.end", value.alias("text"), F.lit(1).alias("tier"), (F.lit(order * 1_000_000) + F.col("m.start")).alias("seq"), F.lit("regex_label").alias("method"))
    return out.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def unclaimed(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates that overlap no claim of their line: an equi-join on the line with the overlap as rest."""
    c, m = candidates.alias("c"), claims.select(*LINE, "start", "end").alias("m")
    same = [F.col(f"c.{k}") == F.col(f"m.{k}") for k in LINE]
    return c.join(m, [*same, F.col("c.start") < F.col("m.end"), F.col("m.start") < F.col("c.end")], "left_anti")


def resolve(claims: DataFrame) -> DataFrame:
    """The claims that stand: by tier and then order of asking, each unless it overlaps one that stands.

    A fold over each line's few claims, in one shuffle."""
    cols = ["tier", "seq", "start", "end", "kind", "text", "method"]
    packed = claims.groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda out, c: F.when(F.exists(out, lambda m: (c["start"] < m["end"]) & (m["start"] < c["end"])), out).otherwise(F.array_append(out, c)))
    return packed.select(*LINE, F.explode(kept).alias("k")).select(*LINE, *[f"k.{c}" for c in cols])


def other_claims(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """What no claim covers: maximal runs of a line, stripped, with a letter or digit."""
    spans = claims.groupBy(*LINE).agg(F.collect_list(F.struct("start", "end")).alias("s"))
    rest = lines.join(spans, LINE, "left").select(*LINE, "text", F.explode(complement(F.coalesce("s", F.expr("cast(array() as array<struct<start:int,end:int>>)")), F.length("text"))).alias("r"))
    raw = F.substring(F.col("text"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start"))
    lead = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
    out = rest.select(*LINE, F.lit("other").alias("kind"), (F.col("r.start") + lead).alias("start"), P.strip(raw).alias("text"))
    out = out.where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return out.select(*LINE, "kind", "start", (F.col("start") + F.length("text")).alias("end"), "text", F.lit(6).alias("tier"), F.col("start").alias("seq"), F.lit("unclassified").alias("method"))


def header_claims(lines: DataFrame) -> DataFrame:
    """Deterministic claims of a header, in order: labels, emails, phones, urls; then the rest as 'other'."""
    asked = labelled_claims(lines, 0).unionByName(pattern_claims(lines, P.EMAIL, "email", order=1)).unionByName(pattern_claims(lines, P.PHONE, "phone", order=2)).unionByName(pattern_claims(lines, P.URL, "url", order=3))
    return resolve(asked)


def date_spans(text: Column) -> Column:
    """Ranges, and years that no range covers, by start."""
    from ..functions.spans import without_overlaps

    ranges = find_all(text, P.DATE_RANGE)
    return F.array_sort(F.concat(ranges, without_overlaps(find_all(text, P.YEAR), ranges)))


def metadata_segments(text: Column, dates: Column | None = None) -> Column:
    """Segments of a metadata line: its dates are taken out, the rest is divided at separators."""
    dates = date_spans(text) if dates is None else dates
    rest = F.transform(complement(dates, F.length(text)), lambda r: F.substring(text, r["start"] + 1, r["end"] - r["start"]))
    parts = F.flatten(F.transform(rest, lambda x: F.split(x, P.METADATA_SEPARATOR)))
    trimmed = F.transform(parts, lambda x: F.btrim(x, F.lit(" \t,;:-–—()[]" + P.INVISIBLE)))
    return F.filter(trimmed, lambda x: x != "")
