"""All matches of a pattern with their offsets, without leaving the JVM.

``split`` gives the text between matches and ``regexp_extract_all`` the matches; sums of their lengths are
the offsets. Lines are short, so summing what stands before each match is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>>, in code points, end exclusive; empty without matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"))

    def step(s, pair):
        start = s["at"] + F.length(pair["between"])
        end = start + F.length(pair["found"])
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("text"))).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("between"), m.alias("found")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, state, step, lambda s: s["out"])).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)"))


def without_overlaps(candidates: Column, claimed: Column) -> Column:
    """The candidates that share no character with a claimed span."""
    return F.filter(candidates, lambda c: ~F.exists(claimed, lambda m: (c["start"] < m["end"]) & (m["start"] < c["end"])))


def complement(spans: Column, length: Column) -> Column:
    """The (start, end) runs of 0..length that no span covers."""
    gap = "struct<start:int,end:int>"
    state = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{gap}>)").alias("out"))

    def step(s, x):
        grown = F.when(x["start"] > s["at"], F.array_append(s["out"], F.struct(s["at"].alias("start"), x["start"].cast("int").alias("end")))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"].cast("int")).alias("at"), grown.alias("out"))

    def last(s):
        return F.when(length > s["at"], F.array_append(s["out"], F.struct(s["at"].alias("start"), length.cast("int").alias("end")))).otherwise(s["out"])

    return F.aggregate(F.array_sort(spans), state, step, last)
