"""Fields of the header from what models found in it, and the fallbacks where they found nothing.

``found`` holds a model's spans: (doc_id, line_index, kind, start, end, text, confidence) with kind name,
location or nationality; ``lines`` are the header's: (doc_id, line_index, text, size, bold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import find_all
from ..functions.text import mask, word_count
from .claims import LINE, unclaimed

EDGE = " \t,;:-​"


def masked_lines(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds masked, the text with its contacts blanked: no model sees a user name or part of a number."""
    spans = claims.where(F.col("kind").isin("email", "phone", "url")).groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    out = lines.join(spans, LINE, "left")
    return out.withColumn("masked", F.when(F.col("_s").isNull(), F.col("text")).otherwise(mask(F.col("text"), F.col("_s")))).drop("_s")


def trimmed_segments(text: Column) -> Column:
    """array<struct<start, end, text>> of a line's segments between bars and dots, without edge punctuation."""
    edge = F.lit(EDGE)

    def trim(m):
        left = F.ltrim(m["text"], edge)
        start = m["start"] + F.length(m["text"]) - F.length(left)
        whole = F.rtrim(left, edge)
        return F.struct(m["start"].alias("outer"), m["end"].alias("outer_end"), start.alias("start"), (start + F.length(whole)).alias("end"), whole.alias("text"))

    return F.transform(find_all(text, P.SEGMENT), trim)


def is_name_line(text: Column) -> Column:
    """A whole line that can be a person's name: a few words of letters."""
    t = P.strip(text)
    return word_count(t).between(1, 6) & (F.length(t) <= 80) & t.rlike(r"\p{L}") & ~t.rlike(r"(?U)[\d@|•·]")


def expanded(found: DataFrame, lines: DataFrame) -> DataFrame:
    """The found spans grown to what they name: a location or a nationality to its whole segment where that has
    the shape, a name to its line. A nationality stays only with a word that says so and off any location."""
    j = found.join(lines.select(*LINE, F.col("text").alias("line"), trimmed_segments(F.col("text")).alias("segments")), LINE)
    j = j.withColumn("seg", F.get(F.filter("segments", lambda s: (s["outer"] <= F.col("start")) & (F.col("end") <= s["outer_end"])), F.lit(0)))
    shaped = F.when(F.col("kind") == "location", F.col("seg.text").rlike(P.LOCATION)).when(F.col("kind") == "nationality", F.col("seg.text").rlike(P.NATIONALITY_CONTEXT)).otherwise(False)
    grow, whole = F.coalesce(shaped, F.lit(False)), (F.col("kind") == "name") & is_name_line(F.col("line"))
    lead = F.length("line") - F.length(F.regexp_replace("line", r"(?U)^\s+", ""))
    start = F.when(grow, F.col("seg.start")).when(whole, lead).otherwise(F.col("start"))
    end = F.when(grow, F.col("seg.end")).when(whole, lead + F.length(P.strip(F.col("line")))).otherwise(F.col("end"))
    j = j.withColumn("s", start).withColumn("e", end)
    out = j.select(*LINE, "kind", F.col("s").alias("start"), F.col("e").alias("end"), F.substring(F.col("line"), F.col("s") + 1, F.col("e") - F.col("s")).alias("text"), "confidence", "line")
    places = out.where("kind = 'location'").groupBy(*LINE).agg(F.collect_list(F.struct("start", "end")).alias("_p"))
    out = out.join(places, LINE, "left")
    clear = ~F.coalesce(F.exists("_p", lambda p: (p["start"] < F.col("end")) & (F.col("start") < p["end"])), F.lit(False))
    return out.where((F.col("kind") != "nationality") | (F.col("line").rlike(P.NATIONALITY_CONTEXT) & clear)).drop("_p", "line")


def best_name(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line_index, text): the name in the largest type, then the surest, then the first."""
    n = found.where("kind = 'name'").join(lines.select(*LINE, "size"), LINE)
    return n.groupBy("doc_id").agg(F.max_by(F.struct("line_index", "text"), F.struct("size", F.coalesce("confidence", F.lit(0.0)), -F.col("line_index"), -F.col("start"))).alias("b")).select("doc_id", "b.line_index", "b.text")


def best_location(found: DataFrame) -> DataFrame:
    """(doc_id, line_index, text): the location with the shape of one, then the first, then the surest."""
    n = found.where("kind = 'location'")
    rank = F.struct(F.col("text").rlike(P.LOCATION), -F.col("line_index"), F.coalesce("confidence", F.lit(0.0)), -F.col("start"))
    return n.groupBy("doc_id").agg(F.max_by(F.struct("line_index", "text"), rank).alias("b")).select("doc_id", "b.line_index", "b.text")


def fallback_name(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, line_index, text): of the first five header lines, unclaimed and of one to six words with a
    letter, the largest, then a bold one, then the first."""
    w = Window.partitionBy("doc_id").orderBy("line_index")
    first = lines.withColumn("_n", F.row_number().over(w)).where("_n <= 5").join(claims.select(*LINE).distinct(), LINE, "left_anti")
    fit = first.where(word_count(F.col("text")).between(1, 6) & F.col("text").rlike(r"\p{L}"))
    return fit.groupBy("doc_id").agg(F.max_by(F.struct("line_index", "text"), F.struct("size", "bold", -F.col("line_index"))).alias("b")).select("doc_id", "b.line_index", "b.text")


def _first_free(spans: DataFrame, claims: DataFrame | None) -> DataFrame:
    """(doc_id, line_index, text) of the first span of a document that overlaps no claim."""
    free = spans if claims is None else unclaimed(spans, claims)
    return free.groupBy("doc_id").agg(F.min(F.struct("line_index", "start", "text")).alias("b")).select("doc_id", "b.line_index", "b.text")


def fallback_location(lines: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_index, text): the first unclaimed segment with the shape 'X, Y', the first of its line."""
    shaped = F.get(F.filter(trimmed_segments(F.col("text")), lambda s: s["text"].rlike(P.LOCATION)), F.lit(0))
    s = lines.select(*LINE, shaped.alias("s")).where("s is not null")
    return _first_free(s.select(*LINE, "s.start", "s.end", "s.text"), claims)


def fallback_nationality(lines: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_index, text): the first unclaimed phrase that states one, the first of its line."""
    s = lines.where(F.col("text").rlike(P.NATIONALITY)).select(*LINE, F.get(find_all(F.col("text"), P.NATIONALITY), F.lit(0)).alias("m"))
    return _first_free(s.select(*LINE, "m.start", "m.end", "m.text"), claims)


def like_labels(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Adds like_rows: how many other labels of the group have about as many words (two more or less).

    A window over word counts, not a self-join; labels of the same text are taken out again."""
    words = word_count(F.col("label"))
    near = Window.partitionBy(*keys).orderBy("_w").rangeBetween(-2, 2)
    same = Window.partitionBy(*keys, "_l")
    full = labels.withColumn("_l", P.strip(F.col("label"))).withColumn("_w", words).where("_l != ''")
    return full.withColumn("like_rows", F.count("*").over(near) - F.count("*").over(same)).drop("_l", "_w")


def run_boxes(runs: DataFrame) -> DataFrame:
    """Adds x0 and x1 to a paragraph's runs (.., run_no, text, left, right): slices by their text lengths."""
    keys = ["doc_id", "line_no"]
    order = Window.partitionBy(*keys).orderBy("run_no")
    n = F.length("text")
    done, whole = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum(n).over(Window.partitionBy(*keys))
    at = lambda k: F.col("left") + (F.col("right") - F.col("left")) * k / F.greatest(whole, F.lit(1))
    return runs.withColumn("x0", at(done - n)).withColumn("x1", at(done))


def aligned_words(text: Column, words: Column) -> Column:
    """struct(start, end) of a link's words in their line: each is looked for after the one before; null if one is
    missing."""
    state = F.struct(F.lit(-1).alias("first"), F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def step(s, w):
        found = F.call_function("locate", F.lower(w), F.lower(text), s["at"] + 1)
        hit = s["ok"] & (found > 0)
        return F.struct(F.when(hit & (s["first"] < 0), found - 1).otherwise(s["first"]).alias("first"), F.when(hit, found - 1 + F.length(w)).otherwise(s["at"]).alias("at"), hit.alias("ok"))

    kept = F.filter(words, lambda w: F.trim(w) != "")
    return F.aggregate(kept, state, step, lambda s: F.when(s["ok"] & (s["first"] >= 0), F.struct(s["first"].alias("start"), s["at"].alias("end"))))
