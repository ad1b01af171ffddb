"""Records of sections: which lines open a record, which describe it, and which are its body.

Each builder is a fold over a section's lines in order, on columns that were computed beforehand: the state
is a few flags, so it stays inside the engine. Lines come as (doc_id, heading_no, line_index, page, text,
bbox, size, bold, ...); body lines become blocks by the same rule of gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.separators import at_split, key_value
from ..functions.spans import find_all
from .claims import date_spans, metadata_segments
from .layout import continues

KEY = ["doc_id", "heading_no"]
# Sections whose first short line is a title.
TITLED = ("projects", "certifications", "licenses", "volunteering", "awards", "publications", "references")


def line_evidence(lines: DataFrame) -> DataFrame:
    """Adds what the text alone tells: bullet, dates, at-sign halves, degree, institution, gpa, company."""
    t = F.col("text")
    # each step is a column of its own: composed, they would repeat one another many times over
    found = lines.withColumns({"_ranges": find_all(t, P.DATE_RANGE), "_gpa": find_all(t, P.GPA), "_dates": date_spans(t), "bullet": t.rlike(P.BULLET), "has_degree": t.rlike(P.DEGREE), "has_institution": t.rlike(P.INSTITUTION)})
    found = found.withColumn("_masked", T.mask(t, F.col("_ranges")))
    texts = lambda c: F.transform(c, lambda m: m["text"])
    out = found.withColumns({"ranges": texts("_ranges"), "dates": texts("_dates"), "gpa": texts("_gpa"), "at": at_split(F.col("_masked")), "segments": metadata_segments(t, F.col("_dates"))})
    return out.drop("_ranges", "_gpa", "_dates", "_masked")


def _fold(lines: DataFrame, item: Column, state: Column, step, keys: list[str] = KEY) -> DataFrame:
    """Runs ``step(state, line) -> state with .out`` over each key's lines; returns exploded out structs."""
    packed = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    return packed.select(*keys, F.explode(F.aggregate("all", state, step, lambda s: s["out"])).alias("o")).select(*keys, "o.*")


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def experience_roles(lines: DataFrame) -> DataFrame:
    """(doc_id, heading_no, line_index, record, role) with role bullet, metadata or body.

    ``lines`` has bullet, bold, has_range, primary (title, company or date evidence) and place (location
    evidence). A record's metadata ends with its first body line; after that only a bold or dated line can
    be metadata again, and if it has primary evidence it opens the next record.
    """
    out = "struct<line_index:int,record:int,role:string>"
    item = F.struct(F.col("line_index").cast("int").alias("line_index"), "bullet", "bold", "has_range", "primary", "place")
    state = F.struct(F.lit(-1).alias("record"), F.lit(False).alias("body"), _empty(out).alias("out"))

    def step(s, li):
        may = (s["record"] < 0) | ~s["body"] | li["bold"] | li["has_range"]
        primary = may & li["primary"]
        meta = ~li["bullet"] & (primary | (may & li["place"] & (s["record"] >= 0) & ~s["body"]))
        opens = (s["record"] < 0) | (meta & primary & s["body"])
        record = F.when(opens, s["record"] + 1).otherwise(s["record"])
        role = F.when(li["bullet"], "bullet").when(meta, "metadata").otherwise("body")
        return F.struct(record.alias("record"), F.when(meta, s["body"] & ~opens).otherwise(True).alias("body"), F.array_append(s["out"], F.struct(li["line_index"], record.alias("record"), role.alias("role"))).alias("out"))

    return _fold(lines, item, state, step)


def education_roles(rows: DataFrame) -> DataFrame:
    """(doc_id, heading_no, row, record, role) with role metadata, title_tail or body.

    ``rows`` has one line a visual row: explicit (a date range, gpa, degree or institution), shaped (and bold,
    divided or short), prose, titles, institutions, dates, other (places or gpa), short (one cell, few words).
    Evidence that the record has already, or primary evidence after its body began, opens the next one.
    """
    out = "struct<row:int,record:int,role:string>"
    item = F.struct(F.col("row").cast("int").alias("row"), "explicit", "prose", "titles", "institutions", "dates", "other", "short")
    state = F.struct(F.lit(-1).alias("record"), *[F.lit(False).alias(c) for c in ("body", "t", "i", "d")], _empty(out).alias("out"))

    def step(s, r):
        read = ~(r["prose"] | ((s["record"] >= 0) & s["body"] & ~r["explicit"]))
        t, i, d = (read & r[c] for c in ("titles", "institutions", "dates"))
        primary = t | i | d
        meta = primary | (read & r["other"])
        again = (s["record"] >= 0) & ((i & s["i"]) | (d & s["d"]) | (t & s["t"] & s["i"]))
        tail = ~meta & (s["record"] >= 0) & ~s["body"] & s["t"] & ~s["i"] & r["short"]
        opens = (meta & ((s["record"] < 0) | (primary & s["body"]) | again)) | (~meta & ~tail & (s["record"] < 0))
        record = F.when(opens, s["record"] + 1).otherwise(s["record"])
        role = F.when(meta, "metadata").when(tail, "title_tail").otherwise("body")
        keep = lambda c, x: F.when(opens, meta & x).otherwise(s[c] | (meta & x))
        body = F.when(meta | tail, s["body"] & ~opens).otherwise(True)
        return F.struct(record.alias("record"), body.alias("body"), keep("t", t).alias("t"), keep("i", i).alias("i"), keep("d", d).alias("d"), F.array_append(s["out"], F.struct(r["row"], record.alias("record"), role.alias("role"))).alias("out"))

    return _fold(rows, item, state, step)


def skill_groups(lines: DataFrame) -> DataFrame:
    """Adds group, label and body to skills lines: a label opens a group, so groups are a running count.

    ``lines`` has bullet, subheading, row_size, row_pos and left_label (the left cell of a row with content to
    its right is a label). In a line, 'label: body' opens a group; so does a lone line that ends in a colon or
    dash or is set like a subheading. Lines before any label form an unnamed group.
    """
    bare = F.when(F.col("bullet"), T.without_marker(F.col("text"))).otherwise(P.strip(F.col("text")))
    lines = lines.withColumn("_bare", bare)
    lines = lines.withColumn("_kv", key_value(F.col("_bare"), F.col("bullet")))
    kv, bare = F.col("_kv"), F.col("_bare")
    colon_end = F.col("text").rlike(r"(?U)[:\-–—]\s*$") & (T.word_count(F.col("text")) <= 7)
    alone = ~F.col("bullet") & (F.col("row_size") == 1) & (colon_end | F.col("subheading"))
    in_table = F.col("left_label")
    label = F.when(in_table & (F.col("row_pos") == 0), F.rtrim(P.strip(F.col("text")), F.lit(":-–— "))).when(in_table, None).otherwise(F.coalesce(kv["label"], F.when(alone, F.rtrim(P.strip(F.col("text")), F.lit(":-–— ")))))
    body = F.when(in_table, F.when(F.col("row_pos") > 0, F.col("text"))).otherwise(F.coalesce(kv["body"], F.when(~alone | F.col("bullet"), bare)))
    w = Window.partitionBy(*KEY).orderBy("line_index")
    out = lines.withColumn("label", label).withColumn("body", body).drop("_bare", "_kv")
    count = F.sum(F.col("label").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(F.col("label").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("group", (count - F.when(first, 1).otherwise(0)).cast("int"))


def grouped_roles(rows: DataFrame) -> DataFrame:
    """(doc_id, heading_no, row, record, titled) of rows of the minor sections.

    ``rows`` has title (a cell set like a title, or beside a date), may_open (a first short line of a titled
    section), dated, content (something besides title and dates), near (close below the row before) and
    page. Title cells open a record unless they go on with one that holds titles only, close above.
    """
    out = "struct<row:int,record:int,titled:boolean>"
    item = F.struct(F.col("row").cast("int").alias("row"), "title", "may_open", "dated", "content", "near")
    state = F.struct(F.lit(-1).alias("record"), F.lit(False).alias("bare"), _empty(out).alias("out"))

    def step(s, r):
        titled = r["title"] | (r["may_open"] & (s["record"] < 0))
        goes_on = (s["record"] >= 0) & s["bare"] & r["near"]
        opens = (titled & ~goes_on) | (~titled & (s["record"] < 0) & (r["dated"] | r["content"]))
        record = F.when(opens, s["record"] + 1).otherwise(s["record"])
        bare = F.when(titled, F.when(opens, True).otherwise(s["bare"])).otherwise(s["bare"] & ~opens) & ~r["dated"] & ~r["content"]
        return F.struct(record.alias("record"), bare.alias("bare"), F.array_append(s["out"], F.struct(r["row"], record.alias("record"), titled.alias("titled"))).alias("out"))

    return _fold(rows, item, state, step)


def residual_text(text: Column, spans: Column) -> Column:
    """What is left of a line without its dates; empty if that is only brackets and separators."""
    rest = F.aggregate(F.reverse(spans), text, lambda t, s: F.concat(F.left(t, s["start"]), F.substring(t, s["end"] + 1, F.length(t))))
    return F.when(F.btrim(rest, F.lit(" ()[]{}|,;:-–—")) == "", "").otherwise(rest)


def content_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, kind, text, page): body lines folded into bullets, subheadings and paragraphs.

    ``lines`` has bullet, subheading, paragraph_gap and line_height. A plain line continues the bullet or
    paragraph above on its page if the gap (or an open bracket) allows and the two share some width.
    """
    block = "struct<kind:string,text:string,page:int,x0:double,x1:double,y1:double>"
    bare = F.when(F.col("bullet"), T.without_marker(F.col("text"))).otherwise(F.col("text"))
    kind = F.when(F.col("bullet"), "bullet").when(F.col("subheading"), "subheading").otherwise("paragraph")
    item = F.struct("line_index", kind.alias("kind"), bare.alias("text"), F.col("page").cast("int").alias("page"), F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"))
    packed = lines.where(~F.col("bullet") | (bare != "")).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"), F.max("paragraph_gap").alias("pg"), F.max("line_height").alias("lh"))

    def step(out, li):
        last = F.element_at(out, -1)
        on = (F.size(out) > 0) & (li["kind"] == "paragraph") & (last["kind"] != "subheading") & (last["page"] == li["page"]) & continues(li["y0"] - last["y1"], F.col("pg"), F.col("lh"), last["text"]) & (F.least(last["x1"], li["x1"]) > F.greatest(last["x0"], li["x0"]))
        place = [li[c].alias(c) for c in ("page", "x0", "x1", "y1")]
        grown = F.struct(last["kind"].alias("kind"), F.concat(last["text"], F.lit("\n"), li["text"]).alias("text"), *place)
        fresh = F.struct(li["kind"].alias("kind"), li["text"].alias("text"), *place)
        return F.when(F.coalesce(on, F.lit(False)), F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), grown)).otherwise(F.array_append(out, fresh))

    blocks = packed.select(*keys, F.posexplode(F.aggregate("all", _empty(block), step)).alias("block", "b"))
    return blocks.select(*keys, "block", "b.kind", "b.text", "b.page")


def reconcile_segments(evidence: DataFrame) -> DataFrame:
    """Adds role to the segments of an experience line.

    ``evidence`` has doc_id, line_index, seg, text, title (accepted), confidence, org, loc (found by a model),
    marker (a company's), link (an external url). In order: the surest title that isn't a company; both a
    company and, after a comma, its place; a company; a place; another title; nothing.
    """
    w = Window.partitionBy("doc_id", "line_index")
    many = F.count("*").over(w) > 1
    others = F.sum(F.col("title").cast("int")).over(w) - F.col("title").cast("int")
    company = F.col("marker") | (many & F.col("link")) | (many & F.col("org") & (others > 0))
    e = evidence.withColumn("company", company)
    # the surest title as a greatest value: a rank would sort each line's segments once more
    able = F.coalesce(F.col("title") & ~F.col("company"), F.lit(False))
    surest = F.struct("confidence", (-F.col("seg")).alias("seg"))
    e = e.withColumn("_best", F.max(F.when(able, surest)).over(w))
    e = e.withColumn("primary", able & surest.eqNullSafe(F.col("_best"))).withColumn("has_primary", F.col("_best").isNotNull())
    comma = F.col("text").contains(",")
    role = (
        F.when(F.col("primary"), "job_title")
        .when(F.col("org") & F.col("loc") & comma, "company_location")
        .when(F.col("company") | (F.col("org") & (~F.col("title") | F.col("has_primary"))), "company")
        .when(F.col("loc") & comma, "location")
        .when(F.col("title"), "job_title")
        .otherwise("unresolved")
    )
    return e.withColumn("role", role).drop("company", "primary", "has_primary", "_best")


def segment_urls(segments: DataFrame, urls: DataFrame) -> DataFrame:
    """(doc_id, line_index, seg, url_no): urls of a line whose text holds the segment or is held by it, or whose
    box covers half of the smaller box. An OR of conditions on one line: an equi-join with the rest as filter."""
    from ..functions.geometry import overlap_ratio

    fold = lambda c: F.lower(F.btrim(F.regexp_replace(F.translate(c, "​﻿", ""), r"(?U)\s+", " "), F.lit(" |•·-–—")))
    s = segments.select("doc_id", "line_index", "seg", fold(F.col("text")).alias("a"), F.col("bbox").alias("sb"))
    u = urls.select("doc_id", "line_index", "url_no", fold(F.col("text")).alias("b"), F.col("bbox").alias("ub"))
    near = (F.col("a") != "") & (F.col("b") != "") & (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")))
    return s.join(u, ["doc_id", "line_index"]).where(near | (F.col("sb").isNotNull() & F.col("ub").isNotNull() & (overlap_ratio(F.col("sb"), F.col("ub")) >= 0.5))).select("doc_id", "line_index", "seg", "url_no")


def education_fields(lines: DataFrame) -> DataFrame:
    """(doc_id, line_index, field, text): titles, institutions, dates and gpa of a line's segments."""
    t = F.col("text")
    lines = lines.where(~t.rlike(P.BULLET)).select("doc_id", "line_index", "text", find_all(t, P.GPA).alias("_gpa")).withColumn("_masked", T.mask(t, F.col("_gpa")))
    lines = lines.withColumn("_dates", date_spans(F.col("_masked")))
    parts = lines.select("doc_id", "line_index", F.posexplode(metadata_segments(F.col("_masked"), F.col("_dates"))).alias("n", "text"))
    x = F.col("text")
    titles = parts.where(x.rlike(P.DEGREE)).select("doc_id", "line_index", F.lit("title").alias("field"), "text")
    institutions = parts.where(x.rlike(P.INSTITUTION)).select("doc_id", "line_index", F.lit("institution").alias("field"), "text")
    dates = lines.select("doc_id", "line_index", F.lit("date").alias("field"), F.explode(F.transform("_dates", lambda m: m["text"])).alias("text"))
    grades = lines.select("doc_id", "line_index", F.lit("gpa").alias("field"), F.explode(F.transform("_gpa", lambda m: m["text"])).alias("text"))
    return titles.unionByName(institutions).unionByName(dates).unionByName(grades)


def first_of_type(sections: DataFrame) -> DataFrame:
    """The first section of each type, and every one of 'others'."""
    w = Window.partitionBy("doc_id", "section_type").orderBy("heading_no")
    return sections.withColumn("r", F.row_number().over(w)).where("r = 1 or section_type = 'others'").drop("r")
