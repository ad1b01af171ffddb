"""Lines to records: the whole extraction as one plan.

Everything is keyed by document, so Spark partitions by doc_id once and keeps to it. Models are optional:
without headings from one, section names are recognised word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import claims, header, layout, sections, stats, structure
from . import output
from .stage import staged


def exact_headings(lines: DataFrame) -> DataFrame:
    """Headings whose text is a section's name, or several of them."""
    h = T.heading_text(F.col("text"))
    found = lines.withColumn("section_type", structure.exact_section(h))
    return structure.heading_candidates(lines).select("doc_id", "line_index").join(found, ["doc_id", "line_index"]).where("section_type is not null").select("doc_id", "line_index", "section_type", F.lit(1.0).alias("similarity"), F.lit(0.0).alias("runner_up"))


def header_lines(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """Page 1 above the first section, or its first lines where there is none."""
    at = structure.header_boundary(lines, headings)
    top = at.join(lines.select("doc_id", F.col("line_index").alias("boundary"), F.col("bbox.y0").alias("_top")), ["doc_id", "boundary"]).select("doc_id", "_top")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_index"))
    first = lines.where("page = 1").join(top, "doc_id", "left").withColumn("_r", rank)
    return first.where(F.when(F.col("_top").isNotNull(), F.col("bbox.y0") < F.col("_top")).otherwise(F.col("_r") <= P.HEADER_LINES)).drop("_top", "_r")


def contact_profile(lines: DataFrame) -> DataFrame:
    """The deterministic part of a header profile."""
    return output.header_profile(claims.header_claims(lines.select("doc_id", "line_index", "text")))


def header_profile(top: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, header_profile) of header lines: what the text says itself, then what models ``found`` (see
    operators.header), then guesses by place and shape for a name, location or nationality still missing."""
    spans = ["doc_id", "line_index", "kind", "start", "end", "text"]
    taken = staged(claims.header_claims(top.select("doc_id", "line_index", "text")).select(*spans), "claims")
    at = lambda df, kind: df.select("doc_id", "line_index", F.lit(kind).alias("kind"), F.lit(0).alias("start"), F.length("text").alias("end"), "text")
    if found is not None:
        free = claims.unclaimed(header.expanded(found, top), taken)
        picked = at(header.best_name(free, top), "name").unionByName(at(header.best_location(free), "location")).unionByName(free.where("kind = 'nationality'").select(*spans))
        taken = staged(taken.unionByName(picked), "claims")
    for kind, guess in (("name", header.fallback_name(top, taken)), ("location", header.fallback_location(top, taken)), ("nationality", header.fallback_nationality(top, taken))):
        known = taken.where(F.col("kind") == kind).select("doc_id").distinct()
        taken = taken.unionByName(at(guess.join(known, "doc_id", "left_anti"), kind))
    return output.header_profile(taken)


def body_lines(lines: DataFrame, routed: DataFrame, widths: DataFrame) -> DataFrame:
    """Lines below their section's heading, with level, body style and subheading."""
    levels = staged(stats.indentation_levels(lines, widths), "levels")
    under = staged(structure.levels_of(structure.section_lines(lines, routed), levels, widths), "under")
    styled = under.join(structure.body_style(under), ["doc_id", "heading_no"])
    named = lines.select("doc_id", F.col("line_index").alias("heading_line"), F.col("text").alias("heading_text"))
    return styled.withColumn("subheading", structure.looks_like_subheading()).join(named, ["doc_id", "heading_line"])


def grouped_sections(body: DataFrame) -> DataFrame:
    """(doc_id, logical_type, entries) of the minor sections: records of titles, dates, paragraphs and bullets."""
    lines = structure.logical_sections(body)
    ev = sections.line_evidence(lines.where(F.col("logical_type").isin(*output.MINOR))).withColumn("heading_no", F.col("heading_no"))
    dates = F.size("dates") > 0
    ev = ev.withColumn("_dates", claims.date_spans(F.col("text")))
    ev = ev.withColumn("_left", sections.residual_text(F.col("text"), F.col("_dates")))
    left = F.col("_left")
    rows = ev.withColumn("row", F.col("line_index")).withColumns({"title": F.col("subheading") & ~F.col("bullet") & ~(dates & (left == "")), "dated": dates, "near": F.lit(False), "content": ~F.col("subheading") & (left != "")})
    rows = rows.withColumn("may_open", F.col("logical_type").isin(*sections.TITLED) & ~F.col("bullet") & (T.word_count(F.col("text")) <= P.SUBHEADING_WORDS) & ~P.strip(F.col("text")).rlike("[.;:]$"))
    roles = sections.grouped_roles(rows)
    full = rows.join(roles.withColumnRenamed("row", "line_index"), ["doc_id", "heading_no", "line_index"])
    of = lambda c, p: F.transform(F.array_sort(F.collect_list(F.when(p, F.struct("line_index", F.col(c).alias("v"))))), lambda x: x["v"])
    bare = F.when(F.col("bullet"), T.without_marker(F.col("text"))).otherwise(F.col("text"))
    plain = ~F.col("titled") & ~F.col("bullet") & (left != "")
    records = full.withColumn("bare", bare).groupBy("doc_id", "heading_no", "logical_type", "record").agg(
        of("text", F.col("titled")).alias("subheadings"), F.flatten(of("dates", dates)).alias("dates"), of("text", plain).alias("paragraphs"), of("bare", F.col("bullet") & (F.col("bare") != "")).alias("bullets")
    )
    entry = F.struct("subheadings", "dates", F.expr("cast(array() as array<struct<text:string,url:string>>)").alias("urls"), "paragraphs", "bullets")
    by = records.groupBy("doc_id", "heading_no", F.col("logical_type").alias("section_type")).agg(F.transform(F.array_sort(F.collect_list(F.struct("record", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    return sections.first_of_type(by)


def measured(lines: DataFrame, widths: DataFrame) -> DataFrame:
    """Adds the document's line_height, paragraph_gap and tolerance of a row's baselines, and the visual row with
    the line's place in it."""
    d = stats.doc_stats(stats.page_stats(lines.withColumn("line_no", F.col("line_index"))))
    limits = stats.thresholds(F.lit(0.0), F.lit(0.0), F.col("median_line_height"), F.col("median_line_gap"), F.lit(10.0))
    d = d.select("doc_id", F.col("median_line_height").alias("line_height"), limits["paragraph_gap"].alias("paragraph_gap"), limits["baseline_tolerance"].alias("tolerance"))
    full = lines.join(d, "doc_id")
    based = full if "baseline" in lines.columns else full.withColumn("baseline", F.col("bbox.y1"))
    # a row is parted where a gutter between columns runs
    wide = staged(stats.gutters(lines, widths), "gutters")
    by_doc = wide.groupBy("doc_id").agg(F.collect_list(F.struct("page", "left", "right", "top", "bottom")).alias("_gutters"))
    w = Window.partitionBy("doc_id", "row")
    rows = layout.visual_rows(based.join(by_doc, "doc_id", "left"), "tolerance", "_gutters").select("doc_id", "line_index", "row", F.count("*").over(w).alias("row_size"), (F.row_number().over(w.orderBy("x0", "line_index")) - 1).alias("row_pos"))
    return based.join(rows, ["doc_id", "line_index"])


def _first(body: DataFrame, section: str) -> DataFrame:
    """Lines of the first section of a type."""
    w = Window.partitionBy("doc_id")
    return body.where(F.col("section_type") == section).withColumn("_h", F.min("heading_no").over(w)).where("heading_no = _h").drop("_h")


def _listed(column: str, where=None, order: str = "line_index"):
    """Aggregate: a column's values in line order."""
    item = F.struct(F.col(order).alias("at"), F.col(column).alias("v"))
    return F.transform(F.array_sort(F.collect_list(item if where is None else F.when(where, item))), lambda x: x["v"])


def _blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, record, paragraphs, bullets) of body lines with a record."""
    b = sections.content_blocks(lines.withColumn("subheading", F.lit(False)), ["doc_id", "record"])
    return b.groupBy("doc_id", "record").agg(_listed("text", F.col("kind") == "paragraph", "block").alias("paragraphs"), _listed("text", F.col("kind") == "bullet", "block").alias("bullets"))


TEXTS, URLS = "cast(array() as array<string>)", "cast(array() as array<struct<text:string,url:string>>)"


def _records(about: DataFrame, lines: DataFrame, fields: list[str], order: list[str], name: str) -> DataFrame:
    """(doc_id, name): records of fields, paragraphs and bullets as one array; records of nothing are left out."""
    both = about.join(_blocks(lines), ["doc_id", "record"], "full")
    known = {**{f: F.coalesce(f, F.expr(TEXTS)) for f in [*fields, "paragraphs", "bullets"]}, "urls": F.coalesce("urls", F.expr(URLS)) if "urls" in about.columns else F.expr(URLS), "skills": F.expr(TEXTS)}
    entry = F.struct(*[known[f].alias(f) for f in order])
    some = F.lit(False)
    for f in order:
        some = some | (F.size(known[f]) > 0)
    return both.where(some).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("record", entry.alias("e")))), lambda x: x["e"]).alias(name))


def _urls(lines: DataFrame) -> DataFrame:
    """(doc_id, record, urls) of the addresses in records' lines."""
    u = lines.select("doc_id", "record", "line_index", F.explode(claims.find_all(F.col("text"), P.URL)).alias("m")).where(~F.col("m.text").contains("@"))
    found = u.groupBy("doc_id", "record").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line_index", F.col("m.start").alias("s"), F.col("m.text").alias("t")))), lambda x: F.struct(x["t"].alias("text"), x["t"].alias("url")))).alias("urls"))
    return found


def experience(body: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(doc_id, experience): records of titles, companies, dates, locations and their text.

    What the text says itself counts (at-signs, date ranges, company markers); ``evidence`` (doc_id,
    line_index, seg, title, confidence, org, loc) adds what models found in a line's segments.
    """
    ev = staged(sections.line_evidence(_first(body, "experience")), "experience")
    seg = ev.where("at is null").select("doc_id", "line_index", F.posexplode("segments").alias("seg", "text")).withColumn("marker", F.col("text").rlike(P.COMPANY)).withColumn("link", F.lit(False))
    if evidence is None:
        seg = seg.withColumns({"title": F.lit(False), "confidence": F.lit(0.0), "org": F.lit(False), "loc": F.lit(False)})
    else:
        seg = seg.join(evidence, ["doc_id", "line_index", "seg"], "left").fillna({"title": False, "confidence": 0.0, "org": False, "loc": False})
    roles = sections.reconcile_segments(seg)
    half = lambda n: F.trim(F.element_at(F.split("text", ","), n))
    said = roles.groupBy("doc_id", "line_index").agg(
        _listed("text", F.col("role") == "job_title", "seg").alias("job_titles"), F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isin("company", "company_location"), F.struct("seg", F.when(F.col("role") == "company", F.col("text")).otherwise(half(1)).alias("v"))))), lambda x: x["v"]).alias("companies"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isin("location", "company_location"), F.struct("seg", F.when(F.col("role") == "location", F.col("text")).otherwise(half(-1)).alias("v"))))), lambda x: x["v"]).alias("locations"),
    )
    none = F.expr(TEXTS)
    ev = ev.join(said, ["doc_id", "line_index"], "left")
    ev = ev.withColumns({"job_titles": F.when(F.col("at").isNotNull(), F.array("at.left")).otherwise(F.coalesce("job_titles", none)), "companies": F.when(F.col("at").isNotNull(), F.array("at.right")).otherwise(F.coalesce("companies", none)), "locations": F.coalesce("locations", none)})
    ev = ev.withColumns({"has_range": F.size("ranges") > 0, "place": F.size("locations") > 0, "primary": (F.size("job_titles") > 0) | (F.size("companies") > 0) | (F.size("ranges") > 0)})
    ev = ev.select("doc_id", "heading_no", "line_index", "page", "text", "bbox", "bold", "bullet", "line_height", "paragraph_gap", "ranges", "job_titles", "companies", "locations", "has_range", "place", "primary")
    full = staged(ev.join(sections.experience_roles(ev), ["doc_id", "heading_no", "line_index"]), "experience")
    meta = full.where("role = 'metadata'")
    about = meta.groupBy("doc_id", "record").agg(*[F.flatten(_listed(c)).alias(n) for c, n in (("job_titles", "job_titles"), ("companies", "companies"), ("ranges", "dates"), ("locations", "locations"))]).join(_urls(meta), ["doc_id", "record"], "left")
    return _records(about, full.where("role != 'metadata'"), ["job_titles", "companies", "dates", "locations"], ["job_titles", "companies", "dates", "locations", "urls", "paragraphs", "bullets"], "experience")


def education(body: DataFrame) -> DataFrame:
    """(doc_id, education): records of titles, institutions, dates, grades and their text, by visual rows."""
    lines = _first(body, "education")
    ev = staged(sections.line_evidence(lines), "education")
    t = F.col("text")
    fields = sections.education_fields(lines).groupBy("doc_id", "line_index").agg(*[F.collect_list(F.when(F.col("field") == f, F.col("text"))).alias(n) for f, n in (("title", "titles"), ("institution", "institutions"))])
    ev = ev.join(fields, ["doc_id", "line_index"], "left").withColumns({c: F.coalesce(c, F.expr(TEXTS)) for c in ("titles", "institutions")})
    explicit = (F.size("ranges") > 0) | (F.size("gpa") > 0) | F.col("has_degree") | F.col("has_institution")
    few = T.word_count(t) <= P.SUBHEADING_WORDS
    ev = ev.withColumns({"explicit": explicit, "shape": F.col("bold") | t.rlike(P.METADATA_SEPARATOR) | few, "course": t.rlike(P.COURSEWORK), "long": ~few | P.strip(t).rlike("[.;:]$")})
    any_ = lambda c: F.max(F.col(c) if isinstance(c, str) else c)
    rows = ev.groupBy("doc_id", "heading_no", "row").agg(any_("explicit").alias("explicit"), any_("shape").alias("shape"), any_("course").alias("course"), any_("long").alias("long"), any_(F.size("titles") > 0).alias("titles"), any_(F.size("institutions") > 0).alias("institutions"), any_((F.size("dates") > 0) & ~F.col("bullet")).alias("dates"), any_(F.size("gpa") > 0).alias("other"), (F.count("*") == 1).alias("one"), any_(few).alias("few"))
    rows = rows.withColumn("prose", F.col("course") | (~(F.col("explicit") & F.col("shape")) & F.col("long"))).withColumn("short", F.col("one") & F.col("few"))
    full = staged(ev.join(sections.education_roles(rows), ["doc_id", "heading_no", "row"]), "education")
    meta = full.where("role != 'body'").withColumn("titles", F.when(F.col("role") == "title_tail", F.expr(TEXTS)).otherwise(F.col("titles")))
    about = meta.groupBy("doc_id", "record").agg(*[F.flatten(_listed(c)).alias(c) for c in ("titles", "institutions", "dates", "gpa")], _listed("text", F.col("role") == "title_tail").alias("tails")).join(_urls(meta), ["doc_id", "record"], "left")
    # a title that runs on below keeps its line breaks
    about = about.withColumn("titles", F.when((F.size("tails") > 0) & (F.size("titles") > 0), F.concat(F.slice("titles", F.lit(1), F.size("titles") - 1), F.array(F.array_join(F.concat(F.slice("titles", -1, 1), "tails"), "\n")))).otherwise(F.col("titles"))).drop("tails")
    about = about.withColumn("locations", F.expr(TEXTS))
    return _records(about, full.where("role = 'body'"), ["titles", "institutions", "dates", "locations", "gpa"], ["titles", "institutions", "dates", "locations", "gpa", "skills", "urls", "paragraphs", "bullets"], "education")


def skills(body: DataFrame) -> DataFrame:
    """(doc_id, skills): groups with an optional label; empty groups stay."""
    lines = _first(body, "skills")
    w = Window.partitionBy("doc_id", "row").orderBy("row_pos")
    right = F.lead("bbox").over(w)["x0"]
    first = (F.col("row_pos") == 0) & (F.col("row_size") >= 2) & (T.word_count(F.col("text")) <= 7) & (F.length("text") <= 50) & (F.col("bold") | F.col("subheading") | (right > F.col("bbox.x1") + F.col("size")))
    lines = lines.withColumns({"bullet": F.col("text").rlike(P.BULLET), "_first": F.coalesce(first, F.lit(False))})
    lines = lines.withColumn("left_label", F.max("_first").over(Window.partitionBy("doc_id", "row")))
    g = sections.skill_groups(lines).withColumn("record", F.col("group"))
    own = g.where("body is not null").withColumn("text", F.when(F.col("bullet"), F.concat(F.lit("• "), "body")).otherwise(F.col("body")))
    labels = g.groupBy("doc_id", "record").agg(F.first("label", ignorenulls=True).alias("subheading"))
    both = labels.join(_blocks(own), ["doc_id", "record"], "left").join(_urls(g), ["doc_id", "record"], "left")
    entry = F.struct("subheading", F.coalesce("paragraphs", F.expr(TEXTS)).alias("paragraphs"), F.coalesce("bullets", F.expr(TEXTS)).alias("bullets"), F.coalesce("urls", F.expr(URLS)).alias("urls"))
    return both.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("record", entry.alias("e")))), lambda x: x["e"]).alias("skills"))


def summary(body: DataFrame) -> DataFrame:
    """(doc_id, summary): the blocks of a summary that is the document's first section."""
    lead = body.where("heading_no = 0 and section_type = 'summary'").withColumn("bullet", F.col("text").rlike(P.BULLET))
    b = sections.content_blocks(lead, ["doc_id"])
    content = F.transform(F.array_sort(F.collect_list(F.struct("block", F.col("kind").alias("type"), "text"))), lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text")))
    return b.groupBy("doc_id").agg(F.struct(content.alias("content")).alias("summary"))


def others(body: DataFrame) -> DataFrame:
    """(doc_id, others): every section of no known type, with its heading and its lines as blocks."""
    lines = structure.logical_sections(body).where("logical_type = 'others'").withColumn("bullet", F.col("text").rlike(P.BULLET))
    b = sections.content_blocks(lines, ["doc_id", "heading_no", "heading_text"])
    of = lambda k: _listed("text", F.col("kind") == k, "block")
    e = b.groupBy("doc_id", "heading_no", "heading_text").agg(of("subheading").alias("s"), of("paragraph").alias("p"), of("bullet").alias("b"))
    entry = F.struct(F.col("s").alias("subheadings"), F.expr("cast(array() as array<struct<type:string,value:string>>)").alias("attributes"), F.expr(TEXTS).alias("dates"), F.expr(URLS).alias("urls"), F.col("p").alias("paragraphs"), F.col("b").alias("bullets"))
    return e.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("heading_no", F.struct(T.clean(F.col("heading_text")).alias("heading"), F.array(entry).alias("entries")).alias("e")))), lambda x: x["e"]).alias("others"))


def resumes(lines: DataFrame, widths: DataFrame, headings: DataFrame | None = None, evidence: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, resume) from extracted lines (doc_id, line_index, page, text, bbox, size, bold) and character
    widths (doc_id, median_character_width). ``headings`` (doc_id, line_index, section_type, similarity,
    runner_up), ``evidence`` (see experience) and ``found`` (see header_profile) bring what models found;
    without them names of sections are taken word for word.

    A section whose heading stands without content is [], one without a heading null."""
    headings = staged(exact_headings(lines) if headings is None else headings, "headings")
    profile = header_profile(staged(header_lines(lines, headings), "header"), found)
    routed = staged(structure.routed_headings(lines, headings), "routed")
    # every section reads these lines
    body = staged(body_lines(staged(measured(lines, widths), "lines"), routed, widths), "body")
    minor = staged(grouped_sections(body), "minor")
    # one row a document with a column a section, so that one join brings them all
    wide = minor.groupBy("doc_id").agg(*[F.first(F.when(F.col("section_type") == m, F.col("entries")), ignorenulls=True).alias(m) for m in output.MINOR])
    record = output.resumes(lines.select("doc_id").distinct(), [profile, summary(body), experience(body, evidence), education(body), skills(body), wide, others(body)])
    # a heading that owns nothing leaves [], not null
    named = routed.groupBy("doc_id").agg(F.collect_set("section_type").alias("_named"))
    r = F.col("resume")
    filled = [F.when(r[n].isNull() & F.array_contains("_named", n), F.array().cast(t)).otherwise(r[n]).alias(n) if t.startswith("array") else r[n].alias(n) for n, t in output.fields()]
    return record.join(named, "doc_id", "left").select("doc_id", F.struct(*filled).alias("resume"))
