"""Headings, sections and what their lines are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .stats import indentation_level

# Names of sections.
SECTIONS = {
    "summary": ("Professional Summary", "Career Profile", "Career Objective", "About Me", "Summary", "Profile", "Executive Summary", "Personal Statement", "Objective", "Professional Profile", "Career Summary", "Overview", "Highlights", "Key Qualifications", "Profile Summary"),
    "experience": ("Work Experience", "Professional Experience", "Employment History", "Career History", "Experience", "Relevant Experience", "Work History", "Job History", "Employment", "Positions Held", "Field Experience", "Industry Experience", "Design Experience", "Marketing Experience", "Freelance Experience", "Client Experience", "Internship Experience", "Practical Experience"),
    "education": ("Education", "Academic Background", "Academic Qualifications", "Education and Training", "Educational Background", "Academic History", "Schooling", "Degrees", "Coursework", "Relevant Coursework"),
    "skills": ("Skills", "Technical Skills", "Core Competencies", "Technologies and Tools", "Key Skills", "Skill Set", "Areas of Expertise", "Competencies", "Software Skills", "Design Skills", "Design Tools", "Programming Languages", "Languages and Frameworks", "Tech Stack", "Tools and Technologies", "Marketing Skills", "Digital Skills", "Hard Skills", "Soft Skills", "Proficiencies", "Specializations", "UX Skills", "UI Skills", "Skills Summary"),
    "projects": ("Projects", "Selected Projects", "Personal Projects", "Portfolio", "Case Studies", "Design Portfolio", "Featured Projects", "Key Projects", "Project Highlights", "Campaigns", "Selected Campaigns", "Notable Work", "Side Projects", "Open Source Contributions", "GitHub Projects", "Academic Projects"),
    "certifications": ("Certifications", "Certificates and Training", "Professional Certifications", "Certificates", "Licenses and Certifications", "Training and Certifications", "Professional Development", "Credentials", "Accreditations"),
    "licenses": ("Licenses", "Driver's License", "Commercial License", "Trade License", "Permits and Licenses", "Professional Licenses", "CDL", "OSHA Certification", "Safety Certifications", "Forklift Certification"),
    "tools_equipment": ("Tools and Equipment", "Equipment Operated", "Machinery", "Equipment Proficiency", "Tools", "Equipment Experience", "Machine Operation"),
    "languages": ("Languages", "Language Proficiency", "Language Skills", "Spoken Languages"),
    "volunteering": ("Volunteer Experience", "Community Involvement", "Community Service", "Volunteering", "Volunteer Work", "Civic Engagement"),
    "awards": ("Awards and Honors", "Achievements", "Awards", "Honors", "Recognition", "Accolades", "Accomplishments"),
    "publications": ("Publications", "Research and Publications", "Papers", "Articles Published", "Conference Talks", "Speaking Engagements", "Presentations"),
    "references": ("References", "Professional References", "References Available Upon Request"),
    "interests": ("Interests", "Hobbies", "Personal Interests", "Activities", "Extracurricular Activities"),
}
STOPS = r"[.,;:]$"
HEADING = "struct<line_index:int,section_type:string,similarity:double,runner_up:double,x0:double,y0:double,y1:double,size:double,page:int>"


def section_references(spark) -> DataFrame:
    rows = [(k, p, i) for i, (k, p) in enumerate((k, p) for k, names in SECTIONS.items() for p in names)]
    return spark.createDataFrame(rows, "class string, phrase string, ord int")


def exact_section(text: Column) -> Column:
    """The section that a text names word for word (case and spacing aside), null if none."""

    def named(folded):
        out = F.lit(None).cast("string")
        for name, phrases in reversed(SECTIONS.items()):
            out = F.when(folded.isin(*[p.lower() for p in phrases]), name).otherwise(out)
        return out

    # as a branch's own expression the text would be folded again for each section
    return T.let(F.lower(P.strip(F.regexp_replace(text, r"(?U)\s+", " "))), named)


def page_medians(lines: DataFrame) -> DataFrame:
    return lines.where("size > 0").groupBy("doc_id", "page").agg(F.median("size").alias("page_size"))


def looks_like_heading(lines: DataFrame) -> Column:
    """Short, not an address, not the end of a clause, and bold, in capitals or larger than its page."""
    t = P.strip(F.col("text"))
    n = T.word_count(t)
    shape = (n >= 1) & (n <= P.HEADING_WORDS) & (F.length(t) <= P.HEADING_CHARS) & ~t.contains("@") & ~t.rlike(r"^(https?://|www\.)") & ~t.rlike(STOPS)
    large = (F.col("page_size") > 0) & (F.col("size") >= F.col("page_size") * P.HEADING_SIZE)
    return shape & (F.col("bold") | (T.upper_ratio(t) >= P.UPPER_RATIO) | large)


def heading_candidates(lines: DataFrame) -> DataFrame:
    sized = lines.join(page_medians(lines), ["doc_id", "page"], "left").withColumn("page_size", F.coalesce("page_size", "size"))
    return sized.where(looks_like_heading(sized)).select("doc_id", "line_index", T.heading_text(F.col("text")).alias("heading"))


def reliable(text: Column, similarity: Column, runner_up: Column) -> Column:
    """A section name word for word, or capitals that a model is sure of."""
    return T.let(T.heading_text(text), lambda h: _reliable(h, similarity, runner_up))


def _reliable(h: Column, similarity: Column, runner_up: Column) -> Column:
    named = exact_section(h).isNotNull()
    sure = (T.upper_ratio(h) >= P.UPPER_RATIO) & (similarity >= P.BOUNDARY_SIMILARITY) & (similarity - runner_up >= P.BOUNDARY_MARGIN)
    return named | F.coalesce(sure, F.lit(False))


def header_boundary(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, boundary): the first reliable heading of page 1 that isn't the first line."""
    found = headings.join(lines.select("doc_id", "line_index", "page", "text"), ["doc_id", "line_index"])
    return found.where((F.col("page") == 1) & (F.col("line_index") > 0) & reliable(F.col("text"), F.col("similarity"), F.col("runner_up"))).groupBy("doc_id").agg(F.min("line_index").alias("boundary"))


def right_neighbours(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (doc_id, line_index) with content to their right on the same visual row."""
    a = candidates.select("doc_id", "line_index").join(lines, ["doc_id", "line_index"]).select("doc_id", "page", F.col("line_index").alias("i"), F.col("bbox").alias("a"), "size")
    b = lines.select("doc_id", "page", F.col("line_index").alias("j"), F.col("bbox").alias("b"))
    clear = F.col("b.x0") > F.col("a.x1") + F.greatest(F.lit(2.0), F.col("size") * 0.5)
    shared = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    high = F.least(F.col("a.y1") - F.col("a.y0"), F.col("b.y1") - F.col("b.y0")) * 0.45
    hit = a.join(b, ["doc_id", "page"]).where((F.col("i") != F.col("j")) & clear & (shared >= high))
    return hit.select("doc_id", F.col("i").alias("line_index")).distinct()


def routed_headings(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, heading_no, line_index, section_type, ...): the headings that open sections.

    Reliable ones do; after one, a line set like it does too, as the section that a model names or as
    'others'. A smaller, indented one beside other content is a label in its section and is passed over.
    Each choice depends on the last heading that was kept: a fold over a document's lines.
    """
    seen = headings.withColumn("is_heading", F.lit(True))
    right = right_neighbours(lines, lines.where(T.word_count(F.col("text")) <= P.HEADING_WORDS)).withColumn("beside", F.lit(True))
    full = lines.join(seen, ["doc_id", "line_index"], "left").join(right, ["doc_id", "line_index"], "left")

    def marks(h):
        strong = F.coalesce(F.col("is_heading") & _reliable(h, F.col("similarity"), F.col("runner_up")), F.lit(False))
        peer = (h != "") & ~h.rlike(P.BULLET) & (F.length(h) <= P.HEADING_CHARS) & (F.col("bold") | (T.upper_ratio(h) >= P.UPPER_RATIO)) & (T.word_count(h) <= P.HEADING_WORDS)
        return F.struct(strong.alias("strong"), peer.alias("peer"))

    item = F.struct(
        F.col("line_index").cast("int").alias("line_index"), "strong", "peer", F.coalesce("section_type", F.lit("others")).alias("section_type"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("runner_up", F.lit(0.0)).alias("runner_up"),
        F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"), F.col("size").cast("double").alias("size"), F.col("page").cast("int").alias("page"), F.coalesce("beside", F.lit(False)).alias("beside"),
    )
    # a filter's expression would be worked out again for the columns
    marked = F.filter(F.array(T.let(T.heading_text(F.col("text")), marks)), lambda m: m["strong"] | m["peer"])
    maybe = full.select("*", F.inline(marked))
    packed = maybe.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def step(out, li):
        last, some = F.element_at(out, -1), F.size(out) > 0
        as_peer = some & li["peer"] & (li["size"] >= last["size"] * 0.98) & (li["section_type"] != last["section_type"])
        local = some & (li["page"] >= last["page"]) & (li["size"] < last["size"] * 0.98) & (li["x0"] > last["x0"] + F.greatest(F.lit(4.0), last["size"] * 0.5)) & li["beside"]
        keep = (li["strong"] | as_peer) & ~F.coalesce(local, F.lit(False))
        fresh = F.struct(*[li[c].alias(c) for c in ("line_index", "section_type", "similarity", "runner_up", "x0", "y0", "y1", "size", "page")])
        return F.when(F.coalesce(keep, F.lit(False)), F.array_append(out, fresh)).otherwise(out)

    kept = F.aggregate("all", F.expr(f"cast(array() as array<{HEADING}>)"), step)
    return packed.select("doc_id", F.posexplode(kept).alias("heading_no", "h")).select("doc_id", "heading_no", "h.line_index", "h.section_type", "h.similarity", "h.runner_up")


def section_lines(lines: DataFrame, routed: DataFrame) -> DataFrame:
    """Every line after a heading with that heading: the last one at or before it (an as-of join as a window)."""
    marks = routed.select("doc_id", "line_index", F.struct("heading_no", "section_type", F.col("line_index").alias("heading_line")).alias("h"))
    w = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.join(marks, ["doc_id", "line_index"], "left").withColumn("h", F.last("h", ignorenulls=True).over(w))
    return out.where("h is not null and line_index > h.heading_line").withColumns({"heading_no": F.col("h.heading_no"), "section_type": F.col("h.section_type"), "heading_line": F.col("h.heading_line")}).drop("h")


def wrapped(lines: DataFrame) -> Column:
    """A line indented more levels than the line above it on the same page (columns level, page)."""
    w = Window.partitionBy("doc_id", "heading_no").orderBy("line_index")
    return F.coalesce((F.lag("page").over(w) == F.col("page")) & (F.col("level") > F.lag("level").over(w)), F.lit(False))


def body_style(lines: DataFrame) -> DataFrame:
    """(doc_id, heading_no, body_size, body_bold, body_level) of each section's prose, or of all its lines."""
    t = F.col("text")
    prose = ((T.word_count(t) > P.SUBHEADING_WORDS) | F.regexp_replace(t, r"(?U)\s+$", "").rlike(STOPS)) & ~F.col("wrapped")
    marked = lines.withColumn("wrapped", wrapped(lines)).withColumn("prose", prose)
    pick = lambda c, p: F.when(p, F.col(c))
    by = marked.groupBy("doc_id", "heading_no").agg(
        F.median(pick("size", F.col("prose") & (F.col("size") > 0))).alias("ps"), F.median(pick("size", F.col("size") > 0)).alias("s"),
        F.sum(F.col("prose").cast("int")).alias("np"), F.count("*").alias("n"),
        F.sum((F.col("prose") & F.col("bold")).cast("int")).alias("bp"), F.sum(F.col("bold").cast("int")).alias("b"), F.min("level").alias("body_level"),
    )
    has = F.col("np") > 0
    return by.select("doc_id", "heading_no", F.coalesce(F.when(has, F.col("ps")).otherwise(F.col("s")), F.lit(0.0)).alias("body_size"), F.when(has, F.col("bp") * 2 > F.col("np")).otherwise(F.col("b") * 2 > F.col("n")).alias("body_bold"), "body_level")


def looks_like_subheading() -> Column:
    """Over columns text, level, size, bold, body_size, body_bold, body_level."""
    t = P.strip(F.col("text"))
    shape = (t != "") & ~t.rlike(STOPS) & (F.col("level") <= F.col("body_level")) & (F.length(t) <= P.SUBHEADING_CHARS) & (T.word_count(t) <= P.SUBHEADING_WORDS)
    return shape & (((F.col("body_size") > 0) & (F.col("size") >= F.col("body_size") * P.SUBHEADING_SIZE)) | (F.col("bold") & ~F.col("body_bold")))


def heading_components(text: Column) -> Column:
    """array<struct<text, section_type>>: the destinations that a heading names; a known name is never divided."""
    part = lambda x: F.struct(x.alias("text"), exact_section(x).alias("section_type"))
    pieces = F.filter(F.transform(F.split(text, P.COMPOUND), P.strip), lambda x: (F.length(x) >= 2) & x.rlike(r"\p{L}"))
    whole = T.let(part(text), lambda w: F.when(w["section_type"].isNotNull(), F.array(w)))
    none = F.array(F.struct(text.alias("text"), F.lit(None).cast("string").alias("section_type")))
    return F.when(text.isNotNull(), F.coalesce(whole, T.let(pieces, lambda p: F.when(F.size(p) > 0, F.transform(p, part))), none))


def block_owner(text: Column, components: Column) -> Column:
    """The component that a line's own label names, else languages for 'language: level', if among them."""
    known = F.filter(components, lambda c: c["section_type"].isNotNull())

    def owner(x):
        label, section = x["label"], x["section"]
        stated = F.filter(known, lambda c: (label == F.lower(c["text"])) | (section == c["section_type"]))
        spoken = F.exists(known, lambda c: c["section_type"] == "languages") & label.rlike(P.LANGUAGE)
        return F.coalesce(F.get(stated, F.lit(0))["section_type"], F.when(spoken, "languages"))

    folded = lambda bare: F.lower(P.strip(F.regexp_replace(F.regexp_extract(bare, P.KEY_COLON, 1), r"(?U)\s+", " ")))
    both = lambda label: F.struct(label.alias("label"), exact_section(label).alias("section"))
    # a line without a colon has no label to look at
    return F.when(text.contains(":"), T.let(T.without_marker(text), lambda bare: F.when(bare.rlike(P.KEY_COLON), T.let(T.let(folded(bare), both), owner))))


def logical_sections(lines: DataFrame) -> DataFrame:
    """Section lines (with heading_text, section_type, subheading) with the logical section each belongs to.

    An ordinary heading's lines keep its type. Under a heading of several names a line goes to the name that
    it or the local subheading above it claims; where no line claims one the first known name takes all, and
    where some do the rest goes to 'others', as does everything under a heading of unknown names.
    """
    c = F.col("components")
    keyed = lines.withColumn("components", heading_components(F.col("heading_text")))
    named = F.filter(c, lambda x: x["section_type"].isNotNull())
    local = F.when(F.col("subheading"), exact_section(T.without_marker(F.col("text"))))
    is_run = F.col("subheading") & F.exists(named, lambda x: x["section_type"] == local)
    # a run's owner carries on to the next subheading: '' marks one that names nothing here
    mark = F.when(F.coalesce(is_run, F.lit(False)), local).when(F.col("subheading"), F.lit(""))
    w = Window.partitionBy("doc_id", "heading_no").orderBy("line_index")
    run = F.nullif(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(""))
    owner = F.when(F.coalesce(is_run, F.lit(False)), local).otherwise(F.coalesce(block_owner(F.col("text"), c), run))
    out = keyed.withColumn("owner", owner).withColumn("claimed", F.max(F.col("owner").isNotNull()).over(Window.partitionBy("doc_id", "heading_no")))
    first = F.get(named, F.lit(0))["section_type"]
    logical = F.when(F.size(c) < 2, F.col("section_type")).when(first.isNull(), "others").when(~F.col("claimed"), first).otherwise(F.coalesce("owner", F.lit("others")))
    return out.withColumn("logical_type", logical).withColumn("compound", F.size(c) >= 2).drop("components", "owner", "claimed")


def levels_of(lines: DataFrame, levels: DataFrame, widths: DataFrame) -> DataFrame:
    """Adds level, the line's indentation level."""
    return lines.join(levels, "doc_id").join(widths, "doc_id").withColumn("level", indentation_level(F.col("bbox.x0"), F.col("levels"), F.col("median_character_width"))).drop("levels", "median_character_width")
