"""The result: one closed record a document, in fixed order; an absent section is null, an empty one []."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, joined

# The version and the sections, in order.
VERSION = "1.0"
MINOR = ("projects", "certifications", "licenses", "tools_equipment", "languages", "volunteering", "awards", "publications", "references", "interests")
SCALARS = ("name", "job_titles", "location", "date_of_birth", "age", "gender", "marital_status", "visa_status", "nationality", "current_residence", "current_income", "current_package", "emails", "phones", "urls")
LISTS = {"job_titles": "job_title", "emails": "email", "phones": "phone"}
_TL, _LK = "array<string>", "array<struct<text:string,url:string>>"
GROUPED = f"array<struct<subheadings:{_TL},dates:{_TL},urls:{_LK},paragraphs:{_TL},bullets:{_TL}>>"
SCHEMA = (
    "struct<schema_version:string,header_profile:struct<" + ",".join(f"{n}:{_TL if n in LISTS else _LK if n == 'urls' else 'string'}" for n in SCALARS) + ">,"
    f"summary:struct<content:array<struct<type:string,text:string>>>,"
    f"experience:array<struct<job_titles:{_TL},companies:{_TL},dates:{_TL},locations:{_TL},urls:{_LK},paragraphs:{_TL},bullets:{_TL}>>,"
    f"education:array<struct<titles:{_TL},institutions:{_TL},dates:{_TL},locations:{_TL},gpa:{_TL},skills:{_TL},urls:{_LK},paragraphs:{_TL},bullets:{_TL}>>,"
    f"skills:array<struct<subheading:string,paragraphs:{_TL},bullets:{_TL},urls:{_LK}>>," + ",".join(f"{m}:{GROUPED}" for m in MINOR) + ","
    f"others:array<struct<heading:string,entries:array<struct<subheadings:{_TL},attributes:array<struct<type:string,value:string>>,dates:{_TL},urls:{_LK},paragraphs:{_TL},bullets:{_TL}>>>>>"
)


def texts(items: Column) -> Column:
    """Cleaned texts of (text, ...) items, empty ones left out."""
    return F.filter(F.transform(items, lambda x: clean(x["text"])), lambda t: t != "")


def urls(items: Column) -> Column:
    """Distinct (text, url) pairs, the first of equals; a missing url is the text."""
    pairs = F.transform(items, lambda x: F.struct(clean(F.coalesce(x["text"], F.lit(""))).alias("text"), clean(F.coalesce(x["url"], x["text"], F.lit(""))).alias("url")))
    return F.array_distinct(F.filter(pairs, lambda p: (p["text"] != "") | (p["url"] != "")))


def holds_something(entry: Column, fields: list[str]) -> Column:
    """Whether any list of an entry has an item."""
    out = F.lit(False)
    for f in fields:
        out = out | (F.size(entry[f]) > 0)
    return out


def header_profile(claims: DataFrame) -> DataFrame:
    """(doc_id, header_profile) of claims (doc_id, line_index, kind, start, end, text): one scalar a field, the
    first by position, and the lists in order."""
    c = claims.withColumn("text", clean(F.col("text"))).where("text != ''")
    at = F.struct("line_index", "start", "end")
    of = lambda k: F.when(F.col("kind") == k, F.struct(at.alias("at"), F.col("text").alias("text")))
    first = lambda k: F.min(of(k))["text"]
    every = lambda k: F.transform(F.array_sort(F.collect_set(of(k))), lambda x: x["text"])
    link = F.array_distinct(F.transform(F.array_sort(F.collect_set(of("url"))), lambda x: F.struct(x["text"].alias("text"), x["text"].alias("url"))))
    fields = [(link if n == "urls" else every(LISTS[n]) if n in LISTS else first(n)).alias(n) for n in SCALARS]
    return c.groupBy("doc_id").agg(F.struct(*fields).alias("header_profile"))


def resumes(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """(doc_id, resume): every document, with its sections from tables (doc_id, section, ...); one without stays null."""
    out, have = docs.select("doc_id"), set()
    kinds = {f.split(":", 1)[0]: f.split(":", 1)[1] for f in _fields(SCHEMA)}
    for df in parts:
        out = out.join(df, "doc_id", "left")
        have |= set(df.columns)
    value = lambda n: F.col(n).cast(kinds[n]) if n in have else F.lit(None).cast(kinds[n])
    return out.select("doc_id", F.struct(F.lit(VERSION).alias("schema_version"), *[value(n).alias(n) for n in kinds if n != "schema_version"]).alias("resume"))


def fields() -> list[tuple[str, str]]:
    """(name, type) of the record's keys, in order."""
    return [tuple(f.split(":", 1)) for f in _fields(SCHEMA)]


def _fields(schema: str) -> list[str]:
    """Fields at the top level of a struct type."""
    out, depth, start = [], 0, 0
    body = schema[len("struct<") : -1]
    for i, c in enumerate(body):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(body[start:i])
            start = i + 1
    return [*out, body[start:]]


def as_json(resume: Column, options: dict | None = None) -> Column:
    """Keys in order, nulls kept."""
    return F.to_json(resume, {"ignoreNullFields": "false", **(options or {})})


def pretty(text: Column) -> Column:
    """The file's form: two spaces of indent, letters as they are, a line end last."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        import json

        return values.map(lambda v: None if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False) + "\n")

    return run(text)


def conforms(text: Column) -> Column:
    """Whether a JSON text has exactly the record's keys and version."""
    keys = [f.split(":", 1)[0] for f in _fields(SCHEMA)]
    return F.coalesce((F.json_object_keys(text) == F.array(*map(F.lit, keys))) & (F.get_json_object(text, "$.schema_version") == VERSION), F.lit(False))


def leaked(text: Column) -> Column:
    """Keys of the audit track that an output must never hold."""
    names = ("bbox", "detectionMethod", "confidence", "page", "similarity")
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(f'"{n}":')), F.lit(n)) for n in names]))


def blocks(resume_table: DataFrame) -> DataFrame:
    """(doc_id, section, entry, ord, style, text): a record laid out again as blocks in reading order."""
    r = F.col("resume")

    def lay(section: str, fields: list[tuple[str, str]]):
        e = resume_table.select("doc_id", F.posexplode(r[section]).alias("entry", "e"))
        styled = lambda style: lambda t: F.struct(F.lit(style).alias("style"), t.alias("text"))
        items = F.flatten(F.array(*[F.transform(F.coalesce(F.col(f"e.{f}"), F.expr("cast(array() as array<string>)")), styled(s)) for f, s in fields]))
        return e.select("doc_id", F.lit(section).alias("section"), "entry", F.posexplode(items).alias("ord", "b")).select("doc_id", "section", "entry", "ord", "b.style", "b.text")

    parts = [lay("experience", [("job_titles", "title"), ("companies", "meta"), ("locations", "meta"), ("dates", "meta"), ("paragraphs", "paragraph"), ("bullets", "bullet")]), lay("education", [("titles", "title"), ("institutions", "meta"), ("dates", "meta"), ("paragraphs", "paragraph"), ("bullets", "bullet")])]
    parts += [lay(m, [("subheadings", "title"), ("dates", "meta"), ("paragraphs", "paragraph"), ("bullets", "bullet")]) for m in MINOR]
    h = r["header_profile"]
    contact = joined(F.concat(F.coalesce(h["emails"], F.array()), F.coalesce(h["phones"], F.array())))
    head = F.array(F.struct(F.lit("name").alias("style"), h["name"].alias("text")), F.struct(F.lit("tagline").alias("style"), joined(h["job_titles"]).alias("text")), F.struct(F.lit("contact").alias("style"), contact.alias("text")))
    top = resume_table.where(h.isNotNull()).select("doc_id", F.lit("header_profile").alias("section"), F.lit(0).alias("entry"), F.posexplode(head).alias("ord", "b")).select("doc_id", "section", "entry", "ord", "b.style", "b.text").where("text is not null and text != ''")
    out = top
    for p in parts:
        out = out.unionByName(p)
    return out


def wrap(text: Column, width: int) -> Column:
    """Words packed into lines of at most ``width`` characters; a longer word has a line of its own."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(words, F.expr("cast(array() as array<string>)"), lambda a, w: F.when((F.size(a) > 0) & (F.length(last(a)) + 1 + F.length(w) <= width), F.array_append(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.concat(last(a), F.lit(" "), w))).otherwise(F.array_append(a, w)))


def box_table(evidence: DataFrame) -> DataFrame:
    """Boxes to draw: (doc_id, page, label, bbox, stroke); what a model had part in is drawn thinner."""
    from ..operators.claims import model_backed

    fine = evidence.where((F.col("bbox.x1") > F.col("bbox.x0")) & (F.col("bbox.y1") > F.col("bbox.y0")))
    return fine.select("doc_id", "page", "label", "bbox", F.when(model_backed(F.col("method")), 1).otherwise(2).alias("stroke"))


def legend(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("doc_id", "page", "label").agg(F.count("*").alias("n"))


def write_evidence(evidence: DataFrame, path: str) -> None:
    """One folder of JSON a section; a section without rows writes nothing."""
    evidence.write.mode("overwrite").partitionBy("section").json(path)


def warnings_report(docs: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, supported, warnings) for every document, those without a warning too."""
    by = warnings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "kind", "detail"))).alias("w"))
    w = F.coalesce("w", F.expr("cast(array() as array<struct<page:int,kind:string,detail:string>>)"))
    return docs.select("doc_id").join(by, "doc_id", "left").select("doc_id", (F.size(w) == 0).alias("supported"), w.alias("warnings"))
