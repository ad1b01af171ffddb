"""Scores of extracted fields against labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

# Fixed value: a shorter text inside a longer one counts from this length.
CONTAINED = 6
# What is scored of a record.
SCALARS = ("name", "location", "date_of_birth", "age", "gender", "marital_status", "visa_status", "nationality", "current_residence")
LISTS = ("job_titles", "emails", "phones", "urls")
ENTRIES = {"experience": ("job_titles", "companies", "dates", "locations"), "education": ("titles", "institutions", "dates")}
ROUTED = ("summary", "experience", "education", "skills", "projects", "certifications", "licenses", "tools_equipment", "languages", "volunteering", "awards", "publications", "references", "interests", "others")
_DASHES = "‐‑‒–—―−"


def normal(text: Column) -> Column:
    """A text without what scoring ignores: compatibility forms, invisibles, kinds of dashes, spacing, case."""
    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.casefold())

    return folded(plain(nfkc(text), case=False))


def plain(text: Column, case: bool = True) -> Column:
    """The same for text that is in compatibility form, without Python; ``case``: lower-case too."""
    t = F.translate(F.translate(text, P.INVISIBLE, ""), _DASHES, "-" * len(_DASHES))
    t = F.btrim(F.regexp_replace(t, r"(?U)\s+", " "), F.lit(" \t.,;:|-•·"))
    return F.lower(t) if case else t


def agree(a: Column, b: Column) -> Column:
    """Equal, or one of at least six characters inside the other."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= CONTAINED) & F.contains(long, short)))


def match_counts(expected: Column, actual: Column) -> Column:
    """struct(tp, fp, fn): each expected value takes the first unclaimed actual one that agrees (a fold)."""
    have = F.filter(actual, lambda v: v != "")

    def step(s, want):
        hits = F.filter(s["left"], lambda v: agree(want, v))
        at = F.array_position(s["left"], F.get(hits, F.lit(0)))
        rest = F.concat(F.slice(s["left"], F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.slice(s["left"], (at + 1).cast("int"), F.size(s["left"])))
        hit = F.size(hits) > 0
        return F.struct(F.when(hit, rest).otherwise(s["left"]).alias("left"), (s["tp"] + hit.cast("int")).alias("tp"), (s["fn"] + (~hit).cast("int")).alias("fn"))

    start = F.struct(have.alias("left"), F.lit(0).alias("tp"), F.lit(0).alias("fn"))
    return F.aggregate(F.filter(expected, lambda v: v != ""), start, step, lambda s: F.struct(s["tp"].alias("tp"), F.size(s["left"]).alias("fp"), s["fn"].alias("fn")))


def field_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(doc_id, field, tp, fp, fn) of two tables (doc_id, field, seq, value) with normalised values."""
    pack = lambda df, n: df.groupBy("doc_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias(n))
    both = pack(expected, "want").join(pack(actual, "got"), ["doc_id", "field"], "full")
    none = F.expr("cast(array() as array<string>)")
    return both.select("doc_id", "field", match_counts(F.coalesce("want", none), F.coalesce("got", none)).alias("c")).select("doc_id", "field", "c.*")


def record_values(records: DataFrame) -> DataFrame:
    """(doc_id, field, seq, value) of records or labels (doc_id, json): every scored text in its order, the
    sections that hold something (a label states them as sections_present) and a value for each entry.

    A url counts as its address, else as its text. Values are not yet normalised; a null or broken record has
    none."""
    texts, entries = "array<string>", {k: "array<struct<" + ",".join(f"{f}:array<string>" for f in fields) + ">>" for k, fields in ENTRIES.items()}
    profile = "struct<" + ",".join([*(f"{n}:string" for n in SCALARS), *(f"{n}:{texts}" for n in LISTS)]) + ">"
    r = records.select("doc_id", "json", F.from_json("json", f"struct<header_profile:{profile},sections_present:{texts}," + ",".join(f"{k}:{t}" for k, t in entries.items()) + ">").alias("r"))
    p = F.col("r.header_profile")
    address = lambda v: F.when(v.startswith("{"), F.coalesce(F.nullif(F.get_json_object(v, "$.url"), F.lit("")), F.get_json_object(v, "$.text"))).otherwise(v)
    filled = [F.when(~F.coalesce(F.get_json_object("json", f"$.{n}"), F.lit("")).isin("", "[]", "{}"), F.lit(n)) for n in ROUTED]
    lists = {f"header.{n}": F.array(p[n]) for n in SCALARS} | {f"header.{n}": F.transform(p[n], address) if n == "urls" else p[n] for n in LISTS}
    lists["section_routing"] = F.coalesce("r.sections_present", F.array_compact(F.array(*filled)))
    for k, fields in ENTRIES.items():
        lists |= {f"{k}.{f}": F.flatten(F.array_compact(F.col(f"r.{k}.{f}"))) for f in fields}
        lists[f"{k}.entry_count"] = F.transform(F.coalesce(f"r.{k}", F.array().cast(entries[k])), lambda e, i: F.concat(F.lit("entry-"), i.cast("string")))
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(v, F.array().cast(texts)).alias("values")) for n, v in lists.items()])
    rows = r.where("r is not null").select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.field", F.posexplode("f.values").alias("seq", "value"))
    return rows.where("value is not null")


def scorecard(labels: DataFrame, results: DataFrame) -> DataFrame:
    """(field, tp, fp, fn, precision, recall, f1) of results against labels (doc_id, json), over the documents
    that have a label; ``macro`` sums it up."""
    known = labels.select("doc_id").distinct()
    folded = lambda df: record_values(df).withColumn("value", normal(F.col("value")))
    return scores(field_counts(folded(labels), folded(results.join(known, "doc_id", "left_semi"))), ["field"])


def scores(counts: DataFrame, by: list[str]) -> DataFrame:
    """Sums, precision, recall and F1; what has no predictions is precise, what has no labels is complete."""
    s = counts.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def macro(by_field: DataFrame) -> DataFrame:
    return by_field.where("tp + fp + fn > 0").agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("fields"))


def regressions(now: DataFrame, floor: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Fields whose F1 fell below the floor (field, f1)."""
    return floor.select("field", F.col("f1").alias("floor")).join(now, "field", "left").where(F.coalesce("f1", F.lit(0.0)) < F.col("floor") - tolerance).select("field", "floor", "f1")
