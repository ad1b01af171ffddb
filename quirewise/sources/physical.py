"""Pages as an extractor describes them in JSON: blocks of lines of spans of characters, rules, images, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extractor's fields and flag bits, and what makes a drawing a rule.
CHAR = "struct<c:string,bbox:array<double>,origin:array<double>>"
SPAN = f"struct<font:string,size:double,flags:int,color:int,chars:array<{CHAR}>>"
BLOCK = f"struct<type:int,bbox:array<double>,lines:array<struct<dir:array<double>,bbox:array<double>,spans:array<{SPAN}>>>>"
PAGE = f"doc_id string, page int, width double, height double, rotation int, blocks array<{BLOCK}>, drawings array<array<double>>, links array<struct<uri:string,rect:array<double>>>"
ITALIC, SERIF, MONO, BOLD = 2, 4, 8, 16
THIN, LONG = 2.0, 10.0


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).json(path)


def as_box(b: Column) -> Column:
    return F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def is_bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(BOLD) != 0) | F.lower(font).rlike("bold|black")


def lines(pages: DataFrame) -> DataFrame:
    """Text lines with at least one character, numbered in the order of the page."""
    block = pages.select("doc_id", "page", F.posexplode("blocks").alias("b", "block")).where("block.type = 0")
    line = block.select("doc_id", "page", "b", F.posexplode("block.lines").alias("l", "line"))
    out = line.select("doc_id", "page", (F.col("b") * 10000 + F.col("l")).alias("line_no"), F.get("line.dir", F.lit(0)).alias("dir_x"), F.get("line.dir", F.lit(1)).alias("dir_y"), as_box(F.col("line.bbox")).alias("bbox"), "line.spans")
    text = F.array_join(F.transform("spans", lambda s: F.array_join(F.transform(s["chars"], lambda c: c["c"]), "")), "")
    out = out.withColumn("text", text).withColumn("size", F.array_max(F.transform("spans", lambda s: s["size"]))).withColumn("bold", F.exists("spans", lambda s: is_bold(s["font"], s["flags"])))
    return out.where("text != ''")


def spans(lines_df: DataFrame) -> DataFrame:
    s = lines_df.select("doc_id", "page", "line_no", F.posexplode("spans").alias("span_no", "s"))
    chars = F.col("s.chars")
    return s.select(
        "doc_id", "page", "line_no", "span_no", F.array_join(F.transform(chars, lambda c: c["c"]), "").alias("text"), "s.font", "s.size", is_bold(F.col("s.font"), F.col("s.flags")).alias("bold"), (F.col("s.flags").bitwiseAND(ITALIC) != 0).alias("italic"), (F.col("s.flags").bitwiseAND(MONO) != 0).alias("mono"),
        F.array_min(F.transform(chars, lambda c: F.get(c["bbox"], F.lit(0)))).alias("x0"), F.array_max(F.transform(chars, lambda c: F.get(c["bbox"], F.lit(2)))).alias("x1"), chars.alias("chars"),
    )


def tokens(spans_df: DataFrame) -> DataFrame:
    t = spans_df.withColumn("char_width", F.when(F.length("text") > 0, (F.col("x1") - F.col("x0")) / F.length("text")).otherwise(0.0))
    t = t.select("doc_id", "page", "line_no", "span_no", "font", "size", "bold", "char_width", F.posexplode("chars").alias("tok_no", "c"))
    return t.select("doc_id", "page", "line_no", "span_no", "tok_no", F.col("c.c").alias("text"), as_box(F.col("c.bbox")).alias("bbox"), F.get("c.origin", F.lit(1)).alias("origin_y"), "font", "size", "bold", "char_width")


def rules(pages: DataFrame) -> DataFrame:
    d = pages.select("doc_id", "page", F.posexplode("drawings").alias("rule_no", "d")).select("doc_id", "page", "rule_no", as_box(F.col("d")).alias("bbox"))
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    kind = rule_kind(w, h)
    return d.withColumn("orientation", kind).where("orientation is not null")


def rule_kind(width: Column, height: Column) -> Column:
    return F.when((height <= THIN) & (width >= LONG), "horizontal").when((width <= THIN) & (height >= LONG), "vertical")


def images(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.posexplode("blocks").alias("region_no", "b")).where("b.type = 1").select("doc_id", "page", "region_no", as_box(F.col("b.bbox")).alias("region"))


def links(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.posexplode("links").alias("link_no", "l")).where("l.uri is not null and l.rect is not null").select("doc_id", "page", "link_no", F.col("l.uri").alias("uri"), as_box(F.col("l.rect")).alias("rect"))
