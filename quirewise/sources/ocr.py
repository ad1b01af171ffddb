"""Words of an OCR engine's tab-separated output, and the lines they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import hull
from ..functions.text import meaningful

# The output's columns, its resolution and the fewest characters of a page that needs no OCR.
TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
DPI, MINIMUM = 300, 20


def needs_ocr(text: Column) -> Column:
    return meaningful(F.coalesce(text, F.lit(""))) < MINIMUM


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", header=True, schema=TSV).withColumn("doc_id", F.input_file_name())


def words(tsv: DataFrame, dpi: int = DPI) -> DataFrame:
    """Level-5 rows with text, in points."""
    pt = lambda c: c * 72.0 / dpi
    w = tsv.where("level = 5").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    box = F.struct(pt(F.col("left")).alias("x0"), pt(F.col("top")).alias("y0"), pt(F.col("left") + F.col("width")).alias("x1"), pt(F.col("top") + F.col("height")).alias("y1"))
    return w.select("doc_id", F.col("page_num").alias("page"), "block_num", "par_num", "line_num", "word_num", F.trim("text").alias("text"), "conf", box.alias("bbox"))


def lines(words_df: DataFrame) -> DataFrame:
    """One line a (block, paragraph, line): words joined, median height as size, mean of known confidences."""
    keys = ["doc_id", "page", "block_num", "par_num", "line_num"]
    return words_df.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.median(F.col("bbox.y1") - F.col("bbox.y0")).alias("size"), F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("confidence"), hull().alias("bbox"),
    )
