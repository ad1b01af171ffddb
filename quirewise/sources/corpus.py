"""Scanning a folder of documents, and what is wrong with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Readers by suffix, and codes of what can be wrong.
READERS = {"docx": "docx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image"}
ERRORS = {"missing": 10, "unsupported": 11, "unreadable": 12, "encrypted": 20, "empty": 21, "no_ocr": 22, "no_model": 23, "failed": 30, "output": 40}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def reader_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for s, r in READERS.items():
        out = F.when(suffix(path) == s, r).otherwise(out)
    return out


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def output_path(path: Column, target: Column) -> Column:
    """A folder gets the document's stem in it; anything else is the file itself."""
    folder = target.endswith("/") | ~F.element_at(F.split(target, "/"), -1).contains(".")
    return F.when(folder, F.concat(F.rtrim(target, F.lit("/")), F.lit("/"), stem(path), F.lit(".json"))).otherwise(target)


def artifact_folder(output: Column) -> Column:
    """The output's path without its suffix; one without gets '-artifacts'."""
    bare = F.regexp_replace(output, r"\.[^./]*$", "")
    return F.when(bare == output, F.concat(output, F.lit("-artifacts"))).otherwise(bare)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the known kinds below a folder: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pdf,png,jpg,jpeg}").load(folder)


def checked(files: DataFrame, ocr_available: bool = True) -> DataFrame:
    """Files with reader, error and code; a bad one is a row of its own and stops no other."""
    head = F.col("content")
    lead = lambda n: F.hex(F.substring(head, 1, n))
    kind = reader_of(F.col("path"))
    opens = F.when(kind == "docx", lead(4) == "504B0304").when(kind == "pdf", lead(4) == "25504446").otherwise((lead(4) == "89504E47") | (lead(2) == "FFD8"))
    secret = (kind == "pdf") & F.decode(head, "ISO-8859-1").contains("/Encrypt")
    error = F.when(kind.isNull(), "unsupported").when(F.length(head) == 0, "empty").when(~opens, "unreadable").when(secret, "encrypted").when((kind == "image") & F.lit(not ocr_available), "no_ocr")
    code = F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv])
    return files.withColumn("reader", kind).withColumn("error", error).withColumn("code", F.when(F.col("error").isNotNull(), F.element_at(code, F.col("error"))))


def same_file(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, ok): size and then SHA-256 against what is expected (path, size, sha256)."""
    got = files.select("path", F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("h"))
    return expected.join(got, "path", "left").select("path", F.coalesce((F.col("size") == F.col("n")) & (F.col("sha256") == F.col("h")), F.lit(False)).alias("ok"))
