"""Documents as they arrive: an addition for unattended folders. Each file stands alone, so nothing is kept
between batches but which files were seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.docx import read_docx

FILES = "path string, modificationTime timestamp, length long, content binary"


def incoming_docx(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return read_docx(files)


def write_lines(lines: DataFrame, target: str, checkpoint: str):
    """Starts writing lines as Parquet; the checkpoint makes each file count once."""
    return lines.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
