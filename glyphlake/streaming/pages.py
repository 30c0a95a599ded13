"""The page pipeline on streams of files.

A page depends on nothing but itself, so parsing, interpreting, mapping and layout of a file are one
stateless pass over each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from glyphlake.operators.interpreter import pages
from glyphlake.plans.layout import PageLayout
from glyphlake.sources import pdf


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, path, length, content) of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def stream_text(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, strict: bool = True) -> DataStreamWriter:
    """A writer that hands the page text of each micro-batch to ``sink``.

    The sink gets the batch's number and must write idempotently by it for exactly-once results.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(PageLayout(pages(pdf.parse(batch, strict=strict))).text, number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
