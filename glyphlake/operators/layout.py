"""A fixed layout of plain text as positioned glyphs.

The layout gives text tables the shape of interpreted pages: a glyph for each character, at a
pitch of 6 points and a leading of 12, with a wider gap after every fifth line.  All coordinates
are whole numbers, so 32-bit floats hold them exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import PLAIN, Pages

FONT, FONT_SIZE, PITCH, LEADING, GROUP, GAP = "/F1", 10.0, 6, 12, 5, 18
LEFT, TOP = 72, 720


def glyphs_of_text(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The glyph relation of (doc_id, page, text).

    Texts are dealt by page before they are taken apart, so what is shuffled is text, a hundredth of
    the glyphs' bytes, and the windows of the later stages find their pages in place.  The number
    of partitions is fixed, as the small texts would else be gathered in a few tasks.
    """
    page = F.col("page") if "page" in docs.columns else F.lit(0)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", page.cast("int").alias("page"), "text").repartition(n, "doc_id", "page")
    lines = dealt.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    chars = lines.where("line <> ''").select("doc_id", "page", "ln", F.posexplode(F.split("line", "")).alias("i", "ch")).where("ch <> ''")
    fl = lambda c: c.cast("float")
    x, y = F.lit(LEFT) + PITCH * F.col("i"), F.lit(TOP) - LEADING * F.col("ln") - GAP * F.floor(F.col("ln") / GROUP)
    return chars.select(
        "doc_id", "page",
        # lines are below 2^31 and longer than no line has characters
        (F.col("ln").cast("bigint") * F.lit(1 << 31) + F.col("i")).alias("seq"),
        F.ascii("ch").cast("bigint").alias("glyph_id"), fl(x).alias("x"), fl(y).alias("y"), fl(x).alias("x0"), fl(y).alias("y0"), fl(x + PITCH).alias("x1"), fl(y + F.lit(FONT_SIZE)).alias("y1"),
        F.lit(FONT_SIZE).cast("float").alias("font_size"), F.lit(FONT).alias("font_name"),
    )


def pages_of_text(docs: DataFrame, plain: tuple = PLAIN) -> Pages:
    """The same layout as pages of ``packed``, from (doc_id, page, text); ``plain`` as there.

    Texts are dealt anew only where the input has fewer splits than the cluster needs, so a large
    table is read, laid out and clustered in the tasks of its scan, without any shuffle.
    """
    page = F.col("page") if "page" in docs.columns else F.lit(0)
    return Pages(spread(docs.select("doc_id", page.cast("int").alias("page"), "text")), "text", plain)


#: Partitions for each core that a small input is dealt into.
PER_CORE = 4


def spread(pages: DataFrame) -> DataFrame:
    """``pages``, dealt over the cluster where their bytes fill fewer splits than it has cores."""
    spark = pages.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return pages.repartition(PER_CORE * cores, "doc_id", "page") if size < PER_CORE * cores * split else pages


def stream_of_text(docs: DataFrame) -> DataFrame:
    """(doc_id, page, content): the content stream that shows the text in the same layout."""
    page = F.col("page") if "page" in docs.columns else F.lit(0)
    piece = lambda ln, line: F.concat(F.lit("1 0 0 1 72 "), (F.lit(TOP) - LEADING * ln - GAP * F.floor(ln / GROUP)).cast("string"), F.lit(" Tm ("), F.regexp_replace(line, r"([()\\])", r"\\$1"), F.lit(") Tj\n"))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda line, ln: F.when(line != "", piece(ln, line)).otherwise(F.lit(""))), "")
    return docs.select("doc_id", page.cast("int").alias("page"), F.encode(F.concat(F.lit("BT /F1 10 Tf\n"), body, F.lit("ET")), "ISO-8859-1").alias("content"))
