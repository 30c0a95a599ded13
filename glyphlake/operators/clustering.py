"""Glyphs to words, lines and blocks.

Everything is keyed by (doc_id, page).  Words come from whole pages by ``packed``; lines and blocks
are windows and groupings over the rows of the stage before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.geometry import bounds

from .packed import BLOCK_GAP, PAGE, line_anchors, pack


def _float(v: float):
    return F.lit(v).cast("float")


def visible(glyphs: DataFrame) -> DataFrame:
    """Glyphs with a positive size and a number other than 0."""
    return glyphs.where("font_size > 0 and glyph_id <> 0")


def _anchors(ys: pa.Array) -> pa.Array:
    """The anchor of each height in the lists ``ys``, in the lists' own order."""
    sizes = pc.list_value_length(ys).to_numpy(zero_copy_only=False)
    at, y = np.repeat(np.arange(len(ys)), sizes), ys.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((-y, at))
    out = np.empty_like(y)
    out[order] = line_anchors(at[order], y[order])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out, pa.float32()))


def with_lines(glyphs: DataFrame) -> DataFrame:
    """Visible glyphs with ``anchor``, the y of the first glyph of their line.

    From the top down a glyph joins the line if its y is within the tolerance of the line's first
    y.  One shuffle gathers pages; the rule itself is ``packed.line_anchors``.
    """
    columns = glyphs.columns
    paged = visible(glyphs).groupBy(*PAGE).agg(F.collect_list(F.struct(*(c for c in columns if c not in PAGE))).alias("gs"))
    anchors = F.arrow_udf(_anchors, "array<float>")(F.transform("gs", lambda g: g["y"]))
    flat = paged.withColumn("anchors", anchors).select(*PAGE, "anchors", F.posexplode("gs").alias("i", "g")).select(*PAGE, "g.*", F.get("anchors", F.col("i")).alias("anchor"))
    return flat.select(*columns, "anchor")


def words(glyphs: DataFrame) -> DataFrame:
    """doc_id, page, line_no, word_no, text, x0, y0, x1, y1, n_glyphs, max_font_size, baseline_y.

    ``line_no`` counts the lines that keep a word, from the top; ``word_no`` the words in a line.
    """
    return pack(glyphs).rows("words")


def lines(found: DataFrame) -> DataFrame:
    """From words: line_no, block_no, baseline_y, the box, n_words, max_font_size and text.

    A block begins where the step to the line above exceeds the gap for that line's font size.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ")
    line = found.groupBy(*PAGE, "line_no").agg(F.first("baseline_y").alias("baseline_y"), *bounds(), F.count("*").alias("n_words"), F.max("max_font_size").alias("max_font_size"), text.alias("text"))
    down = Window.partitionBy(*PAGE).orderBy("line_no")
    step = F.abs((F.lag("baseline_y").over(down) - F.col("baseline_y")).cast("float"))
    reach = (F.greatest(F.lag("max_font_size").over(down), _float(1.0)) * _float(BLOCK_GAP)).cast("float")
    line = line.withColumn("breaks", F.coalesce((step > reach).cast("int"), F.lit(0)))
    return line.withColumn("block_no", F.sum("breaks").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("breaks")


def blocks(found: DataFrame) -> DataFrame:
    """From lines: block_no, n_lines, the box and text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return found.groupBy(*PAGE, "block_no").agg(F.count("*").alias("n_lines"), *bounds(), text.alias("text"))
