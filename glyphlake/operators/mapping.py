"""Glyph numbers to characters: a join with the fonts' character maps, then a heuristic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.text import code_point


def map_glyphs(glyphs: DataFrame, cmap: DataFrame | None = None) -> DataFrame:
    """``glyphs`` with unicode and mapping_method.

    ``cmap`` (doc_id, page, font_name, glyph_id, unicode) has one row for each key; see
    ``cmap.page_cmap``.  Without an entry, printable ASCII and Latin-1 numbers are code points.
    Adaptive execution chooses the join by the maps' measured size.
    """
    plain = F.col("glyph_id").between(0x20, 0x7E) | F.col("glyph_id").between(0xA0, 0xFF)
    guess = F.when(plain, code_point(F.col("glyph_id")))
    if cmap is None:
        return glyphs.withColumns({"unicode": guess, "mapping_method": F.when(plain, F.lit("Heuristic")).otherwise(F.lit("Unmapped"))})
    keys = ["doc_id", "page", "font_name", "glyph_id"]
    side = cmap.select(*keys, F.col("unicode").alias("mapped"))
    method = F.when(F.col("mapped").isNotNull(), F.lit("ToUnicode")).when(plain, F.lit("Heuristic")).otherwise(F.lit("Unmapped"))
    return glyphs.join(side, keys, "left").withColumns({"unicode": F.coalesce("mapped", guess), "mapping_method": method}).drop("mapped")


def mapping_rate(glyphs: DataFrame, *keys: str) -> DataFrame:
    """n_glyphs and n_mapped for each key."""
    return glyphs.groupBy(*keys).agg(F.count("*").alias("n_glyphs"), F.count("unicode").alias("n_mapped"))
