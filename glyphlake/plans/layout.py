"""The page pipeline: glyphs to words, lines, blocks, reading order and text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from glyphlake.operators.mapping import map_glyphs
from glyphlake.operators.packed import Pages, pack


@dataclass(frozen=True)
class PageLayout:
    """All stages over pages; each stage is a lazy DataFrame.

    ``raw`` is a table of pages (``layout.pages_of_text``, ``interpreter.pages``), whose stages are
    one pass each, or the flat glyph relation (doc_id, page, seq, glyph_id, x, y, x0, y0, x1, y1,
    font_size, font_name), with unicode and mapping_method where it has been mapped already, which
    is first gathered by page.
    """

    raw: DataFrame | Pages
    cmap: DataFrame | None = None

    @cached_property
    def glyphs(self) -> DataFrame:
        if isinstance(self.raw, Pages):
            return self.pages.rows("glyphs")
        return self.raw if "unicode" in self.raw.columns else map_glyphs(self.raw, self.cmap)

    @cached_property
    def pages(self) -> Pages:
        if not isinstance(self.raw, Pages):
            return pack(self.glyphs)
        return self.raw if self.cmap is None else self.raw.with_cmap(self.cmap)

    @cached_property
    def words(self) -> DataFrame:
        return self.pages.rows("words")

    @cached_property
    def lines(self) -> DataFrame:
        return self.pages.rows("lines")

    @cached_property
    def blocks(self) -> DataFrame:
        return self.pages.rows("blocks")

    @cached_property
    def text(self) -> DataFrame:
        return self.pages.rows("text")
