"""Character maps (ToUnicode programs) as rows.

The section of a line is set by its last word; entries before any section count for nothing.
A later entry for a glyph replaces an earlier one, so the join with glyphs never multiplies them.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.text import code_point, hex_character, hex_number, hex_tokens

_KEYS = ("doc_id", "page", "font_name")
_STARTS = {"beginbfchar": "char", "beginbfrange": "range"}
_ENDS = ("endbfchar", "endbfrange")


def entries(fonts: DataFrame) -> DataFrame:
    """(doc_id, page, font_name, ln, pos, glyph_id, unicode): all entries of (.., content)."""
    text = F.make_valid_utf8(F.col("content").cast("string")) if dict(fonts.dtypes)["content"] == "binary" else F.col("content")
    lines = fonts.select(*_KEYS, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("ln", "line"))
    last = F.element_at(F.split(F.btrim("line", F.lit(" \t\r\n\f")), r"\s+"), -1)
    mark = F.when(last == "beginbfchar", F.lit("char")).when(last == "beginbfrange", F.lit("range")).when(last.isin(*_ENDS), F.lit("none"))
    upto = Window.partitionBy(*_KEYS).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("mark", mark).withColumn("section", F.last("mark", ignorenulls=True).over(upto)).where("mark is null and section in ('char', 'range')")
    t = F.col("t")
    lines = lines.withColumn("t", hex_tokens(F.col("line"))).withColumn("lo", hex_number(F.get("t", F.lit(0)))).withColumn("array", F.instr("line", "[") > 0)
    single = lines.where("section = 'char' and size(t) >= 2").select(*_KEYS, "ln", F.lit(0).alias("pos"), F.col("lo").alias("glyph_id"), hex_character(F.get(t, F.lit(1))).alias("unicode"))
    ranges = lines.where("section = 'range' and size(t) >= 3").withColumn("hi", hex_number(F.get("t", F.lit(1))))
    listed = ranges.where("array").select(*_KEYS, "ln", "lo", "hi", F.posexplode(F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0)))).alias("pos", "token"))
    listed = listed.where("lo + pos <= hi").select(*_KEYS, "ln", "pos", (F.col("lo") + F.col("pos")).alias("glyph_id"), hex_character(F.col("token")).alias("unicode"))
    # the start of a run is a plain number; beyond the Unicode range it maps nothing and stops
    runs = ranges.where("not array").withColumn("first", hex_number(F.get("t", F.lit(2)))).where(F.col("first").isNotNull() & (F.col("lo") <= F.col("hi")))
    runs = runs.select(*_KEYS, "ln", "lo", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("hi") - F.col("lo"), F.lit(0x10FFFF) - F.least(F.col("first"), F.lit(0x10FFFF))))).alias("i"))
    runs = runs.select(*_KEYS, "ln", F.col("i").cast("int").alias("pos"), (F.col("lo") + F.col("i")).alias("glyph_id"), code_point(F.col("first") + F.col("i")).alias("unicode"))
    return single.unionByName(listed).unionByName(runs).where("unicode is not null")


def page_cmap(fonts: DataFrame) -> DataFrame:
    """(doc_id, page, font_name, glyph_id, unicode), one row for each glyph: the last entry."""
    return entries(fonts).groupBy(*_KEYS, "glyph_id").agg(F.max_by("unicode", F.struct("ln", "pos")).alias("unicode"))


_TOKEN = re.compile("<([^>]*)>")
_HEX = re.compile("[0-9A-Fa-f]+")


def _point(n: int) -> int:
    return n if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else -1


def _character(digits: str) -> int:
    n = int(digits, 16)
    if len(digits) in (2, 4):
        return _point(n)
    if len(digits) != 8:
        return -1
    high, low = n >> 16, n & 0xFFFF
    paired = 0xD800 <= high <= 0xDBFF and 0xDC00 <= low <= 0xDFFF
    return _point(0x10000 + ((high - 0xD800) << 10) + low - 0xDC00 if paired else n)


def code_table(program: bytes, size: int = 256) -> np.ndarray:
    """The code points of glyphs below ``size`` in a program, -1 for none; the rules of ``entries``.

    For glyphs that are single bytes a table in the page's own pass needs no join.
    """
    table = np.full(size, -1, np.int64)
    section = "none"
    for line in re.split(r"\r\n|\n|\r", program.decode("utf-8", "replace")):
        last = (re.split(r"[ \t\n\x0b\f\r]+", line.strip(" \t\r\n\f")) or [""])[-1]
        mark = _STARTS.get(last) or ("none" if last in _ENDS else None)
        if mark is not None:
            section = mark
            continue
        if section == "none":
            continue
        tokens = [t for t in (x.strip(" \t\r\n\f") for x in _TOKEN.findall(line)) if _HEX.fullmatch(t)]
        tokens = [t if len(t) % 2 == 0 else f"0{t}" for t in tokens]
        given: list[tuple[int, int]] = []
        if section == "char" and len(tokens) >= 2:
            given = [(int(tokens[0], 16), _character(tokens[1]))]
        elif section == "range" and len(tokens) >= 3:
            low, high, first = (int(t, 16) for t in tokens[:3])
            if max(low, high) >= 1 << 63:  # beyond the numbers of rows
                continue
            if "[" in line:
                given = [(low + i, _character(t)) for i, t in enumerate(tokens[2:]) if low + i <= high]
            else:
                given = [(n, _point(first + n - low)) for n in range(low, min(high, size - 1) + 1)]
        for n, point in given:
            if n < size and point >= 0:
                table[n] = point
    return table
