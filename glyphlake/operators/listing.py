"""Annotated listings of content streams, one row for each operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.text import pdf_string, trimmed_real

# The operators of content streams in the order of the format's own summary: the names that a note
# gives to their operands, and what they do.
OPERATORS = {
    "b": ("", "close, fill and stroke path by the nonzero winding number rule"),
    "B": ("", "fill and stroke path by the nonzero winding number rule"),
    "b*": ("", "close, fill and stroke path by the even-odd rule"),
    "B*": ("", "fill and stroke path by the even-odd rule"),
    "BDC": ("tag", "begin marked-content sequence with property list"),
    "BI": ("", "begin inline image object"),
    "BMC": ("tag", "begin marked-content sequence"),
    "BT": ("", "begin text object"),
    "BX": ("", "begin compatibility section"),
    "c": ("x1 y1 x2 y2 x3 y3", "append curve of three control points"),
    "cm": ("a b c d e f", "concatenate matrix to current transformation matrix"),
    "CS": ("space", "set color space for stroking"),
    "cs": ("space", "set color space for other painting"),
    "d": ("", "set line dash pattern"),
    "d0": ("wx wy", "set glyph width in Type 3 font"),
    "d1": ("wx wy llx lly urx ury", "set glyph width and bounding box in Type 3 font"),
    "Do": ("object", "invoke named XObject"),
    "DP": ("tag", "define marked-content point with property list"),
    "EI": ("", "end inline image object"),
    "EMC": ("", "end marked-content sequence"),
    "ET": ("", "end text object"),
    "EX": ("", "end compatibility section"),
    "f": ("", "fill path by the nonzero winding number rule"),
    "F": ("", "fill path by the nonzero winding number rule (obsolete)"),
    "f*": ("", "fill path by the even-odd rule"),
    "G": ("gray", "set gray level for stroking"),
    "g": ("gray", "set gray level for other painting"),
    "gs": ("state", "set parameters from graphics state dictionary"),
    "h": ("", "close subpath"),
    "i": ("flatness", "set flatness tolerance"),
    "ID": ("", "begin inline image data"),
    "j": ("join", "set line join style"),
    "J": ("cap", "set line cap style"),
    "K": ("c m y k", "set CMYK color for stroking"),
    "k": ("c m y k", "set CMYK color for other painting"),
    "l": ("x y", "append straight line segment to path"),
    "m": ("x y", "begin new subpath"),
    "M": ("limit", "set miter limit"),
    "MP": ("tag", "define marked-content point"),
    "n": ("", "end path without filling or stroking"),
    "q": ("", "save graphics state"),
    "Q": ("", "restore graphics state"),
    "re": ("x y w h", "append rectangle to path"),
    "RG": ("r g b", "set RGB color for stroking"),
    "rg": ("r g b", "set RGB color for other painting"),
    "ri": ("intent", "set color rendering intent"),
    "s": ("", "close and stroke path"),
    "S": ("", "stroke path"),
    "SC": ("", "set color for stroking"),
    "sc": ("", "set color for other painting"),
    "SCN": ("", "set color or pattern for stroking"),
    "scn": ("", "set color or pattern for other painting"),
    "sh": ("shading", "paint area by shading pattern"),
    "T*": ("", "move to start of next text line"),
    "Tc": ("spacing", "set character spacing"),
    "Td": ("dx dy", "move text position"),
    "TD": ("dx dy", "move text position and set leading"),
    "Tf": ("font size", "set text font and size"),
    "Tj": ("", "show text"),
    "TJ": ("", "show text with glyph positions"),
    "TL": ("leading", "set text leading"),
    "Tm": ("a b c d x y", "set text matrix and text line matrix"),
    "Tr": ("mode", "set text rendering mode"),
    "Ts": ("rise", "set text rise"),
    "Tw": ("spacing", "set word spacing"),
    "Tz": ("percent", "set horizontal text scaling"),
    "v": ("x2 y2 x3 y3", "append curve whose first control point is the current one"),
    "w": ("width", "set line width"),
    "W": ("", "set clipping path by the nonzero winding number rule"),
    "W*": ("", "set clipping path by the even-odd rule"),
    "y": ("x1 y1 x3 y3", "append curve whose last control point is its end"),
    "'": ("", "move to next line and show text"),
    '"': ("", "set spacing, move to next line and show text"),
}
#: The operand that holds the text of operators that show one.
SHOWN = {"Tj": 0, "'": 0, '"': 2}
UNKNOWN = "(unknown operator)"


def operand_text(o: Column, nested: bool = True) -> Column:
    """An operand as it is written; reals with four decimals at most."""
    tag = o["tag"]
    text = F.when(tag == "integer", F.coalesce(o["num"].try_cast("bigint").cast("string"), o["num"].cast("string"))).when(tag == "real", trimmed_real(o["num"])).when(tag == "boolean", F.when(o["num"] == 1, F.lit("true")).otherwise(F.lit("false")))
    text = text.when(tag == "name", F.concat(F.lit("/"), F.make_valid_utf8(o["bytes"].cast("string")))).when(tag == "string", F.concat(F.lit("("), pdf_string(o["bytes"]), F.lit(")")))
    if nested:
        text = text.when(tag == "array", F.concat(F.lit("["), F.array_join(F.transform(o["items"], lambda x: operand_text(x, False)), " "), F.lit("]")))
    return text.when(tag == "dictionary", F.lit("{dict}")).when(tag == "reference", F.lit("{reference}")).when(tag == "array", F.lit("[]")).otherwise(F.lit("null"))


def _known(part: int) -> Column:
    """A field of OPERATORS for each row's operator; null for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(v) for op, row in OPERATORS.items() for v in (op, row[part]))), F.col("operator"))


def _note() -> Column:
    """The operands by their names, or the text that is shown."""
    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    names = F.split(F.nullif(_known(0), F.lit("")), " ")
    named = F.when(F.size("texts") >= F.size(names), F.array_join(F.transform(names, lambda name, i: F.concat(name, F.lit("="), F.get("texts", i))), "  "))
    at = F.try_element_at(F.create_map(*(F.lit(v) for pair in SHOWN.items() for v in pair)), F.col("operator"))
    text = F.get("operands", at)
    first = F.get("operands", F.lit(0))
    pieces = F.array_join(F.transform(F.filter(first["items"], lambda x: x["tag"] == "string"), lambda x: pdf_string(x["bytes"])), "")
    return F.when(text["tag"] == "string", quoted(pdf_string(text["bytes"]))).when((F.col("operator") == "TJ") & (first["tag"] == "array"), quoted(pieces)).otherwise(named)


def listing(ops: DataFrame) -> DataFrame:
    """doc_id, page, line_no, tree, command, description, note from ``content.content_ops``.

    ``tree`` draws text objects: their first and last operation and what lies between.
    """
    ops = ops.withColumn("texts", F.transform("operands", lambda o: operand_text(o)))
    before = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("operator") == "BT", F.lit(True)).when(F.col("operator") == "ET", F.lit(False))
    ops = ops.withColumn("mark", mark).withColumn("inside", F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(False)))
    tree = F.when(F.col("operator") == "BT", F.lit("┌ ")).when(F.col("operator") == "ET", F.lit("└ ")).when(F.col("inside"), F.lit("│   ")).otherwise(F.lit("  "))
    command = F.when(F.size("texts") > 0, F.concat(F.array_join("texts", " "), F.lit(" "), F.col("operator"))).otherwise(F.col("operator"))
    described = F.coalesce(_known(1), F.lit(UNKNOWN))
    return ops.select("doc_id", "page", (F.col("seq") + 1).alias("line_no"), tree.alias("tree"), command.alias("command"), described.alias("description"), F.coalesce(_note(), F.lit("")).alias("note"))


def rendered(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): a whole listing as one string."""
    line = F.concat(F.format_string("  %4d  %-52s  ", F.col("line_no"), F.concat("tree", "command")), F.col("description"), F.when(F.col("note") != "", F.concat(F.lit("  → "), F.col("note"))).otherwise(F.lit("")))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
