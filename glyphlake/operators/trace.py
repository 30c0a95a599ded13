"""Events and overlays of the page pipeline as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import PAGE
from .packed import Pages

# The stroke of each layer.
STROKES = {"glyphs": "#4488ff", "words": "#44bb44", "lines": "#ff8800", "blocks": "#cc0000"}
OPACITY = {"glyphs": "0.35", "words": "0.45", "lines": "0.50", "blocks": "0.60"}


def _width(a: str, b: str) -> Column:
    return (F.col(b) - F.col(a)).cast("float")


def events(glyphs: DataFrame, words: DataFrame, lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, stage, seq, payload): one JSON object for each event of the pipeline."""
    row = lambda df, stage, seq, *cols: df.select(*PAGE, F.lit(stage).alias("stage"), seq.cast("bigint").alias("seq"), F.to_json(F.struct(F.lit(stage).alias("stage"), *cols), {"ignoreNullFields": "false"}).alias("payload"))
    word_no = F.col("line_no") * F.lit(1 << 20) + F.col("word_no")
    found = [
        row(glyphs, "glyph", F.col("seq"), F.col("glyph_id").alias("id"), "unicode", F.col("mapping_method").alias("method"), F.col("font_name").alias("font"), "x", "y"),
        row(glyphs, "mapping", F.col("seq"), "glyph_id", "unicode", F.col("mapping_method").alias("method")),
        row(words, "word", word_no, "text", F.col("x0").alias("x"), F.col("y0").alias("y"), _width("x0", "x1").alias("w"), _width("y0", "y1").alias("h")),
        row(lines, "line", F.col("line_no"), F.col("n_words").alias("words"), F.col("baseline_y").alias("baseline")),
        row(blocks, "block", F.col("block_no"), F.col("n_lines").alias("lines"), F.col("reading_order").alias("order")),
    ]
    order = blocks.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "block_no"))), lambda b: b["block_no"]).alias("order"))
    out = found[0]
    for df in [*found[1:], row(order, "reading_order", F.lit(0), "order")]:
        out = out.unionByName(df)
    return out


def rects(df: DataFrame, layer: str, seq: Column) -> DataFrame:
    """(doc_id, page, layer, seq, rect): an SVG rectangle for each box."""
    shape = F.format_string(f'<rect x="%.1f" y="%.1f" width="%.1f" height="%.1f" fill="none" stroke="{STROKES[layer]}" stroke-width="0.5"/>', F.col("x0").cast("double"), F.col("y0").cast("double"), _width("x0", "x1").cast("double"), _width("y0", "y1").cast("double"))
    return df.select(*PAGE, F.lit(layer).alias("layer"), seq.cast("bigint").alias("seq"), shape.alias("rect"))


def page_events(pages: Pages) -> DataFrame:
    """The rows of ``events`` from pages, in one pass over them."""

    def of(column: str, stage: str, seq, *fields) -> Column:
        payload = lambda r: F.to_json(F.struct(F.lit(stage).alias("stage"), *(f(r).alias(n) for n, f in fields)), {"ignoreNullFields": "false"})
        return F.transform(column, lambda r: F.struct(F.lit(stage).alias("stage"), seq(r).cast("bigint").alias("seq"), payload(r).alias("payload")))

    field = lambda name: lambda r: r[name]
    wide = lambda a, b: lambda r: (r[b] - r[a]).cast("float")
    order = F.transform(F.array_sort(F.transform("blocks", lambda b: F.struct(b["reading_order"].alias("o"), b["block_no"].alias("n")))), lambda b: b["n"])
    ordered = F.struct(F.lit("reading_order").alias("stage"), F.lit(0).cast("bigint").alias("seq"), F.to_json(F.struct(F.lit("reading_order").alias("stage"), order.alias("order"))).alias("payload"))
    every = F.concat(
        of("glyphs", "glyph", field("seq"), ("id", field("glyph_id")), ("unicode", field("unicode")), ("method", field("mapping_method")), ("font", field("font_name")), ("x", field("x")), ("y", field("y"))),
        of("glyphs", "mapping", field("seq"), ("glyph_id", field("glyph_id")), ("unicode", field("unicode")), ("method", field("mapping_method"))),
        of("words", "word", lambda r: r["line_no"] * F.lit(1 << 20) + r["word_no"], ("text", field("text")), ("x", field("x0")), ("y", field("y0")), ("w", wide("x0", "x1")), ("h", wide("y0", "y1"))),
        of("lines", "line", field("line_no"), ("words", field("n_words")), ("baseline", field("baseline_y"))),
        of("blocks", "block", field("block_no"), ("lines", field("n_lines")), ("order", field("reading_order"))),
        F.when(F.size("blocks") > 0, F.array(ordered)).otherwise(F.array().cast("array<struct<stage:string,seq:bigint,payload:string>>")),
    )
    return pages.rows("nested").select(*PAGE, F.inline(every))


def documents(found: DataFrame) -> DataFrame:
    """(doc_id, page, trace): the events of a page as one JSON document, stage by stage."""
    stages = F.array(*map(F.lit, ("glyph", "mapping", "word", "line", "block", "reading_order")))
    each = F.struct(F.array_position(stages, F.col("stage")).alias("place"), "seq", "payload")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda e: e["payload"]), ",")
    return found.groupBy(*PAGE).agg(F.concat(F.lit('{"events":['), listed, F.lit("]}")).alias("trace"))


def order_note(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, layer, seq, rect): the reading order as a remark, the overlay's last layer."""
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "block_no"))), lambda b: b["block_no"].cast("string")), ", ")
    return blocks.groupBy(*PAGE).agg(F.concat(F.lit("<!-- order: ["), order, F.lit("] -->")).alias("rect")).select(*PAGE, F.lit("order").alias("layer"), F.lit(0).cast("bigint").alias("seq"), "rect")


def svg(parts: DataFrame, width: float, height: float) -> DataFrame:
    """(doc_id, page, svg): the layers of a page in one picture, turned to y downwards.

    ``parts`` are rows of ``rects`` and ``order_note``.
    """
    body = lambda layer: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("layer") == layer, F.struct("seq", "rect")))), lambda r: r["rect"]), "")
    groups = [F.concat(F.lit(f'<g id="{k}" opacity="{OPACITY[k]}">'), body(k), F.lit("</g>")) for k in STROKES]
    groups.append(F.concat(F.lit('<g id="order">'), body("order"), F.lit("</g>")))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" viewBox="0 0 {width:g} {height:g}"><g transform="translate(0,{height:g}) scale(1,-1)">'
    return parts.groupBy(*PAGE).agg(F.concat(F.lit(head), *groups, F.lit("</g></svg>")).alias("svg"))
