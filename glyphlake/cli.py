"""Command line: extract, xref, stream, mapping, render and debug over PDF files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphlake.operators import listing, paint, xref
from glyphlake.operators.content import content_ops
from glyphlake.operators.interpreter import pages as stream_pages
from glyphlake.plans.layout import PageLayout
from glyphlake.sources import pdf


def _layout(pages) -> PageLayout:
    return PageLayout(stream_pages(pages))


def extract(spark: SparkSession, path: str, pages: list[int] | None):
    """(path, page, text) of all pages; a blank page has empty text."""
    files = pdf.files(spark, path)
    found = stream_pages(pdf.parse(files, pages=pages, mode="FAILFAST")).rows("text", blank=True)
    return found.join(files.select("doc_id", "path"), "doc_id").select("path", "page", "text")


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="glyphlake")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("extract", "xref", "stream", "mapping", "render", "debug"):
        p = commands.add_parser(name)
        p.add_argument("path")
        if name != "xref":
            p.add_argument("--page", type=int, default=0)
        if name == "extract":
            p.add_argument("--all", action="store_true")
        if name == "xref":
            p.add_argument("--free", action="store_true")
        if name in ("render", "debug"):
            p.add_argument("--dpi", type=float, default=paint.SCALE if name == "render" else paint.OVERLAY_SCALE)
            p.add_argument("--out", default="page.png")
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("glyphlake").getOrCreate()
    if a.command == "extract":
        for r in extract(spark, a.path, None if a.all else [a.page]).orderBy("path", "page").toLocalIterator():
            print(f"-- {r.path} page {r.page}" + ("" if r.text else " (blank)"), file=sys.stderr)
            print(r.text)
    elif a.command == "xref":
        found = xref.entries(pdf.files(spark, a.path))
        for r in xref.dump(found, a.free).orderBy("doc_id", "obj").toLocalIterator():
            print(r.line)
        tails = xref.trailer_dump(xref.trailers(pdf.files(spark, a.path)))
        for r in tails.join(xref.summary(found), "doc_id", "left").orderBy("doc_id").toLocalIterator():
            print(f"\n{r.text}\n\n  {r.in_use or 0} in-use   {r.free or 0} free")
    elif a.command == "stream":
        for r in listing.rendered(listing.listing(content_ops(pdf.read(spark, a.path, pages=[a.page], mode="FAILFAST")))).toLocalIterator():
            print(r.text)
    elif a.command == "mapping":
        glyphs = _layout(pdf.read(spark, a.path, pages=[a.page], mode="FAILFAST")).glyphs
        for r in glyphs.groupBy("font_name", "glyph_id", "unicode", "mapping_method").count().orderBy("font_name", "glyph_id").toLocalIterator():
            print(f"{r.font_name}  {r.glyph_id:04X}  {r.unicode or '-'}  {r.mapping_method}  {r['count']}")
    else:
        pages = pdf.read(spark, a.path, pages=[a.page], mode="FAILFAST")
        if a.command == "render":
            row = paint.render(pages, a.dpi).first()
            if row is None or row.png is None:
                sys.exit(f"nothing to render below {a.path}")
            png = row.png
        else:
            layout, size = _layout(pages), pages.select("width", "height").first()
            if size is None:
                sys.exit(f"no files below {a.path}")
            boxes = {k: [tuple(r) for r in df.select("x0", "y0", "x1", "y1").collect()] for k, df in (("words", layout.words), ("lines", layout.lines), ("blocks", layout.blocks))}
            png = paint.render_overlay(size.width, size.height, boxes, a.dpi).png()
        with open(a.out, "wb") as out:
            out.write(png)
    return 0


if __name__ == "__main__":
    sys.exit(main())
