"""Files, cross-reference tables, listings, traces, painting, streams and the command line."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import text as T
from glyphlake.operators import listing, paint, trace, xref
from glyphlake.operators.cmap import page_cmap
from glyphlake.operators.content import content_ops
from glyphlake.operators.interpreter import interpret
from glyphlake.operators.interpreter import pages as stream_pages
from glyphlake.operators.truetype import TrueType
from glyphlake.plans.layout import PageLayout
from glyphlake.sources import pdf
from glyphlake.streaming import pages as streaming

MINIMAL = b"xref\n0 2\n0000000000 65535 f\r\n0000000015 00000 n\r\ntrailer\n<< /Size 2 /Root 1 0 R >>\nstartxref\n0\n%%EOF"
SECTIONS = b"xref\n0 1\n0000000000 65535 f\r\n2 1\n0000000042 00000 n\r\ntrailer\n<< /Size 3 /Root 2 0 R /Info 2 0 R /Prev 1234 >>\nstartxref\n0\n%%EOF"
STREAM = b"BT /F1 12 Tf 72 720 Td (Hello PDF) Tj ET"


def files(spark, *contents):
    return spark.createDataFrame([(i, f"{i}.pdf", c) for i, c in enumerate(contents)], "doc_id long, path string, content binary")


def pages(spark, *contents):
    return spark.createDataFrame([(i, 0, c, 100.0, 50.0) for i, c in enumerate(contents)], "doc_id long, page int, content binary, width float, height float")


def test_xref(spark):
    df = files(spark, MINIMAL, SECTIONS, b"not a pdf", b"startxref\nx")
    found = {(r.doc_id, r.obj): tuple(r)[2:] for r in xref.entries(df).collect()}
    assert found == {(0, 0): (65535, "free", None, 0), (0, 1): (0, "in-use", 15, None), (1, 0): (65535, "free", None, 0), (1, 2): (0, "in-use", 42, None)}
    heads = {r.doc_id: tuple(r)[1:] for r in xref.trailers(df).collect()}
    assert heads == {0: (0, 2, 1, 0, None, None, None), 1: (0, 3, 2, 0, 2, 0, 1234)}
    errors = {r.doc_id: r.error for r in xref.located(df).collect()}
    assert errors == {0: None, 1: None, 2: "no startxref", 3: "no startxref"}
    lines = [r.line for r in xref.dump(xref.entries(df)).collect()]
    assert len(lines) == 2 and all("in-use" in x for x in lines)


def test_file_round_trip(spark):
    cmap = b"1 beginbfchar\n<48> <6A21>\nendbfchar"
    parsed = pdf.parse(files(spark, pdf.build([STREAM, b"BT /F1 9 Tf (two) Tj ET"], cmap), pdf.build([STREAM], compress=False), b"junk"))
    rows = {(r.doc_id, r.page): r for r in parsed.collect()}
    assert rows[0, 0].content == STREAM and rows[1, 0].content == STREAM
    assert (rows[0, 0].width, rows[0, 0].height) == (612, 792)
    assert rows[2, None].error == "no startxref"
    text = PageLayout(interpret(parsed.where("error is null")), page_cmap(pdf.unicode_programs(parsed))).text
    assert {(r.doc_id, r.page): r.text for r in text.collect()} == {(0, 0): "模ello PDF", (0, 1): "two", (1, 0): "Hello PDF"}
    assert {r.doc_id: r.n_pages for r in pdf.page_counts(parsed).collect()} == {0: 2, 1: 1, 2: 0}
    assert [r.page for r in pdf.parse(files(spark, pdf.build([b"q", b"Q", b"n"])), pages=[1]).collect()] == [1]
    with pytest.raises(Exception, match="no startxref"):
        pdf.parse(files(spark, b"junk"), mode="FAILFAST").collect()


def test_fonts_and_sizes(spark):
    body = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>",
        b"<< /Type /Page /MediaBox [0 0 0 9] /Contents [5 0 R 5 0 R] /Resources << /Font << /T3 4 0 R /TT 6 0 R /Id 9 0 R /No 42 0 R >> >> >>",
        b"<< /Subtype /Type3 /FontMatrix [0.1 0 0 0.1 0 0] /Encoding << /Differences [65 /a /b 255 /c /d] >> /CharProcs << /a 5 0 R /c 5 0 R >> /FirstChar 65 /Widths [7 8] >>",
        b"<< /Length 2 >>\nstream\nq \nendstream", b"<< /Subtype /TrueType /FontDescriptor 7 0 R >>", b"<< /FontFile2 8 0 R >>", b"<< /Length 3 >>\nstream\nabc\nendstream",
        b"<< /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] >>",
    ]
    data = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, b) for i, b in enumerate(body, 1))
    data += b"xref\n0 0\ntrailer\n<< /Size 9 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % len(data)
    parsed = pdf.parse(files(spark, data))
    row = parsed.first()
    assert (row.width, row.height, row.content) == (595, 842, b"q \nq ")
    fonts = {r.font_name: r for r in pdf.page_fonts(parsed).collect()}
    assert fonts["/T3"].char_procs == {65: b"q ", 255: b"q "} and fonts["/T3"].widths == {65: 7, 66: 8}
    assert (fonts["/TT"].program, fonts["/TT"].two_byte, fonts["/Id"].program, fonts["/Id"].two_byte) == (b"abc", False, b"abc", True)
    assert fonts["/No"].kind == "unsupported"


def test_listing(spark):
    found = listing.rendered(listing.listing(content_ops(pages(spark, STREAM, b"100 200.5 300 400 re f 1 0 0 rg q Q [(Hel) -20 (lo)] TJ zz", b"\xff\x00(")))).orderBy("doc_id").collect()
    assert "┌ BT" in found[0].text and "└ ET" in found[0].text and '"Hello PDF"' in found[0].text and "font=/F1  size=12" in found[0].text
    assert "x=100  y=200.5  w=300  h=400" in found[1].text and '"Hello"' in found[1].text and "r=1  g=0  b=0" in found[1].text and "(unknown operator)" in found[1].text
    assert [line.split()[0] for line in found[1].text.split("\n")] == [str(i) for i in range(1, 8)]


def test_pdf_strings(spark):
    raw = [(b"\xfe\xff\x4e\x2d",), ("é".encode(),), (b"\xe9",), (b"",)]
    assert [r[0] for r in spark.createDataFrame(raw, "b binary").select(T.pdf_string(F.col("b"))).collect()] == ["中", "é", "é", ""]
    reals = [(12.0, "12"), (0.5, "0.5"), (3.14159, "3.1416"), (100.0, "100"), (0.0, "0")]
    assert [r[0] for r in spark.createDataFrame(reals, "v double, w string").select(T.trimmed_real(F.col("v"))).collect()] == [w for _, w in reals]


def test_trace_and_svg(spark):
    p = PageLayout(interpret(pages(spark, STREAM)))
    events = trace.events(p.glyphs, p.words, p.lines, p.blocks).collect()
    stages = [e.stage for e in events]
    assert {s: stages.count(s) for s in set(stages)} == {"glyph": 9, "mapping": 9, "word": 2, "line": 1, "block": 1, "reading_order": 1}
    word = json.loads(next(e.payload for e in events if e.stage == "word"))
    assert set(word) == {"stage", "text", "x", "y", "w", "h"}
    parts = trace.rects(p.words, "words", F.col("word_no")).unionByName(trace.rects(p.blocks, "blocks", F.col("block_no")))
    svg = trace.svg(parts, 612, 792).first().svg
    assert svg.count("<rect") == 3 and 'id="words"' in svg and svg.index("#44bb44") < svg.index("#cc0000")


def test_parse_events_and_overlays(spark):
    found = xref.parse_events(files(spark, MINIMAL, b"junk")).orderBy("seq").collect()
    assert [(r.doc_id, r.event) for r in found] == [(0, "StartXRef"), (0, "XRefEntry"), (0, "XRefEntry"), (0, "Trailer")]
    assert json.loads(found[2].payload) == {"obj": 1, "gen": 0, "kind": "in-use", "offset": 15}
    sizes = pages(spark, b"BT /F1 12 Tf 10 20 Td (Hello) Tj ET", b"")
    p = PageLayout(interpret(sizes))
    made = {r.doc_id: bytes(r.png) for r in paint.overlays(sizes, words=p.words, lines=p.lines, blocks=p.blocks).collect()}
    assert set(made) == {0, 1} and made[0] != made[1] and made[1].startswith(b"\x89PNG")


def test_paint(spark):
    found = paint.paint_paths(pages(spark, b"0.5 g 10 10 20 5 re f* 0 0 0 1 k 1 0 0 RG 2 w 0 0 m 10 0 l 10 10 l s n 5 5 m f", b"/P scn 1 2 scn 0 0 m 1 1 2 2 3 3 c 4 4 5 5 v 6 6 7 7 y h B W n")).orderBy("doc_id", "seq").collect()
    assert [(r.operator, r.even_odd, r.fill, r.stroke) for r in found[:2]] == [("f*", True, [0.5] * 3, None), ("s", False, None, [1, 0, 0])]
    assert (found[0].x0, found[0].y0, found[0].x1, found[0].y1, found[1].width) == (10, 10, 30, 15, 2)
    assert found[2].operator == "B" and found[2].x1 == 7
    png = paint.render(pages(spark, b"1 0 0 rg 0 0 50 25 re f"), 1.0).first()
    assert (png.width, png.height, bytes(png.png[:4])) == (100, 50, b"\x89PNG")


def test_pixels():
    page = paint.render_page(10, 10, b"1 0 0 rg 0 0 5 5 re f 0 0 1 RG 2 w 0 9 m 10 9 l S", scale=1.0).pixels
    assert page[9, 0].tolist() == [255, 0, 0] and page[0, 9].tolist() == [0, 0, 255] and page[4, 9].tolist() == [255] * 3
    font = {"/T": {"kind": "type3", "font_matrix": [1, 0, 0, 1, 0, 0], "char_procs": {65: b"0 0 1 1 re f"}, "widths": {65: 2.0}}}
    glyphs = paint.render_page(10, 10, b"BT /T 2 Tf 0 1 0 rg (AA) Tj ET", font, scale=1.0).pixels
    assert glyphs[9, 0].tolist() == [0, 255, 0] and glyphs[9, 2].tolist() == [255] * 3 and glyphs[9, 4].tolist() == [0, 255, 0]
    ring = paint.render_page(10, 10, b"0 0 9 9 re 3 3 3 3 re f*", scale=1.0).pixels
    assert ring[5, 4].tolist() == [255] * 3 and ring[9, 0].tolist() == [0, 0, 0]
    assert paint.render_page(0, 10, b"") is None
    over = paint.render_overlay(10, 10, {"words": [(1, 1, 5, 5)], "blocks": [(0, 0, 9, 9)]})
    assert over.pixels.shape == (15, 15, 3) and over.png().startswith(b"\x89PNG")


def font_program():
    """A font of two glyphs: a square with a hole's worth of curve, and that glyph moved."""
    flags = bytes([1, 1, 1, 0, 1])
    points = [(0, 0), (100, 0), (100, 100), (50, 150), (0, 100)]
    steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip([(0, 0), *points], points, strict=False)]
    simple = struct.pack(">hhhhh", 1, 0, 0, 100, 150) + struct.pack(">HH", 4, 0) + flags + b"".join(struct.pack(">h", x) for x, _ in steps) + b"".join(struct.pack(">h", y) for _, y in steps)
    simple += b"\0" * (-len(simple) % 4)
    moved = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHhh", 1 | 2, 0, 200, 0)
    moved += b"\0" * (-len(moved) % 4)
    head = b"\0" * 18 + struct.pack(">H", 1000) + b"\0" * 30 + struct.pack(">hh", 1, 0)
    tables = {b"glyf": simple + moved, b"head": head, b"loca": struct.pack(">LLL", 0, len(simple), len(simple) + len(moved))}
    at, heads, body = 12 + 16 * len(tables), b"", b""
    for tag, data in tables.items():
        heads += struct.pack(">4sLLL", tag, 0, at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return struct.pack(">LHHHH", 0x10000, len(tables), 0, 0, 0) + heads + body


def test_truetype():
    font = TrueType(font_program())
    start, steps = font.outline(0)[0]
    assert font.units_per_em == 1000 and start == (0, 0)
    assert steps == [(None, (100, 0)), (None, (100, 100)), ((50, 150), (0, 100)), (None, (0, 0))]
    assert font.outline(1)[0][0] == (200, 0) and font.outline(7) == [] and TrueType(b"x").outline(0) == []
    fonts = paint.fonts_by_name([{"font_name": "/F", "kind": "truetype", "two_byte": True, "font_matrix": None, "char_procs": None, "widths": None, "program": font_program()}])
    pixels = paint.render_page(30, 30, b"BT /F 100 Tf 1 0 0 rg <00000001> Tj ET", fonts, scale=1.0).pixels
    assert pixels[29, 5].tolist() == [255, 0, 0] and pixels[29, 15].tolist() == [255] * 3
    assert 0 < pixels[18, 5, 1] < 255 or pixels[18, 5].tolist() == [255, 0, 0]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(pdf.build([STREAM]))
    (tmp_path / "in/b.pdf").write_bytes(b"junk")
    seen = []
    q = streaming.stream_text(streaming.stream_files(spark, f"{tmp_path}/in"), lambda df, n: seen.extend(df.collect()), f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.text for r in seen] == ["Hello PDF"]


def test_files_and_command_line(spark, tmp_path, capsys):
    from glyphlake import cli

    (tmp_path / "a.pdf").write_bytes(pdf.build([STREAM, b""]))
    found = cli.extract(spark, str(tmp_path), None).orderBy("page").collect()
    assert [r.text for r in found] == ["Hello PDF", ""]
    for command in (["extract", "--all"], ["xref", "--free"], ["stream"], ["mapping"], ["render", "--dpi", "0.2", "--out", f"{tmp_path}/r.png"], ["debug", "--dpi", "0.2", "--out", f"{tmp_path}/d.png"]):
        assert cli.main([command[0], str(tmp_path), *command[1:]]) == 0
    out = capsys.readouterr().out
    assert "Hello PDF" in out and "7 in-use   1 free" in out and "┌ BT" in out and "/F1  0048  H  Heuristic  1" in out
    assert (tmp_path / "r.png").read_bytes().startswith(b"\x89PNG") and (tmp_path / "d.png").exists()


def one_page(contents=b"BT /F1 12 Tf (ok) Tj ET", *, root=b"1 0 R", length=None, filters=b"", fonts=b""):
    """A small file with one damaged part."""
    body = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 4 0 R " + fonts + b">>", b"<< /Length %s %s>>\nstream\n%s\nendstream" % (length or b"%d" % len(contents), filters, contents)]
    data = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, b) for i, b in enumerate(body, 1))
    return data + b"xref\n0 0\ntrailer\n<< /Size 5 /Root %s >>\nstartxref\n%d\n%%%%EOF" % (root, len(data))


def test_damaged_files_give_rows(spark):
    made = [
        one_page(), one_page(filters=b"/Filter [null] "), one_page(length=b"4 0 R"), one_page(root=b"null"), one_page(root=b"9 0 R"), one_page(b"BT /F1 12 Tf " + b"9" * 5000 + b" 0 Td (ok) Tj ET"), one_page(b"BT /F1 " + b"9" * 400 + b" Tf (ok) Tj ET"),
        one_page(filters=b"/Filter /FlateDecode "), one_page(filters=b"/Filter 7 "), one_page(filters=b"/Filter /ASCII85Decode "), one_page(fonts=b"/Resources << /Font << /F1 << /Subtype /Type3 /FontMatrix [1] /Encoding << /Differences [999999999999 /a -5 /b] >> >> >> >> "),
        b"", b"%PDF", one_page(b"[[[[(" * 3000), one_page(b"<< /a << /b [ 1 2 ET Q Q Q ) > ]"),
    ]
    parsed = pdf.parse(files(spark, *made))
    rows = {r.doc_id: r for r in parsed.collect()}
    assert set(rows) == set(range(len(made)))
    assert rows[0].error is None and rows[3].error == rows[4].error == "no page tree" and rows[11].error == "no startxref"
    text = {r.doc_id: r.text for r in PageLayout(stream_pages(parsed)).text.collect()}
    assert text[0] == text[1] == text[2] == "ok"
    assert interpret(parsed.where("error is null")).count() > 0 and listing.rendered(listing.listing(content_ops(parsed.where("error is null")))).count() > 0


def test_pages_that_are_missing(spark):
    parsed = pdf.parse(files(spark, pdf.build([STREAM])), pages=[0, 99])
    assert {r.page: r.error for r in parsed.collect()} == {0: None, 99: "page 99 not found"}
    with pytest.raises(Exception, match="page 99 not found"):
        pdf.parse(files(spark, pdf.build([STREAM])), pages=[99], mode="FAILFAST").collect()


def test_trailers_traces_and_order(spark):
    text = {r.doc_id: r.text for r in xref.trailer_dump(xref.trailers(files(spark, MINIMAL, SECTIONS))).collect()}
    assert text[1] == "Trailer\n  /Root  2 0 R\n  /Info  2 0 R\n  /Size  3\n  /Prev  1234  (incremental update)" and "/Info" not in text[0]
    p = PageLayout(stream_pages(pages(spark, STREAM)))
    trace_ = json.loads(trace.documents(trace.events(p.glyphs, p.words, p.lines, p.blocks)).first().trace)
    assert [e["stage"] for e in trace_["events"]][-3:] == ["line", "block", "reading_order"] and len(trace_["events"]) == 23
    svg = trace.svg(trace.rects(p.blocks, "blocks", F.col("block_no")).unionByName(trace.order_note(p.blocks)), 10, 10).first().svg
    assert '<g id="order"><!-- order: [0] --></g>' in svg


def test_odd_strings(spark):
    raw = [(b"\xfe\xff\x4e",), (b"\xfe\xff\xd8\x00",), (b"\xfe\xff\xd8\x3d\xde\x00",), (b"\xfe\xff",)]
    assert [r[0] for r in spark.createDataFrame(raw, "b binary").select(T.pdf_string(F.col("b"))).collect()] == ["þÿN", "þÿØ\x00", "\U0001f600", ""]
