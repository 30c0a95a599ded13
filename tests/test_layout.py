"""Mapping, clustering and reading order on constructed glyphs and boxes."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.operators import clustering, cmap, mapping, ordering
from glyphlake.plans.layout import PageLayout

GLYPHS = "doc_id long, page int, seq long, glyph_id long, unicode string, mapping_method string, x float, y float, x0 float, y0 float, x1 float, y1 float, font_size float, font_name string"


def g(x, y, ch, fs=12.0, seq=None, doc=1):
    n = ord(ch) if ch else 0
    return [doc, 0, seq, n, ch, "ToUnicode" if ch else "Unmapped", float(x), float(y), float(x), float(y), float(x + (0.6 * fs if ch else 0)), float(y + fs), fs, "/F1"]


def page(spark, rows):
    return PageLayout(spark.createDataFrame([[*r[:2], i if r[2] is None else r[2], *r[3:]] for i, r in enumerate(rows)], GLYPHS))


def words(p):
    return [[w.text for w in sorted(ws, key=lambda w: w.word_no)] for _, ws in sorted(group(p.words.collect(), "line_no").items())]


def group(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([g(50, 200, "A")], [["A"]]),
        ([g(0, 0, "A"), g(6, 0, "B"), g(12, 0, "C")], [["ABC"]]),
        ([g(0, 0, "A"), g(50, 0, "B")], [["A", "B"]]),
        ([g(0, 100, "A"), g(0, 50, "B")], [["A"], ["B"]]),
        ([g(0, 100, "A"), g(6, 98.6, "B")], [["AB"]]),
        ([g(50, 0, "B"), g(100, 0, "A")], [["B", "A"]]),
        ([g(0, 0, "H"), g(6, 0, "i"), g(12, 0, " "), g(18, 0, "!")], [["Hi", "!"]]),
        ([g(0, 0, None), g(10, 0, "A"), g(20, 0, None), g(50, 0, "B")], [["A", "B"]]),
        ([g(0, 0, "A"), g(6, 0, "\u00a0"), g(12, 0, "B")], [["AB"]]),
        ([g(0, 0, "A", fs=-3.0)], []),
        ([g(0, 100, "A"), g(0, 98.6, "B"), g(0, 97.5, "C"), g(0, 97, "D")], [["AB"], ["CD"]]),
    ],
)
def test_words(spark, rows, want):
    assert words(page(spark, rows)) == want


def test_unmapped_and_empty(spark):
    row = g(0, 0, "A")
    row[3:6] = [0xB3, None, "Unmapped"]
    assert words(page(spark, [row])) == [["[B3]"]]
    assert page(spark, [g(0, 0, None)]).text.count() == 0
    assert page(spark, [g(0, 0, " ")]).text.count() == 0


def test_blocks_and_boxes(spark):
    near = page(spark, [g(0, 100, "A"), g(0, 86, "B")])
    assert near.blocks.count() == 1 and near.text.first().text == "A\nB"
    far = page(spark, [g(0, 50, "B"), g(0, 100, "A")])
    assert [r.reading_order for r in far.blocks.orderBy("block_no").collect()] == [0, 1]
    assert far.text.first().text == "A\n\nB"
    box = page(spark, [g(x, 0, "A") for x in (10, 20, 30)]).blocks.first()
    assert (box.x0, box.x1) == pytest.approx((10, 37.2), abs=0.01)


def test_leading_space_sets_baseline(spark):
    found = page(spark, [g(0, 101, " "), g(6, 100, "A")]).lines.first()
    assert found.baseline_y == 101


def test_mapping(spark):
    ids = [0x41, 0x7A, 0xE9, 0x80, 0x9F, 0, 0x1F]
    raw = spark.createDataFrame([(1, 0, i, n, "/F1") for i, n in enumerate(ids)], "doc_id long, page int, seq long, glyph_id long, font_name string")
    assert [r.unicode for r in mapping.map_glyphs(raw).orderBy("seq").collect()] == ["A", "z", "é", None, None, None, None]
    program = spark.createDataFrame([(1, 0, "/F1", b"1 beginbfchar\n<41> <6A21>\nendbfchar")], "doc_id long, page int, font_name string, content binary")
    first = mapping.map_glyphs(raw, cmap.page_cmap(program)).orderBy("seq").first()
    assert (first.unicode, first.mapping_method) == ("模", "ToUnicode")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("", {}),
        ("beginbfchar\n<DE> <6A21>\nendbfchar", {0xDE: "模"}),
        ("5 beginbfchar\n<41> <0041>\n<42> <0042>\nendbfchar\n1 beginbfrange\n<43> <44> <0043>\nendbfrange", {65: "A", 66: "B", 67: "C", 68: "D"}),
        ("beginbfrange\n<79> <7A> [<4E2D> <6587>]\nendbfrange", {0x79: "中", 0x7A: "文"}),
        ("beginbfchar\n<01> <D83DDE00>\n<02> <D83D>\n<3> <4>\nendbfchar", {1: "\U0001f600", 3: "\x04"}),
        ("beginbfchar <41> <0042> endbfchar", {}),
        ("beginbfchar\n<41> <0042>\n<41> <0043>\nendbfchar", {65: "C"}),
        ("<41> <0042>\nbeginbfchar\n<zz> <41> <0044>\nendbfchar\n<42> <0042>", {65: "D"}),
        ("beginbfrange\n<00> <FFFFFF> <10FFFE>\nendbfrange", {0: "\U0010fffe", 1: "\U0010ffff"}),
        ("beginbfrange\n<00> <01> <D83DDE00>\n<05> <04> <0041>\nendbfrange", {}),
    ],
)
def test_cmap(spark, body, want):
    df = spark.createDataFrame([(1, 0, "/F1", body.encode())], "doc_id long, page int, font_name string, content binary")
    assert {r.glyph_id: r.unicode for r in cmap.page_cmap(df).collect()} == want


@pytest.mark.parametrize(
    ("boxes", "want"),
    [
        ([(0, 0, 1, 1)], [0]),
        ([], []),
        ([(0, 0, 100, 40), (0, 50, 100, 100)], [1, 0]),
        ([(60, 0, 110, 100), (0, 0, 50, 100)], [1, 0]),
        ([(0, 0, 50, 40), (60, 0, 110, 40), (0, 60, 50, 100), (60, 60, 110, 100)], [2, 3, 0, 1]),
        ([(20, 11, 25, 13), (15, 2, 17, 7), (4, 8, 12, 10)], [2, 0, 1]),
    ],
)
def test_cut_order(boxes, want):
    assert ordering.cut_order(boxes) == want


def first_gap(spans, down):
    """The middle of the first wide gap, by events: entries before exits at the same place."""
    sign = -1 if down else 1
    events = sorted([(sign * (b if down else a), 0) for a, b in spans] + [(sign * (a if down else b), 1) for a, b in spans])
    active, last = 0, None
    for at, leaves in events:
        if not leaves and not active and last is not None and at - last > 1.0:
            return sign * (last + at) / 2
        active += -1 if leaves else 1
        last = at
    return None


def plain_order(idx, boxes):
    if len(idx) < 2:
        return idx
    y = first_gap([(boxes[i][1], boxes[i][3]) for i in idx], True)
    x = first_gap([(boxes[i][0], boxes[i][2]) for i in idx], False)
    for cut, low in ((y, lambda i: boxes[i][1] > y), (x, lambda i: boxes[i][2] <= x)):
        if cut is not None:
            a, b = [i for i in idx if low(i)], [i for i in idx if not low(i)]
            if a and b:
                return plain_order(a, boxes) + plain_order(b, boxes)
    return sorted(idx, key=lambda i: (-(boxes[i][1] + boxes[i][3]) / 2, (boxes[i][0] + boxes[i][2]) / 2))


@given(st.lists(st.tuples(*[st.integers(0, 30)] * 2, *[st.integers(1, 8)] * 2), max_size=9))
def test_cut_order_is_the_recursive_rule(parts):
    boxes = [(x, y, x + w, y + h) for x, y, w, h in parts]
    assert ordering.cut_order(boxes) == plain_order(list(range(len(boxes))), boxes)


def test_reading_order_with_bands(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(40):
        boxes = [(x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for x, y in ((rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.randint(1, 8)))]
        rows += [(doc, 0, i, *map(float, b)) for i, b in enumerate(boxes)]
        want |= {(doc, i): k for k, i in enumerate(plain_order(list(range(len(boxes))), boxes))}
    df = spark.createDataFrame(rows, "doc_id long, page int, block_no int, x0 float, y0 float, x1 float, y1 float")
    assert {(r.doc_id, r.block_no): r.reading_order for r in ordering.reading_order(df).collect()} == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=25), min_size=1, max_size=10))
def test_line_anchors_are_the_sequential_rule(spark, pages):
    rows, want = [], set()
    for doc, ys in enumerate(pages):
        anchor = None
        for y in sorted((y / 4 for y in ys), reverse=True):
            anchor = y if anchor is None or anchor - y > 2.0 else anchor
            want.add((doc, y, anchor))
        rows += [(doc, 0, i, 65, 0.0, y / 4, 10.0) for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "doc_id long, page int, seq long, glyph_id long, x float, y float, font_size float")
    assert {(r.doc_id, r.y, r.anchor) for r in clustering.with_lines(df).select("doc_id", "y", "anchor").collect()} == want


def test_one_shuffle_serves_the_words(spark):
    rows = [[*g(6 * i, 0, "A")[:2], i, *g(6 * i, 0, "A")[3:]] for i in range(5)]
    plan = spark.createDataFrame(rows, GLYPHS).transform(clustering.with_lines).where(F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") <= 3  # glyphs, the high runs and their anchors
