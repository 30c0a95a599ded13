"""Whole-page layout by arrays: against rows, against the column expressions and against plain rules."""

import random

import numpy as np
import pytest
from test_layout import GLYPHS, plain_order

from glyphlake.operators import clustering, cmap, interpreter, layout, mapping, ordering, packed, trace
from glyphlake.plans.layout import PageLayout
from glyphlake.sources import pdf

TEXTS = ["one two\nthree", "", None, "\n\n a\tb  c\nend\n", "é ß 你好  x 😀", "x" * 300, "l\n" * 12, " ", "tail "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select("doc_id", "page", *columns).collect())


def test_text_pages_are_the_glyph_rows(docs):
    flat, pages = mapping.map_glyphs(layout.glyphs_of_text(docs.where("doc_id <> 4"))), PageLayout(layout.pages_of_text(docs.where("doc_id <> 4")))
    columns = [c for c in flat.columns if c not in packed.PAGE]
    assert rows(pages.glyphs, *columns) == rows(flat, *columns)
    for stage in ("words", "lines", "blocks", "text"):
        names = [c.split()[0] for c in packed.SCHEMAS[stage].split(", ")][2:]
        assert rows(getattr(pages, stage), *names) == rows(getattr(PageLayout(flat), stage), *names)


def test_stages_agree_with_windows(docs):
    pages = PageLayout(layout.pages_of_text(docs))
    names = [c.split()[0] for c in packed.SCHEMAS["lines"].split(", ")][2:]
    assert rows(clustering.lines(pages.words), *names) == rows(pages.lines, *names)
    names = [c.split()[0] for c in packed.SCHEMAS["blocks"].split(", ")][2:]
    assert rows(ordering.reading_order(clustering.blocks(pages.lines)), *names) == rows(pages.blocks, *names)
    assert rows(ordering.page_text(pages.blocks), "text") == rows(pages.text, "text")


def test_blank_pages(docs):
    texts = dict((r.doc_id, r.text) for r in layout.pages_of_text(docs).rows("text", blank=True).collect())
    assert set(texts) == set(range(len(TEXTS))) and texts[1] == texts[2] == texts[7] == "" and texts[0] == "one two\nthree"


def plain_words(glyphs):
    """The sequential rules on (x, y, size, ch, seq) of one page: texts of words by line."""
    left = sorted((g for g in glyphs if g[2] > 0), key=lambda g: (-g[1], g[0], g[4]))
    lines, anchor = [], None
    for g in left:
        if anchor is None or np.float32(anchor - g[1]) > 2:
            anchor = g[1]
            lines.append([])
        lines[-1].append(g)
    out = []
    for line in lines:
        line.sort(key=lambda g: (g[0], -g[1], g[4]))
        found, last = [], None
        for g in line:
            if g[3] != " ":
                if last is None or last[3] == " " or np.float32(g[0] - last[0]) > np.float32(last[2] * 2):
                    found.append("")
                found[-1] += g[3]
            last = g
        if found:
            out.append(found)
    return out


def test_words_of_scattered_glyphs(spark):
    rng = random.Random(8)
    given, want = [], {}
    for doc in range(60):
        tight = rng.random() < 0.5
        glyphs = [(float(np.float32(rng.uniform(0, 60))), float(np.float32(rng.uniform(0, 6 if tight else 200))), float(rng.choice([-1, 3, 8, 12])), rng.choice("ab c"), i) for i in range(rng.randint(0, 40))]
        given += [[doc, 0, s, ord(ch), ch, "ToUnicode", x, y, x, y, x + 1, y + z, z, "/F1"] for x, y, z, ch, s in glyphs]
        want |= {doc: plain_words(glyphs)}
    rng.shuffle(given)
    found = {}
    for r in sorted(PageLayout(spark.createDataFrame(given, GLYPHS)).words.collect(), key=lambda r: (r.doc_id, r.line_no, r.word_no)):
        lines = found.setdefault(r.doc_id, [])
        lines += [[]] * 0 if r.line_no < len(lines) else [[]]
        lines[r.line_no].append(r.text)
    assert found == {k: v for k, v in want.items() if v}


def test_page_order_is_the_recursive_rule():
    rng = random.Random(3)
    for _ in range(300):
        boxes = [(x, y, x + rng.randint(1, 12), y + rng.randint(1, 12)) for x, y in ((rng.randint(0, 40), rng.randint(0, 90)) for _ in range(rng.randint(0, 12)))]
        assert ordering.page_order(boxes) == plain_order(list(range(len(boxes))), boxes)


def test_dense_heights_take_linear_time():
    import time

    y = np.sort(np.random.default_rng(1).uniform(0, 2000, 400_000).astype(np.float32))[::-1]
    began = time.perf_counter()
    packed.line_anchors(np.zeros(len(y), np.int64), y)
    assert time.perf_counter() - began < 5


PROGRAMS = [
    b"5 beginbfchar\n<41> <0041>\n<42> <D83DDE00>\n<F> <4>\n<43> <D800>\nendbfchar\n1 beginbfrange\n<43> <44> <0043>\n<60> <7A> [<0061> <zz> <0062>]\r<80> <FFFF> <10FFF0>\nendbfrange\n<41> <0042>",
    b"beginbfrange\n<00> <FF> <D7FE>\nendbfrange\nbeginbfchar\n<61> <0078>\n<61> <0062>\nbeginbfrange\n<05> <04> <0041>\n<10> <12> <FFFFFFFF>\nendbfrange",
    b"beginbfrange\n<FFFFFFFFFFFFFFFF> <FFFFFFFFFFFFFFFF> <41>\n<01> <02> <FFFFFFFFFFFFFFFFFF>\n<05> <06> <0041>", b"", b"\xff\xfe beginbfchar\n<41> <0058>",
]


def test_code_table_is_the_relation_of_entries(spark):
    df = spark.createDataFrame([(i, 0, "/F1", p) for i, p in enumerate(PROGRAMS)], "doc_id long, page int, font_name string, content binary")
    want = {(r.doc_id, r.glyph_id): r.unicode for r in cmap.page_cmap(df).where("glyph_id < 256").collect()}
    tables = [cmap.code_table(p) for p in PROGRAMS]
    assert {(i, int(n)): chr(t[n]) for i, t in enumerate(tables) for n in np.flatnonzero(t >= 0)} == want


def test_streams_with_programs(spark):
    program = b"beginbfchar\n<61> <0078>\n<62> <6A21>\nendbfchar"
    streams = spark.createDataFrame([(1, 0, b"BT /F1 10 Tf 1 0 0 1 72 700 Tm (abc \xb3) Tj ET"), (1, 1, b""), (2, 0, b"BT /F2 9 Tf (ab) Tj ET"), (None, 0, b"BT /F1 10 Tf (z) Tj ET")], "doc_id long, page int, content binary")
    parsed = pdf.parse(pdf.write_files(streams.where("doc_id is not null"), program))
    one_pass = PageLayout(interpreter.pages(parsed))
    joined = PageLayout(interpreter.interpret(parsed), cmap.page_cmap(pdf.unicode_programs(parsed)))
    beside = PageLayout(interpreter.pages(parsed.drop("fonts")), cmap.page_cmap(pdf.unicode_programs(parsed)))
    for stage in ("words", "text"):
        assert rows(getattr(one_pass, stage), "text") == rows(getattr(joined, stage), "text") == rows(getattr(beside, stage), "text")
    assert rows(one_pass.text, "text") == [(1, 0, "x模c ³"), (2, 0, "ab")]
    assert interpreter.interpret(streams).where("doc_id is null").count() == 0


def test_small_inputs_are_spread_and_large_ones_stay(spark, docs, sf):
    found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan(layout.pages_of_text(found).df)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "Repartition" not in plan(layout.pages_of_text(found).df)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_chunks_change_nothing(spark, docs, monkeypatch):
    texts = [t or "" for t in TEXTS] * 3
    whole = packed.find_words(packed.characters(packed.lay_out(texts), {}))["text"].to_pylist()
    weights = np.array([len(t) + 1 for t in texts])
    monkeypatch.setattr(packed, "CHUNK", 7)
    ranges = list(packed._ranges(weights))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert [w for a, b in ranges for w in packed.find_words(packed.characters(packed.lay_out(texts[a:b]), {}))["text"].to_pylist()] == whole


def test_events_in_one_pass(docs):
    p = PageLayout(layout.pages_of_text(docs))
    found = trace.page_events(p.pages)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert rows(found, "stage", "seq", "payload") == rows(trace.events(p.glyphs, p.words, p.lines, p.blocks), "stage", "seq", "payload")
