"""Text operators on literal streams."""

import numpy as np
import pytest

from glyphlake.operators.content import operations
from glyphlake.operators.interpreter import glyphs_of


def shown(stream):
    """(id, x, y, width, height, size, font) of every glyph."""
    out = []
    for code, x, y, x1, y1, size, font in glyphs_of(stream):
        out += [(int(a), float(b), float(c), float(d - b), float(e - c), float(f), font) for a, b, c, d, e, f in zip(code, x, y, x1, y1, size, strict=True)]
    return out


def at(stream):
    return [(g[1], g[2]) for g in shown(stream)]


close = lambda pairs: [pytest.approx(p, abs=0.01) for p in pairs]
HEAD = b"BT /F1 12 Tf "


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (b"1 0 0 1 100 200 Tm (A) Tj ET", [(100, 200)]),
        (b"1 0 0 -1 100 200 Tm (A) Tj ET", [(100, 200)]),
        (b"72 720 Td (H) Tj ET", [(72, 720)]),
        (b"(AB) Tj ET", [(0, 0), (7.2, 0)]),
        (b"[(A) -500 (B)] TJ ET", [(0, 0), (13.2, 0)]),
        (b"[(A) 500 (B)] TJ ET", [(0, 0), (1.2, 0)]),
        (b"[(AB)(C)] TJ ET", [(0, 0), (7.2, 0), (14.4, 0)]),
        (b"20 TL 0 700 Td (A) Tj T* (B) Tj ET", [(0, 700), (0, 680)]),
        (b"10 0 Td 5 0 Td (A) Tj ET", [(15, 0)]),
        (b"0 100 Td 0 -20 TD (A) Tj T* (B) Tj ET", [(0, 80), (0, 60)]),
        (b"5 Tc (AB) Tj ET", [(0, 0), (12.2, 0)]),
        (b"10 Tw (A B) Tj ET", [(0, 0), (7.2, 0), (24.4, 0)]),
        (b"50 Tz (AB) Tj ET", [(0, 0), (3.6, 0)]),
        (b"5 Ts (A) Tj ET", [(0, 5)]),
        (b"15 TL 0 200 Td (A) Tj (B) ' ET", [(0, 200), (0, 185)]),
        (b'10 TL 0 200 Td (A) Tj 0 8 (B) " (CD) Tj ET', [(0, 200), (0, 190), (15.2, 190), (30.4, 190)]),
        (b"1 0 0 1 9 9 Tm (A) Tj ET BT (B) Tj ET", [(9, 9), (0, 0)]),
    ],
)
def test_positions(body, want):
    assert at(HEAD + body) == close(want)


def test_outside_text_and_empty():
    assert shown(b"/F1 12 Tf (A) Tj") == []
    assert shown(b"") == []
    assert shown(b"BT 12 Tf (A) Tj Td ET")[0][5] == 0  # operators without their operands do nothing


def test_matrix_stack_leaves_text_state():
    assert at(b"1 0 0 1 50 50 cm q 1 0 0 1 100 100 cm Q " + HEAD + b"(A) Tj ET") == close([(50, 50)])
    assert at(b"Q 1 0 0 1 80 40 cm " + HEAD + b"(A) Tj ET") == close([(80, 40)])
    assert shown(b"q /F1 12 Tf Q BT (A) Tj ET")[0][5:] == (12.0, "/F1")


def test_bytes_and_boxes():
    found = shown(HEAD + b"<FF0041> Tj ET")
    assert [g[0] for g in found] == [255, 0, 65]
    assert found[2][3:5] == pytest.approx((7.2, 12), abs=0.01)


def test_sums_are_32_bit():
    xs = np.array([g[1] for g in shown(HEAD + b"(" + b"A" * 500 + b") Tj ET")], np.float32)
    step, want = np.float32(600) / np.float32(1000) * np.float32(12), [np.float32(0)]
    for _ in range(499):
        want.append(np.float32(want[-1] + step))
    assert (xs == np.array(want)).all()


def test_lexer():
    ops = list(operations(b"% note\n[(a\\)b\\053\\n) -1.5 /N#41 true null <</K [1]>>] X (a(b)c) <414> Y 1 2"))
    assert ops[0] == ("X", [[b"a)b+\n", -1.5, b"NA", True, None, {b"K": [1]}]])
    assert ops[1] == ("Y", [b"a(b)c", b"A@"])
    assert list(operations(b"\xff\xfe)>]}")) is not None
    inline = [op for op, _ in operations(b"BI /W 1 ID \x00Q EI q")]
    assert inline == ["BI", "ID", "EI", "q"]
