"""Text operations to positioned glyphs.

The state of a content stream is a fold over its operations, so it runs in Python, one page at a
time and in 32-bit floats.  The glyphs of one string differ only by running sums, which numpy
takes.  What follows is DataFrame work.

Kept as the format's extraction rules have it: a nominal width of 600/1000 for every glyph, one
glyph for each byte, text state outside q and Q, boxes in text size regardless of the matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .content import Name, operations
from .packed import Pages

f32 = np.float32
Matrix = tuple
IDENTITY = tuple(map(f32, (1, 0, 0, 1, 0, 0)))
# Fixed value: the advance of any glyph, in thousandths of the size.
NOMINAL_WIDTH = 600.0
SCHEMA = "doc_id long, page int, seq long, glyph_id long, x float, y float, x0 float, y0 float, x1 float, y1 float, font_size float, font_name string"


def real(v: Any) -> np.float32:
    """A numeric operand, infinite beyond 32-bit floats; 0 for anything else."""
    with np.errstate(over="ignore"):
        return f32(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else f32(0)


def mul(m: Matrix, n: Matrix) -> Matrix:
    """The matrix that applies ``n`` first."""
    return (m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def shift(tx, ty) -> Matrix:
    return (f32(1), f32(0), f32(0), f32(1), f32(tx), f32(ty))


class TextState:
    """Text parameters and matrices; ``show`` appends columns of glyphs to ``out``."""

    def __init__(self):
        self.ctm, self.saved = IDENTITY, []
        self.tm = self.tlm = IDENTITY
        self.font, self.size, self.chars, self.words, self.scale, self.leading, self.rise = "", f32(0), f32(0), f32(0), f32(100), f32(0), f32(0)
        self.inside = False
        self.out: list[tuple] = []

    def move(self, tx, ty) -> None:
        self.tlm = self.tm = mul(self.tlm, shift(tx, ty))

    def show(self, data: bytes) -> None:
        if not data:
            return
        code = np.frombuffer(data, np.uint8)
        part = self.scale / f32(100)
        step = np.full(len(code), (f32(NOMINAL_WIDTH) / f32(1000) * self.size + self.chars) * part, f32)
        step[code == 0x20] += self.words * part
        a, b, c, d, e, f = self.tm
        # positions before each glyph and after the last, summed one by one as the rule has it
        along = np.cumsum(np.concatenate([[e], a * step]), dtype=f32)
        up = np.cumsum(np.concatenate([[f], b * step]), dtype=f32)
        ca, cb, cc, cd, ce, cf = self.ctm
        x = ca * along[:-1] + cc * up[:-1] + ce
        y = cb * along[:-1] + cd * up[:-1] + cf
        if self.rise:
            x = x + (ca * c + cc * d) * self.rise
            y = y + (cb * c + cd * d) * self.rise
        self.out.append((code.astype(np.int64), x, y, x + np.maximum(step, f32(0)), y + abs(self.size), np.full(len(code), self.size, f32), self.font))
        self.tm = (a, b, c, d, along[-1], up[-1])

    def kern(self, k) -> None:
        self.tm = mul(self.tm, shift(-real(k) / f32(1000) * self.size * (self.scale / f32(100)), 0))

    def apply(self, op: str, o: list[Any]) -> None:
        """One operation; one with too few operands does nothing."""
        n = len(o)
        match op:
            case "q":
                self.saved.append(self.ctm)
            case "Q" if self.saved:
                self.ctm = self.saved.pop()
            case "cm" if n >= 6:
                self.ctm = mul(self.ctm, tuple(map(real, o[:6])))
            case "BT":
                self.inside, self.tm, self.tlm = True, IDENTITY, IDENTITY
            case "ET":
                self.inside = False
            case "Tf" if n >= 2:
                if isinstance(o[0], Name):
                    self.font = f"/{o[0].decode('utf-8', 'replace')}"
                self.size = real(o[1])
            case "Tc" if n:
                self.chars = real(o[0])
            case "Tw" if n:
                self.words = real(o[0])
            case "Tz" if n:
                self.scale = real(o[0])
            case "TL" if n:
                self.leading = real(o[0])
            case "Ts" if n:
                self.rise = real(o[0])
            case "Td" | "TD" if n >= 2:
                if op == "TD":
                    self.leading = -real(o[1])
                self.move(real(o[0]), real(o[1]))
            case "Tm" if n >= 6:
                self.tm = self.tlm = tuple(map(real, o[:6]))
            case "T*":
                self.move(0, -self.leading)
            case "Tj" if n and self.inside:
                self._string(o[0])
            case "TJ" if n and self.inside and isinstance(o[0], list):
                for item in o[0]:
                    if isinstance(item, (int, float)) and not isinstance(item, bool):
                        self.kern(item)
                    else:
                        self._string(item)
            case "'" if n and self.inside:
                self.move(0, -self.leading)
                self._string(o[0])
            case '"' if n >= 3 and self.inside:
                self.words, self.chars = real(o[0]), real(o[1])
                self.move(0, -self.leading)
                self._string(o[2])

    def _string(self, v: Any) -> None:
        if isinstance(v, bytes) and not isinstance(v, Name):
            self.show(v)


def glyphs_of(content: bytes) -> list[tuple]:
    """Columns (id, x, y, x1, y1, size, font) of each shown string of a page."""
    state = TextState()
    with np.errstate(all="ignore"):  # infinite operands give positions that are no numbers
        for op, operands in operations(content):
            state.apply(op, operands)
    return state.out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, page, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shown = glyphs_of(content or b"")
            if not shown:
                continue
            code, x, y, x1, y1, size = (np.concatenate([s[i] for s in shown]) for i in range(6))
            n = len(code)
            fonts = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(shown), dtype=np.int32), [len(s[0]) for s in shown]), pa.array([s[6] for s in shown], pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, doc_id, np.int64)), pa.array(np.full(n, page, np.int32)), pa.array(np.arange(n)), pa.array(code), *(pa.array(v, pa.float32()) for v in (x, y, x, y, x1, y1, size)), fonts],
                names=["doc_id", "page", "seq", "glyph_id", "x", "y", "x0", "y0", "x1", "y1", "font_size", "font_name"],
            )


def interpret(pages: DataFrame) -> DataFrame:
    """The glyph relation of (doc_id, page, content); rows without doc_id or page name no page."""
    return pages.select("doc_id", "page", "content").where("doc_id is not null and page is not null").mapInArrow(_rows, SCHEMA)


def pages(parsed: DataFrame) -> Pages:
    """The pages of (doc_id, page, content), with ``fonts`` where there are any, for the layout.

    Streams are interpreted, mapped and laid out in one pass, without a row for each glyph.
    """
    return Pages(parsed.select("doc_id", "page", "content", *(c for c in ("fonts",) if c in parsed.columns)), "stream")
