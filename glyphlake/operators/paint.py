"""Painted paths of content streams as rows, and pages as pixels.

A page is one fold over its operations (``Painter``), applied in Arrow batches.  The relation of
paths keeps colour, rule, width and box; the raster fills the same paths by sampling each pixel on
a fixed grid.  Clipping, images, shadings and transparency are accepted and have no effect.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .content import Name, operations
from .interpreter import mul
from .truetype import TrueType

# Pixels per point of a rendered page and an overlay; the thinnest stroke in pixels.
SCALE = 2.0
OVERLAY_SCALE = 1.5
LEAST_STROKE = 0.4
#: Advance of a glyph without a known width, in ems.
DEFAULT_ADVANCE = 0.5
_SAMPLES = 4
_CURVE_STEPS = 12
#: Glyph programs that show glyphs of their own font may nest so deep; one that shows itself would
#: never end, so what lies deeper paints nothing.
_MAX_DEPTH = 8

Matrix = tuple[float, float, float, float, float, float]
Point = tuple[float, float]
Color = tuple[float, float, float]


def real(v: Any) -> float:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0


def clamp(v: float) -> float:
    return min(max(v, 0.0), 1.0)


def color(values: list[float]) -> Color | None:
    """Gray, RGB or CMYK by the number of components; null for other numbers."""
    match values:
        case [g]:
            return (clamp(g),) * 3
        case [r, g, b]:
            return clamp(r), clamp(g), clamp(b)
        case [c, m, y, k]:
            return clamp((1 - c) * (1 - k)), clamp((1 - m) * (1 - k)), clamp((1 - y) * (1 - k))
    return None


@dataclass(frozen=True)
class Graphics:
    ctm: Matrix
    fill: Color = (0.0, 0.0, 0.0)
    stroke: Color = (0.0, 0.0, 0.0)
    width: float = 1.0


@dataclass(frozen=True)
class Path:
    """A painted path in device space: closed or open runs of points."""

    runs: list[tuple[list[Point], bool]]
    fill: Color | None
    stroke: Color | None
    even_odd: bool
    width: float

    @property
    def box(self) -> tuple[float, float, float, float]:
        points = [p for run, _ in self.runs for p in run]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return min(xs), min(ys), max(xs), max(ys)


class Painter:
    """Runs operations and hands every painted path to ``emit``.

    ``fonts`` maps a name to a dictionary with kind, and for type3 fonts font_matrix, char_procs
    and widths; for truetype fonts outlines and two_byte.
    """

    _PAINTS = {"f": (1, 0, 0, 0), "F": (1, 0, 0, 0), "f*": (1, 0, 1, 0), "S": (0, 1, 0, 0), "s": (0, 1, 0, 1), "B": (1, 1, 0, 0), "b": (1, 1, 0, 1), "B*": (1, 1, 1, 0), "b*": (1, 1, 1, 1)}

    def __init__(self, ctm: Matrix, fonts: dict[str, dict], emit: Callable[[str, Path], None]):
        self.stack, self.fonts, self.emit = [Graphics(ctm)], fonts, emit
        self.runs: list[tuple[list[Point], bool]] = []
        self.at = self.start = (0.0, 0.0)
        self.tm = self.tlm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        self.font, self.size, self.chars, self.scale, self.leading, self.rise = None, 0.0, 0.0, 100.0, 0.0, 0.0
        self.depth = 0

    @property
    def g(self) -> Graphics:
        return self.stack[-1]

    def set(self, **values: Any) -> None:
        self.stack[-1] = replace(self.g, **values)

    def point(self, x: float, y: float) -> Point:
        m = self.g.ctm
        return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]

    def run(self, content: bytes) -> None:
        for op, o in operations(content):
            self.apply(op, o)

    # paths are kept in user space and mapped when painted, as the matrix may still change

    def move(self, p: Point) -> None:
        self.runs.append(([p], False))
        self.at = self.start = p

    def line(self, p: Point) -> None:
        if not self.runs or self.runs[-1][1]:
            self.runs.append(([self.at], False))
        self.runs[-1][0].append(p)
        self.at = p

    def curve(self, a: Point, b: Point, c: Point) -> None:
        p = self.at
        for i in range(1, _CURVE_STEPS + 1):
            t = i / _CURVE_STEPS
            u = 1 - t
            self.line(tuple(u**3 * p[k] + 3 * u * u * t * a[k] + 3 * u * t * t * b[k] + t**3 * c[k] for k in (0, 1)))

    def close(self) -> None:
        if self.runs:
            self.runs[-1] = (self.runs[-1][0], True)
        self.at = self.start

    def paint(self, op: str) -> None:
        fill, stroke, even_odd, closes = self._PAINTS[op]
        if closes:
            self.close()
        g = self.g
        runs = [([self.point(*p) for p in run], shut) for run, shut in self.runs if len(run) > 1]
        if runs:
            m = g.ctm
            mean = max(((m[0] ** 2 + m[1] ** 2) ** 0.5 + (m[2] ** 2 + m[3] ** 2) ** 0.5) * 0.5, 0.01)
            self.emit(op, Path(runs, g.fill if fill else None, g.stroke if stroke else None, bool(even_odd), max(g.width * mean, LEAST_STROKE)))
        self.runs = []

    def next_line(self, tx: float, ty: float) -> None:
        self.tlm = self.tm = mul(self.tlm, (1.0, 0.0, 0.0, 1.0, tx, ty))

    def advance(self, tx: float) -> None:
        self.tm = mul(self.tm, (1.0, 0.0, 0.0, 1.0, tx * self.scale / 100, 0.0))

    def show(self, data: bytes) -> None:
        if self.font is None:
            return
        font = self.fonts.get(self.font)
        if font and font["kind"] == "type3":
            matrix = tuple(font["font_matrix"])
            for code in data:
                if code in font["char_procs"] and self.depth < _MAX_DEPTH:
                    part = (self.size * self.scale / 100, 0.0, 0.0, self.size, 0.0, self.rise)
                    glyph = mul(mul(mul(self.g.ctm, self.tm), part), matrix)
                    saved, self.runs = self.runs, []
                    self.stack.append(Graphics(glyph, self.g.fill, self.g.fill))
                    self.depth += 1
                    self.run(font["char_procs"][code])
                    self.depth -= 1
                    self.stack.pop()
                    self.runs = saved
                self.advance(font["widths"].get(code, 0.0) * matrix[0] * self.size + self.chars)
            return
        wide = bool(font and font.get("two_byte"))
        codes = [data[i] << 8 | (data[i + 1] if i + 1 < len(data) else 0) for i in range(0, len(data), 2)] if wide else data
        program = font.get("outlines") if font else None
        for code in codes:
            if program is not None and program.units_per_em:
                self.draw(program, code)
            self.advance(DEFAULT_ADVANCE * self.size + self.chars)

    def draw(self, program: TrueType, glyph: int) -> None:
        """Fill a glyph's outline in the current colour; the code is the glyph's number."""
        em = 1 / program.units_per_em
        m = mul(mul(mul(self.g.ctm, self.tm), (self.size * self.scale / 100, 0.0, 0.0, self.size, 0.0, self.rise)), (em, 0.0, 0.0, em, 0.0, 0.0))
        saved, self.runs = self.runs, []
        for start, steps in program.outline(glyph):
            self.move(start)
            for control, end in steps:
                if control is None:
                    self.line(end)
                else:
                    third = lambda p, q=control: tuple(p[k] + (q[k] - p[k]) * 2 / 3 for k in (0, 1))
                    self.curve(third(self.at), third(end), end)
            self.close()
        runs = [([(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x, y in run], True) for run, _ in self.runs if len(run) > 1]
        self.runs = saved
        if runs:
            self.emit("glyph", Path(runs, self.g.fill, None, False, 0.0))

    def apply(self, op: str, o: list[Any]) -> None:
        n, v = len(o), [real(x) for x in o]
        match op:
            case "q":
                self.stack.append(self.g)
            case "Q" if len(self.stack) > 1:
                self.stack.pop()
            case "cm" if n >= 6:
                self.set(ctm=mul(self.g.ctm, tuple(v[:6])))
            case "w" if n:
                self.set(width=v[0])
            case "g" | "G" if n:
                self.set(**{"fill" if op == "g" else "stroke": color(v[:1])})
            case "rg" | "RG" if n >= 3:
                self.set(**{"fill" if op == "rg" else "stroke": color(v[:3])})
            case "k" | "K" if n >= 4:
                self.set(**{"fill" if op == "k" else "stroke": color(v[:4])})
            case "sc" | "scn" | "SC" | "SCN":
                if found := color([real(x) for x in o if isinstance(x, (int, float)) and not isinstance(x, bool)]):
                    self.set(**{"fill" if op[0] == "s" else "stroke": found})
            case "m" if n >= 2:
                self.move((v[0], v[1]))
            case "l" if n >= 2:
                self.line((v[0], v[1]))
            case "c" if n >= 6:
                self.curve((v[0], v[1]), (v[2], v[3]), (v[4], v[5]))
            case "v" if n >= 4:
                self.curve(self.at, (v[0], v[1]), (v[2], v[3]))
            case "y" if n >= 4:
                self.curve((v[0], v[1]), (v[2], v[3]), (v[2], v[3]))
            case "re" if n >= 4:
                x, y, w, h = v[:4]
                self.move((x, y))
                for p in ((x + w, y), (x + w, y + h), (x, y + h)):
                    self.line(p)
                self.close()
            case "h":
                self.close()
            case "n":
                self.runs = []
            case _ if op in self._PAINTS:
                self.paint(op)
            case _:
                self.text(op, o, v)

    def text(self, op: str, o: list[Any], v: list[float]) -> None:
        n = len(o)
        match op:
            case "BT":
                self.tm = self.tlm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            case "Tf" if n >= 2:
                if isinstance(o[0], Name):
                    self.font = f"/{o[0].decode('utf-8', 'replace')}"
                self.size = v[1]
            case "Tc" if n:
                self.chars = v[0]
            case "Tz" if n:
                self.scale = v[0]
            case "TL" if n:
                self.leading = v[0]
            case "Ts" if n:
                self.rise = v[0]
            case "Td" | "TD" if n >= 2:
                self.leading = -v[1] if op == "TD" else self.leading
                self.next_line(v[0], v[1])
            case "Tm" if n >= 6:
                self.tm = self.tlm = tuple(v[:6])
            case "T*":
                self.next_line(0.0, -self.leading)
            case "Tj" | "'" if n:
                if op == "'":
                    self.next_line(0.0, -self.leading)
                if isinstance(o[0], bytes) and not isinstance(o[0], Name):
                    self.show(o[0])
            case "TJ" if n and isinstance(o[0], list):
                for x in o[0]:
                    if isinstance(x, bytes) and not isinstance(x, Name):
                        self.show(x)
                    elif isinstance(x, (int, float)) and not isinstance(x, bool):
                        self.advance(-x / 1000 * self.size)


def fonts_by_name(rows: list[dict] | None) -> dict[str, dict]:
    """Font rows of a page, maps as dictionaries."""
    out = {}
    for r in rows or []:
        out[r["font_name"]] = {"kind": r["kind"], "two_byte": bool(r["two_byte"]), "font_matrix": r["font_matrix"] or [0.001, 0, 0, 0.001, 0, 0], "char_procs": dict(r["char_procs"] or ()), "widths": dict(r["widths"] or ()), "outlines": TrueType(r["program"]) if r["kind"] == "truetype" and r["program"] else None}
    return out


_PATHS = "doc_id long, page int, seq long, operator string, even_odd boolean, fill array<double>, stroke array<double>, width double, x0 double, y0 double, x1 double, y1 double, n_runs int"


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        names = batch.schema.names
        for r in batch.to_pylist():
            seq = [0]

            def emit(op: str, p: Path, r=r, seq=seq) -> None:
                rows.append((r["doc_id"], r["page"], seq[0], op, p.even_odd, p.fill, p.stroke, p.width, *p.box, len(p.runs)))
                seq[0] += 1

            Painter((1.0, 0.0, 0.0, 1.0, 0.0, 0.0), fonts_by_name(r["fonts"] if "fonts" in names else None), emit).run(r["content"] or b"")
        columns = list(zip(*rows, strict=True)) or [()] * 13
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.float64()] * 5, pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PATHS.split(", ")])


def paint_paths(pages: DataFrame) -> DataFrame:
    """One row for each painted path of (doc_id, page, content) and, if given, fonts; in points."""
    keep = [c for c in ("doc_id", "page", "content", "fonts") if c in pages.columns]
    return pages.select(*keep).mapInArrow(_path_rows, _PATHS)


# pixels


class Canvas:
    """An opaque RGB picture on white."""

    def __init__(self, width: int, height: int):
        self.pixels = np.full((height, width, 3), 255.0)

    def cover(self, runs: list[list[Point]], even_odd: bool) -> tuple[slice, slice, np.ndarray] | None:
        """The rows, columns and shares of the pixels inside closed polygons."""
        h, w = self.pixels.shape[:2]
        p = np.array([q for r in runs for q in r])
        x0, y0 = np.maximum(np.floor(p.min(axis=0)), 0).astype(int)
        x1, y1 = np.minimum(np.ceil(p.max(axis=0)), [w, h]).astype(int)
        if x1 <= x0 or y1 <= y0:
            return None
        xs = x0 + (np.arange((x1 - x0) * _SAMPLES) + 0.5) / _SAMPLES
        ys = y0 + (np.arange((y1 - y0) * _SAMPLES) + 0.5) / _SAMPLES
        turns = np.zeros((len(ys), len(xs) + 1), np.int32)
        for r in runs:
            for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]], strict=True):
                if ay == by:
                    continue
                up, (lx, ly, hx, hy) = (1, (ax, ay, bx, by)) if ay < by else (-1, (bx, by, ax, ay))
                k = np.flatnonzero((ys >= ly) & (ys < hy))
                at = np.searchsorted(xs, lx + (ys[k] - ly) * (hx - lx) / (hy - ly))
                turns[k, at] += up
        wound = np.cumsum(turns[:, :-1], axis=1)
        inside = (wound % 2 != 0) if even_odd else (wound != 0)
        share = inside.reshape(y1 - y0, _SAMPLES, x1 - x0, _SAMPLES).mean(axis=(1, 3))
        return slice(y0, y1), slice(x0, x1), share

    def fill(self, runs: list[list[Point]], rgb: Color, even_odd: bool = False, alpha: float = 1.0) -> None:
        if found := self.cover([r for r in runs if len(r) > 1], even_odd) if any(len(r) > 1 for r in runs) else None:
            rows, cols, share = found
            share = (share * alpha)[..., None]
            self.pixels[rows, cols] = self.pixels[rows, cols] * (1 - share) + np.array(rgb) * 255 * share

    def stroke(self, runs: list[tuple[list[Point], bool]], rgb: Color, width: float, alpha: float = 1.0) -> None:
        """Each segment as a rectangle of the width; all together, so overlaps count once."""
        quads = []
        for run, shut in runs:
            for (ax, ay), (bx, by) in zip(run, [*run[1:], run[0]] if shut else run[1:], strict=False):
                length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
                if length:
                    dx, dy = (bx - ax) / length * width / 2, (by - ay) / length * width / 2
                    quads.append([(ax - dy, ay + dx), (bx - dy, by + dx), (bx + dy, by - dx), (ax + dy, ay - dx)])
        if quads:
            self.fill(quads, rgb, alpha=alpha)

    def png(self) -> bytes:
        h, w = self.pixels.shape[:2]
        rows = np.zeros((h, 1 + 3 * w), np.uint8)
        rows[:, 1:] = np.rint(self.pixels).astype(np.uint8).reshape(h, -1)
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def render_page(width: float, height: float, content: bytes, fonts: dict[str, dict] | None = None, scale: float = SCALE) -> Canvas | None:
    """The page in pixels; none if it has no area.  Sizes are rounded."""
    w, h = round(width * scale), round(height * scale)
    if w <= 0 or h <= 0:
        return None
    canvas = Canvas(w, h)

    def emit(_: str, p: Path) -> None:
        if p.fill is not None:
            canvas.fill([r for r, _ in p.runs], p.fill, p.even_odd)
        if p.stroke is not None:
            canvas.stroke(p.runs, p.stroke, p.width)

    Painter((scale, 0.0, 0.0, -scale, 0.0, height * scale), fonts or {}, emit).run(content)
    return canvas


def render_overlay(width: float, height: float, boxes: dict[str, list[tuple[float, float, float, float]]], scale: float = OVERLAY_SCALE) -> Canvas | None:
    """Boxes of words (green), lines (blue) and blocks (red) on white.  Sizes are cut off."""
    w, h = int(width * scale), int(height * scale)
    if w <= 0 or h <= 0:
        return None
    canvas = Canvas(w, h)
    # Fill and edge colours with their opacity, and the edge's width.
    styles = {"words": (((0, 160, 0), 35), ((0, 140, 0), 180), 0.6), "lines": (((0, 60, 220), 30), ((0, 50, 200), 180), 0.8), "blocks": (None, ((210, 30, 30), 230), 2.0)}
    for layer, (inner, edge, wide) in styles.items():
        for x0, y0, x1, y1 in boxes.get(layer, ()):
            ring = [(x0 * scale, (height - y1) * scale), (x1 * scale, (height - y1) * scale), (x1 * scale, (height - y0) * scale), (x0 * scale, (height - y0) * scale)]
            if inner:
                canvas.fill([ring], tuple(c / 255 for c in inner[0]), alpha=inner[1] / 255)
            canvas.stroke([(ring, True)], tuple(c / 255 for c in edge[0]), wide, alpha=edge[1] / 255)
    return canvas


def _png_rows(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                canvas = render_page(r["width"], r["height"], r["content"] or b"", fonts_by_name(r.get("fonts")), scale)
                size = (None, None) if canvas is None else canvas.pixels.shape[1::-1]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"]], pa.int64()), "page": pa.array([r["page"]], pa.int32()), "width": pa.array([size[0]], pa.int32()), "height": pa.array([size[1]], pa.int32()), "png": pa.array([canvas and canvas.png()], pa.binary())})

    return run


def render(pages: DataFrame, scale: float = SCALE) -> DataFrame:
    """(doc_id, page, width, height, png) of (doc_id, page, width, height, content[, fonts])."""
    keep = [c for c in ("doc_id", "page", "width", "height", "content", "fonts") if c in pages.columns]
    return pages.select(*keep).mapInArrow(_png_rows(scale), "doc_id long, page int, width int, height int, png binary")


def overlays(sizes: DataFrame, scale: float = OVERLAY_SCALE, **layers: DataFrame) -> DataFrame:
    """(doc_id, page, png): the boxes of words, lines and blocks of each page over white.

    ``sizes`` is (doc_id, page, width, height); a layer is any relation of doc_id, page and a box.
    """
    found = sizes.select("doc_id", "page", "width", "height")
    for name in ("words", "lines", "blocks"):
        if name in layers:
            box = F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
            found = found.join(layers[name].groupBy("doc_id", "page").agg(F.collect_list(box).alias(name)), ["doc_id", "page"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [render_overlay(r["width"], r["height"], {k: r.get(k) or [] for k in ("words", "lines", "blocks")}, scale) for r in rows]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "page": pa.array([r["page"] for r in rows], pa.int32()), "png": pa.array([c and c.png() for c in made], pa.binary())})

    return found.mapInArrow(run, "doc_id long, page int, png binary")
