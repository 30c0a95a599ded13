"""Outlines of TrueType programs: closed runs of quadratic curves in font units."""

from __future__ import annotations

import struct
from functools import cached_property

Point = tuple[float, float]
#: A contour: its first point, then (control or none, end) steps.
Contour = tuple[Point, list[tuple[Point | None, Point]]]
_MAX_DEPTH = 6

# Flags of simple and of composed glyphs.
ON_CURVE, X_SHORT, Y_SHORT, REPEAT, X_SAME, Y_SAME = 1, 2, 4, 8, 16, 32
WORDS, OFFSETS, SCALE, MORE, TWO_SCALES, MATRIX = 1, 2, 8, 32, 64, 128


class TrueType:
    """A font program; damaged tables make glyphs empty."""

    def __init__(self, data: bytes):
        self.data = data
        self.tables = {}
        count = struct.unpack_from(">H", data, 4)[0] if len(data) >= 12 else 0
        for i in range(count):
            if 12 + 16 * i + 16 <= len(data):
                tag, _, at, size = struct.unpack_from(">4sLLL", data, 12 + 16 * i)
                self.tables[tag] = (at, size)

    def _table(self, tag: bytes) -> bytes:
        at, size = self.tables.get(tag, (0, 0))
        return self.data[at : at + size]

    @cached_property
    def units_per_em(self) -> int:
        head = self._table(b"head")
        return struct.unpack_from(">H", head, 18)[0] if len(head) >= 54 else 0

    @cached_property
    def _places(self) -> list[int]:
        loca, head = self._table(b"loca"), self._table(b"head")
        if len(head) < 54:
            return []
        if struct.unpack_from(">h", head, 50)[0]:
            return list(struct.unpack(f">{len(loca) // 4}L", loca[: len(loca) // 4 * 4]))
        return [2 * x for x in struct.unpack(f">{len(loca) // 2}H", loca[: len(loca) // 2 * 2])]

    def outline(self, glyph: int, depth: int = 0) -> list[Contour]:
        try:
            a, b = self._places[glyph], self._places[glyph + 1]
            data = self._table(b"glyf")[a:b]
            if len(data) < 10 or depth > _MAX_DEPTH:
                return []
            n = struct.unpack_from(">h", data, 0)[0]
            return self._simple(data, n) if n >= 0 else self._composed(data, depth)
        except (IndexError, struct.error):
            return []

    def _simple(self, data: bytes, n: int) -> list[Contour]:
        ends = struct.unpack_from(f">{n}H", data, 10)
        at = 10 + 2 * n
        at += 2 + struct.unpack_from(">H", data, at)[0]
        count = ends[-1] + 1 if ends else 0
        flags: list[int] = []
        while len(flags) < count:
            f = data[at]
            at += 1
            times = 1
            if f & REPEAT:
                times += data[at]
                at += 1
            flags += [f] * times
        axes = []
        for short, same in ((X_SHORT, X_SAME), (Y_SHORT, Y_SAME)):
            v, values = 0, []
            for f in flags[:count]:
                if f & short:
                    v += data[at] if f & same else -data[at]
                    at += 1
                elif not f & same:
                    v += struct.unpack_from(">h", data, at)[0]
                    at += 2
                values.append(float(v))
            axes.append(values)
        points = list(zip(*axes, strict=True))
        out, first = [], 0
        for end in ends:
            if contour := _contour(points[first : end + 1], [bool(f & ON_CURVE) for f in flags[first : end + 1]]):
                out.append(contour)
            first = end + 1
        return out

    def _composed(self, data: bytes, depth: int) -> list[Contour]:
        at, out = 10, []
        while True:
            flags, part = struct.unpack_from(">HH", data, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & WORDS else ">bb", data, at)
            at += 4 if flags & WORDS else 2
            a, b, c, d = 1.0, 0.0, 0.0, 1.0
            count = 4 if flags & MATRIX else 2 if flags & TWO_SCALES else 1 if flags & SCALE else 0
            v = [x / 16384 for x in struct.unpack_from(f">{count}h", data, at)]
            at += 2 * count
            if count:
                a, b, c, d = v if count == 4 else (v[0], 0.0, 0.0, v[-1])
            if not flags & OFFSETS:
                dx = dy = 0  # places by point numbers are taken as none
            move = lambda p, m=(a, b, c, d, dx, dy): p and (m[0] * p[0] + m[2] * p[1] + m[4], m[1] * p[0] + m[3] * p[1] + m[5])
            out += [(move(start), [(move(q), move(p)) for q, p in steps]) for start, steps in self.outline(part, depth + 1)]
            if not flags & MORE:
                return out


def _contour(points: list[Point], on: list[bool]) -> Contour | None:
    """Points on and off the curve as steps; between two off the curve lies one on it."""
    if len(points) < 2:
        return None
    middle = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    k = next((i for i, f in enumerate(on) if f), None)
    if k is None:
        start = middle(points[-1], points[0])
        order = list(zip(points, on, strict=True))
    else:
        start = points[k]
        order = list(zip(points[k + 1 :] + points[:k], on[k + 1 :] + on[:k], strict=True))
    steps: list[tuple[Point | None, Point]] = []
    control = None
    for p, is_on in order:
        if is_on:
            steps.append((control, p))
            control = None
        else:
            if control is not None:
                steps.append((control, middle(control, p)))
            control = p
    steps.append((control, start))
    return start, steps
