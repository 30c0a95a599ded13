"""Pages as rows: the layout of whole pages by numpy, one Arrow pass and no sort or shuffle.

A glyph is some 70 bytes as a row, and a page has thousands, so windows over glyph rows sort and
spill a hundred times the bytes of the text they come from.  Pages are independent, though: here a
page stays one row until its words, lines or blocks are known.  ``Pages`` is a table of such rows
and the function that turns its column into arrays of glyphs; ``Pages.rows`` gives the rows of one
stage.  The arrays of about CHUNK glyphs are worked on at once, whatever the size of a batch.

The rules are those of ``clustering`` and ``ordering``, with all comparisons in 32-bit floats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cmap import code_table
from .ordering import GAP, PAGE, page_order

f32 = np.float32
# Points, and multiples of the font size.
LINE_TOLERANCE, WORD_GAP, BLOCK_GAP = 2.0, 2.0, 1.5
#: Glyphs of whole pages that are worked on at once.
CHUNK = 1 << 19
#: Numbers that are their own characters where no character map says otherwise.
PLAIN = ((0x20, 0x7E), (0xA0, 0xFF))
# White space, which takes room in a word and leaves no character.
WHITE = np.array([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_POINTS = 0x110000

_BOX = "x0 float, y0 float, x1 float, y1 float"
SCHEMAS = {
    "glyphs": f"doc_id long, page int, seq long, glyph_id long, x float, y float, {_BOX}, font_size float, font_name string, unicode string, mapping_method string",
    "words": f"doc_id long, page int, line_no int, word_no int, text string, {_BOX}, n_glyphs long, max_font_size float, baseline_y float",
    "lines": f"doc_id long, page int, line_no int, block_no int, baseline_y float, {_BOX}, n_words long, max_font_size float, text string",
    "blocks": f"doc_id long, page int, block_no int, n_lines long, {_BOX}, text string, reading_order int",
    "text": "doc_id long, page int, text string",
}
# one row a page with all of its stages
SCHEMAS["nested"] = "doc_id long, page int, " + ", ".join(f"{stage} array<struct<{SCHEMAS[stage].split(', ', 2)[2].replace(' ', ':').replace(',:', ',')}>>" for stage in ("glyphs", "words", "lines", "blocks"))


@dataclass
class Glyphs:
    """Glyphs of several pages, page by page, each page in the order of ``seq``.

    ``at`` is the number of a glyph's page; ``point`` its character: a code point, -1 for none, or
    -2 - k for the k-th of ``strings``.
    """

    n_pages: int
    at: np.ndarray
    seq: np.ndarray
    glyph_id: np.ndarray
    x: np.ndarray
    y: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    size: np.ndarray
    font: np.ndarray
    fonts: list[str | None]
    point: np.ndarray | None = None
    mapped: np.ndarray | None = None
    strings: list[str] = field(default_factory=list)

    def take(self, where: np.ndarray) -> Glyphs:
        """The glyphs at these places."""
        parts = {k: v[where] for k, v in vars(self).items() if isinstance(v, np.ndarray)}
        return Glyphs(**{**vars(self), **parts})


# sources


def lay_out(texts: list[str | None]) -> Glyphs:
    """Plain texts in the fixed layout of ``layout.glyphs_of_text``."""
    from . import layout as fixed

    sizes = np.array([len(t or "") for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    at = np.repeat(np.arange(len(texts)), sizes)
    place, breaks = np.arange(len(points)), points == 10
    begins = np.zeros(len(points), bool)
    begins[1:] = breaks[:-1] | (at[1:] != at[:-1])
    begins[:1] = True
    number = np.cumsum(breaks) - breaks
    first = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else place
    line = number - (number[first] if len(place) else number)
    i = place - np.maximum.accumulate(np.where(begins, place, 0)) if len(place) else place
    shown = ~breaks
    points, at, line, i = points[shown], at[shown], line[shown], i[shown]
    x, y = fixed.LEFT + fixed.PITCH * i, fixed.TOP - fixed.LEADING * line - fixed.GAP * (line // fixed.GROUP)
    return Glyphs(len(texts), at, line * (1 << 31) + i, points, x.astype(f32), y.astype(f32), x.astype(f32), y.astype(f32), (x + fixed.PITCH).astype(f32), (y + int(fixed.FONT_SIZE)).astype(f32), np.full(len(x), fixed.FONT_SIZE, f32), np.zeros(len(x), np.int32), [fixed.FONT])


def _streams(contents: list[bytes | None]) -> Glyphs:
    """Interpreted content streams."""
    from .interpreter import glyphs_of

    found = [glyphs_of(c or b"") for c in contents]
    shown = [s for page in found for s in page]
    lengths = np.array([len(s[0]) for s in shown], np.int64)
    per_page = np.array([sum(len(s[0]) for s in page) for page in found], np.int64)
    join = lambda i, kind: np.concatenate([s[i] for s in shown]) if shown else np.empty(0, kind)
    fonts = list(dict.fromkeys(s[6] for s in shown))
    number = {name: i for i, name in enumerate(fonts)}
    at = np.repeat(np.arange(len(found)), per_page)
    seq = np.arange(len(at)) - np.repeat(np.cumsum(per_page) - per_page, per_page)
    x, y = join(1, f32), join(2, f32)
    return Glyphs(len(found), at, seq, join(0, np.int64), x, y, x, y, join(3, f32), join(4, f32), join(5, f32), np.repeat(np.array([number[s[6]] for s in shown], np.int32), lengths), fonts)


def _listed(pages: pa.ListArray) -> Glyphs:
    """Glyphs that stand in the rows, with or without their characters."""
    sizes = pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pages.flatten()
    of = lambda name, kind, null=0: pc.fill_null(flat.field(name), null).to_numpy(zero_copy_only=False).astype(kind)
    font = flat.field("font_name").dictionary_encode()
    out = Glyphs(
        len(pages), np.repeat(np.arange(len(pages)), sizes), of("seq", np.int64), of("glyph_id", np.int64), *(of(c, f32, 0.0) for c in ("x", "y", "x0", "y0", "x1", "y1", "font_size")),
        pc.fill_null(font.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32), font.dictionary.to_pylist(),
    )
    names = [f.name for f in flat.type]
    if "unicode" in names:
        coded = flat.field("unicode").dictionary_encode()
        out.strings = coded.dictionary.to_pylist()
        table = np.array([ord(s) if len(s) == 1 else -2 - i for i, s in enumerate(out.strings)] + [-1], np.int64)
        out.point = table[pc.fill_null(coded.indices, len(out.strings)).to_numpy(zero_copy_only=False)]
        method = pc.fill_null(flat.field("mapping_method"), "Unmapped") if "mapping_method" in names else None
        out.mapped = np.where(out.point == -1, 0, 2) if method is None else pc.index_in(method, value_set=pa.array(METHODS)).to_numpy(zero_copy_only=False).astype(np.int64)
    return out.take(np.lexsort((out.seq, out.at)))


METHODS = ["Unmapped", "Heuristic", "ToUnicode"]


def characters(g: Glyphs, maps: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], plain: Iterable[tuple[int, int]] = PLAIN) -> Glyphs:
    """``g`` with its characters: by (page, font) from sorted numbers and code points, else plain."""
    guess = np.zeros(len(g.glyph_id), bool)
    for low, high in plain:
        guess |= (g.glyph_id >= low) & (g.glyph_id <= high)
    g.point, g.mapped = np.where(guess, g.glyph_id, -1), guess.astype(np.int64)
    ends = np.searchsorted(g.at, np.arange(g.n_pages + 1))
    for (page, name), (numbers, points) in maps.items():
        if name not in g.fonts or not len(numbers):
            continue
        where = np.arange(ends[page], ends[page + 1])
        where = where[g.font[where] == g.fonts.index(name)]
        i = np.minimum(np.searchsorted(numbers, g.glyph_id[where]), len(numbers) - 1)
        hit = numbers[i] == g.glyph_id[where]
        g.point[where[hit]], g.mapped[where[hit]] = points[i[hit]], 2
    return g


def _entries(maps: list[list[dict] | None]) -> dict:
    """Maps given as rows (font_name, glyph_id, unicode) of each page."""
    out: dict[tuple[int, str], dict[int, int]] = {}
    for page, rows in enumerate(maps):
        for r in rows or ():
            if r["glyph_id"] is not None:
                out.setdefault((page, r["font_name"]), {})[r["glyph_id"]] = ord(r["unicode"])
    return {k: (np.array(sorted(v), np.int64), np.array([v[n] for n in sorted(v)], np.int64)) for k, v in out.items()}


def _programs(fonts: list[list[dict] | None]) -> dict:
    """Maps given as the fonts of each page with their programs; glyphs are single bytes."""
    out, read = {}, {}
    for page, rows in enumerate(fonts):
        for f in rows or ():
            if (program := f["to_unicode"]) is not None:
                if program not in read:
                    table = code_table(program)
                    numbers = np.flatnonzero(table >= 0)
                    read[program] = (numbers, table[numbers])
                out[page, f["font_name"]] = read[program]
    return out


# stages


def line_anchors(at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The y of the first glyph of each glyph's line, for pages in the order of falling y.

    A glyph joins the line if its y is within the tolerance of the line's first y.  A gap above the
    tolerance always begins a line, so only runs without such gaps that are higher than the
    tolerance need the sequential rule; there each line is found by a binary search.
    """
    n = len(y)
    if not n:
        return y
    starts = np.ones(n, bool)
    starts[1:] = (at[1:] != at[:-1]) | (y[:-1] - y[1:] > f32(LINE_TOLERANCE))
    first = np.flatnonzero(starts)
    run = np.cumsum(starts) - 1
    anchor = y[first][run]
    last = np.append(first[1:], n)
    for r in np.flatnonzero(y[first] - y[last - 1] > f32(LINE_TOLERANCE)):
        i, end = first[r], last[r]
        down = -y[i:end].astype(np.float64)
        begin = i
        while begin < end:
            top = y[begin]
            stop = i + np.searchsorted(down, LINE_TOLERANCE - float(top), side="right")
            while stop < end and not f32(top - y[stop]) > f32(LINE_TOLERANCE):  # a difference that rounds to the tolerance
                stop = i + np.searchsorted(down, down[stop - i], side="right")
            stop = max(stop, begin + 1)
            anchor[begin:stop] = top
            begin = stop
    return anchor


def _sorted_within(group: np.ndarray, *keys: np.ndarray) -> np.ndarray | None:
    """The order of groups' members by ``keys``, the first one first; None if they have it already.

    Groups are contiguous; only those out of order are sorted, stably.
    """
    wrong = np.zeros(max(len(group) - 1, 0), bool)
    for k in reversed(keys):
        wrong = (k[1:] < k[:-1]) | ((k[1:] == k[:-1]) & wrong)
    wrong &= group[1:] == group[:-1]
    if not wrong.any():
        return None
    bad = np.zeros(int(group[-1]) + 1, bool)
    bad[group[1:][wrong]] = True
    where = np.flatnonzero(bad[group])
    order = np.arange(len(group))
    order[where] = where[np.lexsort((*(k[where] for k in reversed(keys)), group[where]))]
    return order


def _starts(*groups: np.ndarray) -> np.ndarray:
    """Where a new group begins."""
    n = len(groups[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for g in groups:
            new[1:] |= g[1:] != g[:-1]
    return np.flatnonzero(new)


def _rank(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The number of ``inner`` among the different ones of its ``outer``, both in runs."""
    if not len(outer):
        return np.empty(0, np.int32)
    new = np.zeros(len(outer), np.int64)
    new[_starts(outer, inner)] = 1
    total = np.cumsum(new)
    first = _starts(outer)
    return (total - np.repeat(total[first], np.diff(np.append(first, len(outer))))).astype(np.int32)


def _strings(g: Glyphs, white: np.ndarray) -> pa.StringArray:
    """What each glyph leaves in a word: its character, its number in brackets, or nothing."""
    key = np.where(g.point >= 0, g.point, np.where(g.point == -1, _POINTS + np.clip(g.glyph_id, 0, _POINTS - 1), 2 * _POINTS - 2 - g.point))
    odd = (g.point == -1) & ((g.glyph_id < 0) | (g.glyph_id >= _POINTS))
    if odd.any():  # numbers that no font has
        values, i = np.unique(g.glyph_id[odd], return_inverse=True)
        key[odd] = 2 * _POINTS + len(g.strings) + i
    else:
        values = ()
    key[white] = -1
    bracket = lambda n: f"[{n & 0xFFFFFFFFFFFFFFFF:02X}]"
    seen = np.zeros(int(key.max(initial=-1)) + 2, bool)
    seen[key + 1] = True
    kinds = np.flatnonzero(seen) - 1
    extra = [*g.strings, *(bracket(int(v)) for v in values)]
    text = lambda k: "" if k < 0 else chr(k) if k < _POINTS else bracket(k - _POINTS) if k < 2 * _POINTS else extra[k - 2 * _POINTS]
    known = pa.array([text(int(k)).encode("utf-8", "replace") for k in kinds], pa.binary()).cast(pa.string())
    return known.take(pa.array((np.cumsum(seen) - 1)[key + 1]))


def _group_text(values: pa.StringArray, starts: np.ndarray, sep: str) -> pa.StringArray:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values), sep)


def _boxes(b: dict, starts: np.ndarray) -> dict:
    return {c: (np.minimum if c in ("x0", "y0") else np.maximum).reduceat(b[c], starts) if len(starts) else b[c][:0] for c in ("x0", "y0", "x1", "y1")}


def find_words(g: Glyphs) -> dict:
    """Columns of words, with ``at``, ``line_no``, ``word_no`` and ``text``."""
    g = g.take(np.flatnonzero((g.size > 0) & (g.glyph_id != 0)))
    order = _sorted_within(g.at, -g.y, g.x, g.seq)
    g = g if order is None else g.take(order)
    anchor = line_anchors(g.at, g.y)
    start = _starts(g.at, anchor)
    line = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(g.at))))
    order = _sorted_within(line, g.x)
    g = g if order is None else g.take(order)
    baseline = g.y[start]
    space = g.point == 0x20
    breaks = np.ones(len(line), bool)
    breaks[1:] = (line[1:] != line[:-1]) | space[:-1] | (g.x[1:] - g.x[:-1] > g.size[:-1] * f32(WORD_GAP))
    keep = np.flatnonzero(~space)
    g, line, start = g.take(keep), line[keep], np.flatnonzero(breaks[keep])
    white = np.isin(g.point, WHITE)
    text = _strings(g, white)
    ends = np.append(start, len(g.at))
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1) if len(text) else np.zeros(1, np.int32)
    cuts = offsets[ends] if len(text) else np.zeros(1, np.int32)
    full = np.flatnonzero(np.diff(cuts) > 0)
    far = f32(np.inf)
    edge = {c: np.where(white, far if c in ("x0", "y0") else -far, getattr(g, c)) for c in ("x0", "y0", "x1", "y1")} if white.any() else {c: getattr(g, c) for c in ("x0", "y0", "x1", "y1")}
    boxes = _boxes(edge, start)
    first = start[full]
    words = {"at": g.at[first], "line": line[first], **{c: v[full] for c, v in boxes.items()}, "n_glyphs": np.diff(ends)[full], "max_font_size": np.maximum.reduceat(g.size, start)[full] if len(start) else g.size[:0]}
    words["baseline_y"] = baseline[words["line"]]
    words["line_no"] = _rank(words["at"], words["line"])
    words["word_no"] = (np.arange(len(full)) - np.repeat(s := _starts(words["at"], words["line"]), np.diff(np.append(s, len(full))))).astype(np.int32)
    bounds = np.append(cuts[full], cuts[-1] if len(full) else 0).astype(np.int32)
    words["text"] = pa.StringArray.from_buffers(len(full), pa.py_buffer(bounds), text.buffers()[2]) if len(full) else pa.array([], pa.string())
    return words


def find_lines(words: dict) -> dict:
    start = _starts(words["at"], words["line"])
    n = np.diff(np.append(start, len(words["at"])))
    lines = {"at": words["at"][start], "line_no": words["line_no"][start], "baseline_y": words["baseline_y"][start], **_boxes(words, start), "n_words": n, "max_font_size": np.maximum.reduceat(words["max_font_size"], start) if len(start) else words["max_font_size"]}
    step = np.abs(lines["baseline_y"][:-1] - lines["baseline_y"][1:])
    reach = np.maximum(lines["max_font_size"][:-1], f32(1)) * f32(BLOCK_GAP)
    breaks = np.zeros(len(start), np.int64)
    breaks[1:] = step > reach
    total, first = np.cumsum(breaks), _starts(lines["at"])
    lines["block_no"] = (total - np.repeat(total[first], np.diff(np.append(first, len(start))))).astype(np.int32)
    lines["text"] = _group_text(words["text"], start, " ")
    return lines


def find_blocks(lines: dict) -> dict:
    start = _starts(lines["at"], lines["block_no"])
    blocks = {"at": lines["at"][start], "block_no": lines["block_no"][start], "n_lines": np.diff(np.append(start, len(lines["at"]))), **_boxes(lines, start), "text": _group_text(lines["text"], start, "\n")}
    at, y0, y1 = blocks["at"], blocks["y0"], blocks["y1"]
    first = _starts(at)
    ends = np.append(first, len(at))[1:]
    order = np.arange(len(at)) - np.repeat(first, ends - first)
    # pages whose blocks hang below each other with gaps are in order; the others are cut
    hang = (at[1:] != at[:-1]) | (y0[:-1] - y1[1:] > f32(GAP))
    for page in np.unique(np.searchsorted(first, np.flatnonzero(~hang), side="right") - 1):
        a, b = first[page], ends[page]
        boxes = [tuple(map(float, box)) for box in zip(*(blocks[c][a:b] for c in ("x0", "y0", "x1", "y1")), strict=True)]
        order[a + np.array(page_order(boxes))] = np.arange(b - a)
    blocks["reading_order"] = order.astype(np.int32)
    return blocks


def find_text(blocks: dict, n_pages: int, blank: bool) -> tuple[np.ndarray, pa.StringArray]:
    """The numbers of pages and their texts; with ``blank``, of all pages."""
    at = blocks["at"]
    place = np.lexsort((blocks["reading_order"], at))
    start = _starts(at)
    text = _group_text(blocks["text"].take(pa.array(place)), start, "\n\n")
    if not blank:
        return at[start], text
    ends = np.searchsorted(at, np.arange(n_pages + 1))
    where = np.where(ends[1:] > ends[:-1], np.searchsorted(at[start], np.arange(n_pages)), -1)
    found = text.take(pa.array(where, mask=where < 0)) if len(text) else pa.nulls(n_pages, pa.string())
    return np.arange(n_pages), pc.fill_null(found, "")


def _fields(stage: str) -> list[str]:
    """Names of a stage's columns after the page's."""
    return [c.split()[0] for c in SCHEMAS[stage].split(", ")][2:]


def _glyph_columns(g: Glyphs) -> list[pa.Array]:
    single = pa.array(g.fonts, pa.string())
    unicode = _strings(g, np.zeros(len(g.at), bool))
    unicode = pc.if_else(pa.array(g.point != -1), unicode, pa.scalar(None, pa.string()))
    method = pa.DictionaryArray.from_arrays(pa.array(g.mapped, pa.int32()), pa.array(METHODS)).cast(pa.string())
    return [pa.array(g.seq), pa.array(g.glyph_id), *(pa.array(getattr(g, c)) for c in ("x", "y", "x0", "y0", "x1", "y1", "size")), single.take(pa.array(g.font, pa.int32(), mask=g.font < 0)), unicode, method]


def _found_columns(stage: str, found: dict) -> list[pa.Array]:
    wide = {"n_glyphs", "n_words", "n_lines"}
    return [found[c] if isinstance(found[c], pa.Array) else pa.array(found[c].astype(np.int64) if c in wide else found[c]) for c in _fields(stage)]


def _columns(stage: str, g: Glyphs, blank: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """The page number of each row of a stage, and its columns after the page's."""
    if stage == "glyphs":
        return g.at, _glyph_columns(g)
    words = find_words(g)
    if stage == "words":
        return words["at"], _found_columns(stage, words)
    lines = find_lines(words)
    if stage == "lines":
        return lines["at"], _found_columns(stage, lines)
    blocks = find_blocks(lines)
    if stage == "text":
        at, text = find_text(blocks, g.n_pages, blank)
        return at, [text]
    if stage == "blocks":
        return blocks["at"], _found_columns(stage, blocks)
    pages = np.arange(g.n_pages)
    listed = lambda at, name, columns: pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(g.n_pages + 1)), pa.int32()), pa.StructArray.from_arrays(columns, names=_fields(name)))
    return pages, [listed(g.at, "glyphs", _glyph_columns(g)), *(listed(found["at"], name, _found_columns(name, found)) for name, found in (("words", words), ("lines", lines), ("blocks", blocks)))]


def _ranges(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK glyphs, one row at least."""
    total, begin = np.cumsum(weights), 0
    while begin < len(weights):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + CHUNK, side="right")))
        yield begin, end
        begin = end


def _runner(kind: str, stage: str, blank: bool, plain: tuple) -> Callable:
    names = ["doc_id", "page", *(("glyphs", "words", "lines", "blocks") if stage == "nested" else _fields(stage))]

    def glyphs(part: pa.RecordBatch) -> Glyphs:
        column = part.column(2)
        if kind == "listed":
            g = _listed(column)
        else:
            g = (lay_out if kind == "text" else _streams)(column.to_pylist())
        if g.point is None:
            given = part.column(3).to_pylist()
            g = characters(g, _programs(given) if kind == "stream" and part.schema.names[3] == "fonts" else _entries(given), plain)
        return g

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = pc.list_value_length(column) if kind == "listed" else pc.binary_length(column)
            for begin, end in _ranges(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1):
                part = batch.slice(begin, end - begin)
                at, columns = _columns(stage, glyphs(part), blank)
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), *columns], names=names)

    return run


@dataclass(frozen=True)
class Pages:
    """Rows of (doc_id, page, one column, maps): ``kind`` says what the column holds.

    ``text`` has plain texts, ``stream`` content streams, ``listed`` arrays of glyphs.  ``maps`` is
    a column ``cmap`` of (font_name, glyph_id, unicode) or ``fonts`` with their programs.
    Rows without doc_id or page are left out, as they name no page.
    """

    df: DataFrame
    kind: str
    plain: tuple = PLAIN

    def with_cmap(self, cmap: DataFrame) -> Pages:
        """Pages with the entries (doc_id, page, font_name, glyph_id, unicode) beside them."""
        packed = cmap.groupBy(*PAGE).agg(F.collect_list(F.struct("font_name", "glyph_id", "unicode")).alias("cmap"))
        rest = [c for c in self.df.columns if c not in ("cmap", "fonts")]
        return Pages(self.df.select(*rest).join(packed, list(PAGE), "left"), self.kind, self.plain)

    def rows(self, stage: str, blank: bool = False) -> DataFrame:
        """The rows of a stage; see SCHEMAS.  ``blank`` gives pages without text an empty one."""
        df = self.df.where("doc_id is not null and page is not null")
        maps = next((c for c in ("cmap", "fonts") if c in df.columns), None)
        column = {"text": "text", "stream": "content", "listed": "glyphs"}[self.kind]
        if maps == "fonts":
            given = F.transform("fonts", lambda f: F.struct(f["font_name"].alias("font_name"), f["to_unicode"].alias("to_unicode")))
        else:
            given = F.col(maps) if maps else F.lit(None).cast("array<struct<font_name:string,glyph_id:bigint,unicode:string>>")
        df = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), column, given.alias(maps or "cmap"))
        return df.mapInArrow(_runner(self.kind, stage, blank, tuple(self.plain)), SCHEMAS[stage])


def pack(glyphs: DataFrame) -> Pages:
    """Pages of a flat glyph relation: one shuffle on the page."""
    columns = [c for c in ("seq", "glyph_id", "x", "y", "x0", "y0", "x1", "y1", "font_size", "font_name", "unicode", "mapping_method") if c in glyphs.columns]
    return Pages(glyphs.groupBy(*PAGE).agg(F.collect_list(F.struct(*columns)).alias("glyphs")), "listed")
