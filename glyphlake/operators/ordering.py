"""Reading order of blocks by recursive cuts, and the text of a page.

A page is cut at all horizontal gaps at once: bands are islands in a window over descending tops.
A band with one block is done.  Only bands with several blocks that overlap in height need the
recursive rule, in an Arrow function over arrays of boxes, which all other bands leave empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page")

# Fixed value: points of a gap that may be cut.
GAP = 1.0


def with_bands(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``band``, numbered from the top, and ``n_band``, the band's blocks."""
    down = Window.partitionBy(*PAGE).orderBy(F.desc("y1"), F.asc("block_no"))
    lowest = F.min("y0").over(down.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(((lowest - F.col("y1")).cast("float") > F.lit(GAP).cast("float")).cast("int"), F.lit(0))
    banded = blocks.withColumn("opens", opens).withColumn("band", F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")
    return banded.withColumn("n_band", F.count("*").over(Window.partitionBy(*PAGE, "band")))


def fallback_rank(*keys: str):
    """Rank by the centre's height, then from left to right, then as they came."""
    centre = lambda a, b: ((F.col(a) + F.col(b)).cast("float") / 2).cast("float")
    return F.row_number().over(Window.partitionBy(*keys).orderBy(centre("y0", "y1").desc(), centre("x0", "x1").asc(), F.asc("block_no"))) - 1


def _gap(intervals: list[tuple[float, float]]) -> float | None:
    """The middle of the first free stretch wider than GAP, from the low end."""
    reach = None
    for low, high in sorted(intervals):
        if reach is not None and low - reach > GAP:
            return (reach + low) / 2
        reach = high if reach is None else max(reach, high)
    return None


def cut_order(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """Indices of (x0, y0, x1, y1) in reading order.

    Work items are taken from a stack, so deep pages need no recursion.
    """
    out: list[int] = []
    work = [list(range(len(boxes)))]
    while work:
        group = work.pop()
        if len(group) < 2:
            out += group
            continue
        # the sweep runs downwards, so heights are turned over
        cut = _gap([(-boxes[i][3], -boxes[i][1]) for i in group])
        if cut is not None:
            first, rest = [i for i in group if -boxes[i][1] < cut], [i for i in group if -boxes[i][3] >= cut]
            if first and rest and len(first) + len(rest) == len(group):
                work += [rest, first]
                continue
        cut = _gap([(boxes[i][0], boxes[i][2]) for i in group])
        if cut is not None:
            first, rest = [i for i in group if boxes[i][2] <= cut], [i for i in group if boxes[i][0] > cut]
            if first and rest and len(first) + len(rest) == len(group):
                work += [rest, first]
                continue
        out += sorted(group, key=lambda i: (-(boxes[i][1] + boxes[i][3]) / 2, (boxes[i][0] + boxes[i][2]) / 2))
    return out


def page_order(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """Indices of a page's boxes in reading order: band by band, and by cuts in crowded bands."""
    out: list[int] = []
    band: list[int] = []
    lowest = None
    for i in sorted(range(len(boxes)), key=lambda i: (-boxes[i][3], i)):
        if lowest is not None and np.float32(lowest - boxes[i][3]) > GAP:
            out += _band_order(band, boxes)
            band = []
        band.append(i)
        lowest = boxes[i][1] if lowest is None else min(lowest, boxes[i][1])
    return out + _band_order(band, boxes)


def _band_order(band: list[int], boxes: list[tuple]) -> list[int]:
    own = sorted(band)
    return [own[k] for k in cut_order([boxes[i] for i in own])] if len(own) > 1 else own


def _ranks(boxes: pd.Series) -> pd.Series:
    """Places of the boxes (x0, y0, x1, y1) of each band; null for a band that needs none."""

    def of(band) -> list[int] | None:
        if band is None:
            return None
        rank = [0] * len(band)
        for place, i in enumerate(cut_order([tuple(map(float, b)) for b in band])):
            rank[i] = place
        return rank

    return boxes.map(of)


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``reading_order`` from 0 within the page."""
    columns = blocks.columns
    others = [c for c in columns if c not in (*PAGE, "block_no")]
    banded = with_bands(blocks).groupBy(*PAGE, "band").agg(F.array_sort(F.collect_list(F.struct("block_no", *others))).alias("bs"))
    boxes = F.when(F.size("bs") > 1, F.transform("bs", lambda b: F.array(b["x0"], b["y0"], b["x1"], b["y1"])))
    ranks = F.pandas_udf(_ranks, "array<int>")(boxes)
    flat = banded.withColumn("ranks", ranks).select(*PAGE, "band", "ranks", F.posexplode("bs").alias("i", "b")).select(*PAGE, "band", "b.*", F.coalesce(F.get("ranks", F.col("i")), F.lit(0)).alias("rank"))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("band", "rank")) - 1
    return flat.withColumn("reading_order", order).select(*columns, "reading_order")


def page_text(blocks: DataFrame) -> DataFrame:
    """doc_id, page, text: blocks in reading order, parted by an empty line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda b: b["text"]), "\n\n")
    return blocks.groupBy(*PAGE).agg(text.alias("text"))
