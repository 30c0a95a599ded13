"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

All that packing needs to know is how many pieces of each length there are, so the corpus is
reduced to a histogram with one row for each length, at most ``capacity`` rows whatever the corpus
holds.  The driver packs the histogram: it fills a bin greedily with the longest pieces that fit,
then looks for two unpacked pieces that together fill the place of the bin's smallest piece and
its gap more tightly, and repeats the resulting pattern as often as the remaining counts allow.
Pieces are then numbered within their length by prefix sums over tasks and take the places of the
patterns.  No group of documents is ever gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace
from .tokenize import encoder as encoder_of

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.asarray([end_id], encoder.dtype).tobytes()
        for batch in batches:
            rows = []
            texts = encoder.encode_all(t or "" for t in batch.column(1).to_pylist())
            for doc_id, x in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = np.frombuffer(x + end, encoder.dtype).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity), strict=True)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b]), task, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def _longest(counts: np.ndarray, limit: int) -> int:
    """The longest length of at most ``limit`` with a count; 0 if there is none."""
    at = np.flatnonzero(counts[1 : limit + 1])
    return int(at[-1]) + 1 if len(at) else 0


def _two(counts: np.ndarray, least: int, limit: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum above ``least`` and at most ``limit``."""
    have = np.flatnonzero(counts[:limit]) if limit > 0 else np.empty(0, np.int64)
    have = have[have > 0]
    if not len(have):
        return None
    at = np.searchsorted(have, limit - have, side="right") - 1
    ok = at >= 0
    other = have[np.maximum(at, 0)]
    # the same length twice needs two pieces of it; else the next shorter one
    single = ok & (other == have) & (counts[have] < 2)
    other = np.where(single, have[np.maximum(at - 1, 0)], other)
    ok &= ~(single & (at == 0))
    total = np.where(ok, have + other, 0)
    best = int(total.argmax())
    return (int(have[best]), int(other[best])) if total[best] > least else None


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, how many such bins) for counts[length] pieces of each length."""
    counts = counts.astype(np.int64).copy()
    plan = []
    while counts.any():
        left = counts.copy()
        bin_, gap = [], capacity
        while n := _longest(left, gap):
            bin_.append(n)
            left[n] -= 1
            gap -= n
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            if two := _two(left, smallest, gap + smallest):
                left[smallest] += 1
                bin_[-1:] = two
                left[list(two)] -= [1, 1] if two[0] != two[1] else [2, 2]
        lengths, need = np.unique(bin_, return_counts=True)
        times = int((counts[lengths] // need).min())
        counts[lengths] -= need * times
        plan.append((tuple(bin_), times))
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for bin_, times in plan:
        for n, offset in zip(bin_, [0, *accumulate(bin_)], strict=False):
            runs.setdefault(n, []).append((taken.get(n, 0), base, offset))
            taken[n] = taken.get(n, 0) + times
        base += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def _placed(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                k = np.flatnonzero(length == n)
                first, base, at = places[int(n)]
                i = np.searchsorted(first, rank[k], side="right") - 1
                sequence[k] = base[i] + rank[k] - first[i]
                offset[k] = at[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are ignored.  A document longer than
    ``capacity`` is cut so that only its first piece may be shorter.

    Defined results: a null text is empty and is one piece with the end id alone; a null doc_id
    stays null; rows that repeat a doc_id are packed like any other.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = ws.write(rows.mapInArrow(_pieces(vocabulary, end_id, capacity), _PIECES), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows come to the driver
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(_places(best_two_fit(counts, capacity))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
