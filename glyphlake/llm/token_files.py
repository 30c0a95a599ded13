"""Token ids in flat binary files with 64-bit document offsets, for memory-mapped reading.

Layout of a folder, one set of files per range of doc_id, all numbers little-endian:

- ``ids-NNNNN.bin``: the ids of the range's documents, unsigned 16-bit where the vocabulary fits,
  else unsigned 32-bit;
- ``docs-NNNNN.bin``: doc_id per document, signed 64-bit, and ``null-NNNNN.bin``: one byte each, 1
  where doc_id is null;
- ``offsets-NNNNN.bin``: unsigned 64-bit starts, counted in ids over the whole corpus, one more
  than documents; the first is the range's base.

The ids are written in one pass after a range shuffle.  Each task reports one total; the bases are
the prefix sums of these totals (as many numbers as files), and a second small pass writes the
offsets.  A task writes under a name of its own and renames at the end, so an attempt that is lost
or repeated leaves a whole file with the same content.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, ranges
from .tokenize import encoder as encoder_of

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
_BUFFER = 8 << 20


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI; a path without a scheme is local."""
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:/") else f"file://{os.path.abspath(root)}")


def _uri(root: str) -> str:
    return f"file://{root.removeprefix('file:')}" if root.startswith("file:/") and not root.startswith("file://") else root


def _put(store: fs.FileSystem, path: str, parts) -> None:
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    store.move(own, path)


def _writer(root: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        part = TaskContext.get().partitionId()
        encoder = encoder_of(vocabulary)
        end = np.asarray([end_id], encoder.dtype).tobytes()
        lengths, docs, nulls = [], [], []

        def ids():
            held, size = [], 0
            for batch in batches:
                texts = encoder.encode_all(t or "" for t in batch.column(1).to_pylist())
                for doc_id, x in zip(batch.column(0).to_pylist(), texts, strict=True):
                    x += end
                    docs.append(doc_id or 0)
                    nulls.append(doc_id is None)
                    lengths.append(len(x) // encoder.dtype.itemsize)
                    held.append(x)
                    size += len(x)
                    if size >= _BUFFER:
                        yield b"".join(held)
                        held, size = [], 0
            yield b"".join(held)

        store.create_dir(top, recursive=True)
        _put(store, f"{top}/ids-{part:05d}.bin", ids())
        n = np.asarray(lengths, "<u8")
        _put(store, f"{top}/docs-{part:05d}.bin", [np.asarray(docs, "<i8").tobytes()])
        _put(store, f"{top}/null-{part:05d}.bin", [np.asarray(nulls, "u1").tobytes()])
        _put(store, f"{top}/lengths-{part:05d}.bin", [n.tobytes()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(n)], pa.int64()), "ids": pa.array([int(n.sum())], pa.int64()), "width": pa.array([encoder.dtype.itemsize], pa.int32())})

    return run


def write(docs: DataFrame, root: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> list[tuple[int, int, int, int]]:
    """Write the files below ``root``; returns (part, base, documents, id width) per file.

    Documents are in ascending doc_id, null ids first, then by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(ranges(rows), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    done = ranged.mapInArrow(_writer(root, vocabulary, end_id), "part int, docs long, ids long, width int")
    base, parts = 0, []
    for r in sorted(done.collect()):  # one row for each file
        parts.append((r.part, base, r.docs, r.width))
        base += r.ids
    _each(spark, parts, _offsets(root), "part int").collect()
    return parts


def _each(spark: SparkSession, parts: list[tuple[int, int, int, int]], run, schema: str) -> DataFrame:
    """``run`` over the files, one task each."""
    n = max(1, len(parts))
    rows = spark.range(0, n, 1, n)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if i < len(parts):
                    yield from run(*parts[i])

    return rows.mapInArrow(of, schema)


def _offsets(root: str):
    def run(part: int, base: int, n_docs: int, width: int) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        with store.open_input_file(f"{top}/lengths-{part:05d}.bin") as f:
            n = np.frombuffer(f.read(), "<u8")
        at = np.concatenate([[np.uint64(base)], np.uint64(base) + np.cumsum(n, dtype=np.uint64)]).astype("<u8")
        _put(store, f"{top}/offsets-{part:05d}.bin", [at.tobytes()])
        store.delete_file(f"{top}/lengths-{part:05d}.bin")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

    # a repeated attempt finds the offsets already there
    def once(part: int, base: int, n_docs: int, width: int) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        if store.get_file_info(f"{top}/offsets-{part:05d}.bin").type != fs.FileType.NotFound:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})
        else:
            yield from run(part, base, n_docs, width)

    return once


def _mapped(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A memory map of a local file; other stores are read through their own buffer."""
    info = store.get_file_info(path)
    if not info.size:
        return np.empty(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def _reader(root: str):
    def run(part: int, base: int, n_docs: int, width: int) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        ids = _mapped(store, f"{top}/ids-{part:05d}.bin", f"<u{width}")
        offsets = _mapped(store, f"{top}/offsets-{part:05d}.bin", "<u8")
        docs = _mapped(store, f"{top}/docs-{part:05d}.bin", "<i8")
        null = _mapped(store, f"{top}/null-{part:05d}.bin", "u1")
        for first in range(0, len(docs), 4096):
            k = slice(first, min(first + 4096, len(docs)))
            at = offsets[k.start : k.stop + 1].astype(np.int64)
            crc = [zlib.crc32(np.ascontiguousarray(ids[a:b], dtype="<u4")) for a, b in zip(at[:-1] - base, at[1:] - base, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs[k], pa.int64(), mask=null[k].astype(bool)), "start": pa.array(at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def read_digests(spark: SparkSession, root: str, parts: list[tuple[int, int, int, int]]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (over 32-bit ids)."""
    return _each(spark, parts, _reader(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read the digests back.

    ``docs`` needs doc_id and text; other columns are ignored.

    Defined results: a null text is empty and has the end id alone; null doc_ids come first; rows
    that repeat a doc_id follow each other.  An empty table gives no rows.
    """
    root = _uri(Workspace(docs.sparkSession, "token-files").path("ids"))
    return read_digests(docs.sparkSession, root, write(docs, root, vocabulary, end_id))
