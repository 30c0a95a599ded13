"""Content streams as operations: a lexer and the relation of operations.

``operations`` is plain Python over bytes; ``content_ops`` applies it to pages in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

OPERAND = "tag string, num double, bytes binary"
SCHEMA = f"doc_id long, page int, seq long, operator string, operands array<struct<{OPERAND}, items array<struct<{OPERAND}>>>>"

_LEXER = re.compile(
    rb"(?P<space>[\x00\t\n\x0c\r ]+|%[^\r\n]*)"
    rb"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z))"
    rb"|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<dict><<|>>)|(?P<hex><[^>]*>)|(?P<open>\()|(?P<bracket>[\[\]])"
    rb"|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<other>.)",
    re.S,
)
_STRING_END = re.compile(rb"[()\\]")
_ESCAPED = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}
_NOT_HEX = re.compile(rb"[^0-9A-Fa-f]")
_NAME_CODE = re.compile(rb"#([0-9A-Fa-f]{2})")


class Name(bytes):
    """A name without its slash."""


class Reference(tuple):
    """An object number and generation."""


def literal_string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose first byte after the parenthesis is at ``at``, and where it ends."""
    out, depth = [], 1
    while True:
        m = _STRING_END.search(data, at)
        if m is None:
            return b"".join([*out, data[at:]]), len(data)
        out.append(data[at : m.start()])
        at = m.end()
        if m[0] == b"(":
            depth += 1
            out.append(b"(")
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return b"".join(out), at
            out.append(b")")
        elif at < len(data):
            c = data[at]
            if 0x30 <= c <= 0x37:
                octal = re.compile(rb"[0-7]{1,3}").match(data, at)[0]
                out.append(bytes([int(octal, 8) & 255]))
                at += len(octal)
            elif c == 0x0D:  # a line break after a backslash is left out
                at += 2 if data[at + 1 : at + 2] == b"\n" else 1
            elif c == 0x0A:
                at += 1
            else:
                out.append(_ESCAPED.get(c, bytes([c])))
                at += 1


def hex_string(token: bytes) -> bytes:
    """The bytes of ``<...>``; an odd last digit counts as the first of two."""
    digits = _NOT_HEX.sub(b"", token)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def name(token: bytes) -> Name:
    return Name(_NAME_CODE.sub(lambda m: bytes([int(m[1], 16)]), token[1:]))


#: Digits of whole numbers that stay whole; longer ones are reals, at last infinite.
_WHOLE = 300


def number(token: bytes) -> int | float:
    return float(token) if b"." in token or len(token) > _WHOLE else int(token)


def operations(data: bytes) -> Iterator[tuple[str, list[Any]]]:
    """(operator, operands) in order.  Bytes that are no token are passed over."""
    at, stack = 0, [[]]
    while at < len(data):
        m = _LEXER.match(data, at)
        at, kind, token = m.end(), m.lastgroup, m[0]
        top = stack[-1]
        if kind == "number":
            top.append(number(token))
        elif kind == "name":
            top.append(name(token))
        elif kind == "open":
            value, at = literal_string(data, at)
            top.append(value)
        elif kind == "hex":
            top.append(hex_string(token))
        elif kind == "bracket" and token == b"[" or kind == "dict" and token == b"<<":
            stack.append([])
        elif kind in ("bracket", "dict") and len(stack) > 1:
            value = stack.pop()
            stack[-1].append(value if kind == "bracket" else dict(zip(value[::2], value[1::2], strict=False)))
        elif kind == "word":
            if token in (b"true", b"false", b"null"):
                top.append({b"true": True, b"false": False, b"null": None}[token])
                continue
            operands, stack = stack[0] + [x for part in stack[1:] for x in part], [[]]
            yield token.decode("latin-1"), operands
            if token == b"ID":  # the data of an inline image ends before EI between white space
                end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(data, at)
                at = end.start() if end else len(data)


def tagged(value: Any) -> dict[str, Any]:
    """An operand as a row."""
    row: dict[str, Any] = {"tag": "null", "num": None, "bytes": None, "items": None}
    if isinstance(value, bool):
        row |= {"tag": "boolean", "num": float(value)}
    elif isinstance(value, int):
        row |= {"tag": "integer", "num": float(value)}
    elif isinstance(value, float):
        row |= {"tag": "real", "num": value}
    elif isinstance(value, Name):
        row |= {"tag": "name", "bytes": bytes(value)}
    elif isinstance(value, bytes):
        row |= {"tag": "string", "bytes": value}
    elif isinstance(value, list):
        row |= {"tag": "array", "items": [{k: v for k, v in tagged(x).items() if k != "items"} for x in value]}
    elif isinstance(value, dict):
        row["tag"] = "dictionary"
    elif isinstance(value, Reference):
        row["tag"] = "reference"
    return row


_TYPE = pa.struct([("tag", pa.string()), ("num", pa.float64()), ("bytes", pa.binary())])
_OPERANDS = pa.list_(pa.struct([*_TYPE, pa.field("items", pa.list_(_TYPE))]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, pages, seqs, ops, operands = [], [], [], [], []
        for doc_id, page, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for seq, (op, values) in enumerate(operations(content or b"")):
                docs.append(doc_id)
                pages.append(page)
                seqs.append(seq)
                ops.append(op)
                operands.append([tagged(v) for v in values])
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pages, pa.int32()), pa.array(seqs, pa.int64()), pa.array(ops, pa.string()), pa.array(operands, _OPERANDS)], names=["doc_id", "page", "seq", "operator", "operands"])


def content_ops(pages: DataFrame) -> DataFrame:
    """One row for each operation of (doc_id, page, content)."""
    return pages.select("doc_id", "page", "content").mapInArrow(_rows, SCHEMA)
