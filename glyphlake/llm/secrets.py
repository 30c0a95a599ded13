"""Secrets in text: three fixed patterns and a token-efficiency test for random strings.

A random string costs a public subword vocabulary many tokens for few characters; words and
names cost few.  Candidates are long runs of key characters and, where a run is none, its parts
between = and /; known digests, identifiers and plain numbers are excluded; what falls under the
ratio is a secret.
Every text is scanned whole, in one Python pass without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, held

VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_CHARS = 16
#: Characters per token below which a candidate counts as random.
MAX_RATIO = 2.2
MASK = "[secret]"
KINDS = ("assign", "access", "hex", "random")

# Fixed values of the contract: the three base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more is a passing match of [0-9a-f]+
ASSIGN_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Words, optionally with a short number each, joined by separators: names, paths and slugs.
#: Runs of separators are possessive, so a long one is passed once.
_IDENTIFIER = re.compile(r"[/=+_-]*+(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,4}(?:[/=+_-]++(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,4})*+\Z")
_PARTS = re.compile(r"[^=/]+")
#: Characters that are encoded at once; a longer string is counted piece by piece.
_PIECE = 1024


class RandomStrings:
    """The token-efficiency test under a tiktoken vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.max_ratio = max_ratio

    def test(self, s: str) -> bool:
        if _DIGEST.match(s) or _UUID.match(s) or _IDENTIFIER.match(s):
            return False
        if not any(c.isalpha() for c in s):
            return False
        tokens = sum(len(self.encoding.encode_ordinary(s[i : i + _PIECE])) for i in range(0, len(s), _PIECE))
        return len(s) < self.max_ratio * tokens

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the random strings: whole runs, else parts of a run between = and /."""
        for run in _CANDIDATE.finditer(text):
            if self.test(run.group()):
                yield run.span()
                continue
            for part in _PARTS.finditer(text, *run.span()):
                if MIN_CHARS <= part.end() - part.start() < run.end() - run.start() and self.test(part.group()):
                    yield part.span()


def spans(text: str, lowered: bytes, random: RandomStrings) -> list[tuple[int, int, int]]:
    """All (start, kind number, end), sorted; offsets count code points, ends are exclusive."""
    out = []
    if any(k in lowered for k in ASSIGN_KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"akia" in lowered:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(a, 3, b) for a, b in random.spans(text)]
    out.sort()
    return out


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def masked(text: str, found: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """The text with every span, overlapping ones merged, replaced by ``mask``."""
    parts, at, end = [], 0, -1
    for a, _, b in found:
        if a >= end:
            if end >= 0:
                parts.append(mask)
                at = end
            parts.append(text[at:a])
            end = b
        end = max(end, b)
    return "".join([*parts, mask, text[end:]]) if found else text


def _scan(max_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = held(f"random strings {max_ratio}", lambda: RandomStrings(max_ratio=max_ratio))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = spans(text, text.encode().lower(), random)
                base = [x for x in found if x[1] < 3]
                counts = [sum(x[1] == k for x in base) for k in range(3)]
                rows.append((*counts, len(found) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), masked(text, found) if found else None))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "masked"])

    return run


def scan(docs: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, masked.

    ``docs`` needs doc_id and text; other columns are ignored.  ``masked`` is the whole text with
    its secrets replaced, null where there are none.

    Defined results: a null text is an empty one; a null doc_id stays null; repeated rows give
    repeated rows.  An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(max_ratio), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, masked string")


def _mask(max_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = held(f"random strings {max_ratio}", lambda: RandomStrings(max_ratio=max_ratio))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            clean = [None if t is None else masked(t, spans(t, t.encode().lower(), random)) for t in texts.to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(clean, texts.type))

    return run


def mask(docs: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced; the other columns stay as they are."""
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_mask(max_ratio), docs.schema)
