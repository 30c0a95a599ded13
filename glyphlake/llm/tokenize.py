"""Token ids of whole texts as bytes, with a memo of the pieces of a text.

The public vocabularies first cut a text into pieces by a fixed pattern and encode each piece by
itself, so a text's ids are the joined ids of any pieces cut at places where the pattern cuts, too:

- before a space, or around a line break, that is the only white space there;
- before a point or comma that stands next to letters, digits and white space only;
- where white space is dropped, at all of it; case is folded first in Latin-1 texts.

Texts with runs of white space that cannot be cut this way are encoded whole.  The texts of a batch
are cut and their pieces numbered by Arrow's kernels, each distinct piece is looked up once, and
the ids are gathered by numpy.  Unknown pieces are encoded together in one string and told apart by
ids that only begin or end a piece.  The memo keeps two generations of a fixed size, so pieces in
use survive and memory is bounded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .storage import held

_MEMO_PIECES = 250_000
#: Characters of texts that are cut and encoded together.
_TOGETHER = 4 << 20
_RUN = re.compile(r"\s(?=\s)")
#: Points and commas that are not pieces of their own: next to a symbol, or also after a space.
_BOUND_MARK = re.compile(r"[.,](?:(?<=[^\w\s].)|(?<=_.)|(?=[^\w\s]|_))", re.S)
_BOUND_OR_SPACED_MARK = re.compile(r"[.,](?:(?<=[\W_].)|(?=[^\w\s]|_))", re.S)
#: Between texts.
_END = "\x02"
#: Control characters, some of which are white space to one library only; a text that holds one, which
#: may be the sign of a cut or an end, too, is encoded whole.
_ODD = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


class _Memo(dict):
    """The younger generation of piece -> ids; a piece of the older one moves over on use."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def turn(self) -> None:
        """Begin a new generation if this one is full."""
        if len(self) >= _MEMO_PIECES:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        self[piece] = ids = self.encode(piece) if ids is None else ids
        return ids


class Encoder:
    """Encodes texts to little-endian ids of 2 or 4 bytes with a file of the tokenizers library.

    The ids are those of the library's plain call on the whole text, special tokens included.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        # strings with an id of their own are found in the whole text, before it is cut
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()}, key=len)
        self.whole = re.compile("|".join([_ODD, *map(re.escape, added)]), re.I)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # white space is dropped and case folded by the one kind; the other keeps both
        self.drops_space = self.plain_ids("a B") == self.plain_ids("a") + self.plain_ids("b")
        # ids that can only begin a piece, as the byte-level letter of a space comes first, or that
        # can only end one
        self.opens, self.closes = (np.zeros(self.tokenizer.get_vocab_size(), bool) for _ in range(2))
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i], self.closes[i] = token.startswith("Ġ"), token.endswith("</w>")
        self.newline = None if self.drops_space else self.plain_ids("\n")[0]
        self.memo = _Memo(lambda piece: np.asarray(self.plain_ids(piece), self.dtype).tobytes())

    def plain_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _cut(self, text: str) -> str | None:
        """The text with its cuts marked; None where it must be encoded whole."""
        if self.whole.search(text):
            return None
        if self.drops_space:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
            text = text.lower()
            return text if _BOUND_MARK.search(text) else text.replace(".", " .").replace(",", " ,")
        if text[:1].isspace() or text[-1:].isspace() or _RUN.search(text):
            return None
        text, marks = text.replace(" ", "\0 ").replace("\n", "\0\n\0"), text
        return text if _BOUND_OR_SPACED_MARK.search(marks) else text.replace(".", "\0.").replace(",", "\0,")

    def _learn(self, pieces: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Remember ids[start:end] of each piece if the places could be told apart."""
        if len(pieces) == len(starts) == len(ends):
            raw, size = ids.tobytes(), self.dtype.itemsize
            self.memo.update(zip(pieces, [raw[a:b] for a, b in zip((starts * size).tolist(), (ends * size).tolist(), strict=True)], strict=True))

    def _learn_all(self, unknown: list[str]) -> None:
        """Encode unknown words together; what is left out here is encoded by itself on use."""
        if self.drops_space:
            words = [c for c in unknown if c.isalpha() and c.islower() and max(c) <= "ÿ"]
            ids = self._together(" ".join(words))
            ends = np.flatnonzero(self.closes[ids]) + 1
            self._learn(words, ids, np.append(0, ends[:-1]) if len(ends) else ends, ends)
            return
        words = [c for c in unknown if c[1:].isalpha() and c[0] == " "]
        ids = self._together("".join(words))
        starts = np.flatnonzero(self.opens[ids])
        self._learn(words, ids, starts, np.append(starts[1:], len(ids)) if len(starts) else starts)
        words = [c for c in unknown if c.isalpha()]
        ids = self._together("".join(f"\n{c}" for c in words))
        breaks = np.flatnonzero(ids == self.newline)
        self._learn(words, ids, breaks + 1, np.append(breaks[1:], len(ids)) if len(breaks) else breaks)

    def _together(self, text: str) -> np.ndarray:
        return np.asarray(self.plain_ids(text), self.dtype)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _TOGETHER:
                yield from self._encode_group(group)
                group, size = [], 0
        if group:
            yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self._cut(t) for t in texts]
        joined = (f" {_END} " if self.drops_space else f"\0{_END}\0").join("" if c is None else c for c in cut)
        one = pa.array([joined], pa.large_string())
        parts = pc.ascii_split_whitespace(one) if self.drops_space else pc.split_pattern(one, "\0")
        coded = parts.flatten().dictionary_encode()
        pieces, nth = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        memo, old = self.memo, self.memo.old
        known = list(map(memo.get, pieces))
        missing = [k for k, ids in enumerate(known) if ids is None]
        self._learn_all([pieces[k] for k in missing if pieces[k] not in old])
        for k in missing:
            known[k] = memo[pieces[k]] if pieces[k] and pieces[k] != _END else b""
        memo.turn()
        end = pieces.index(_END) if len(texts) > 1 else -1
        del one, parts, coded, pieces
        # ids of piece k are flat[start[k]:start[k] + size[k]]; a text of 2^31 ids is out of reach
        flat = np.frombuffer(b"".join(known), self.dtype)
        size = np.fromiter(map(len, known), np.int32, len(known)) // self.dtype.itemsize
        start = np.cumsum(size, dtype=np.int32) - size
        sizes = size[nth]
        upto = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(start[nth] - upto + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        ids = flat[at]
        bounds = [0, *upto[np.flatnonzero(nth == end)].tolist(), len(ids)]
        raw, width = ids.tobytes(), self.dtype.itemsize
        del flat, known, sizes, upto, at, ids, nth
        pa.default_memory_pool().release_unused()
        for text, c, a, b in zip(texts, cut, bounds[:-1], bounds[1:], strict=True):
            yield self.memo.encode(text) if c is None else raw[a * width : b * width]


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker process, whose memo serves all its tasks."""
    return held(f"encoder {vocabulary}", lambda: Encoder(vocabulary))
