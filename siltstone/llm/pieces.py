"""Text to tokenizer pieces to ids, a slice of rows at a time.

Both vocabularies split text into pieces by character class before any merge,
and a piece's ids depend on the piece alone. So the pieces of a slice are found
with array operations, equal pieces are numbered once by Arrow, and only pieces
not met before reach the encoder behind a bounded store.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from siltstone.llm import arrays

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
BLANK, QUOTE = 0x20, 0x27
#: Code points from here on may change when a text is normalised; the blocks of
#: plain punctuation and currency signs below never do.
_PLAIN_END = 0x300
_PLAIN_BLOCKS = ((0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0))


@lru_cache(maxsize=8)
def load(path: str) -> Tokenizer:
    """The vocabulary file, with any truncation and padding off."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Splitter:
    """Finds the pieces of texts as a vocabulary's own pre-tokenizer does.

    ``prefixed`` vocabularies keep white space and join one blank to the piece
    after it; the others fold case, drop white space and part every digit.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(re.escape(s.decode()) for s in self.specials)) if self.specials else None
        self.prefixed = spec["normalizer"] is None
        self._classes = np.zeros(0x110000, np.uint8)
        if not self.prefixed:
            self._lower = np.arange(_PLAIN_END, dtype=np.uint32)
            self._unsafe = np.zeros(_PLAIN_END, bool)
            for c in range(_PLAIN_END):
                folded = self.tokenizer.normalizer.normalize_str(chr(c))
                self._unsafe[c] = len(folded) != 1
                self._lower[c] = ord(folded) if len(folded) == 1 else c

    def _class_of(self, points: np.ndarray) -> np.ndarray:
        found = self._classes[points]
        if not found.all():
            for c in np.unique(points[found == 0]).tolist():
                self._classes[c] = self._ask(chr(c))
            found = self._classes[points]
        return found

    def _ask(self, char: str) -> int:
        """The class that the vocabulary's pre-tokenizer gives a character."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if self.prefixed:
            if len(split("a" + char)) == 1:
                return LETTER
            if len(split("1" + char)) == 1:
                return NUMBER
            return OTHER if len(split("!" + char)) == 1 else SPACE
        if not split(char):
            return SPACE
        if len(split("a" + char)) == 1:
            return LETTER
        return OTHER if len(split("!" + char)) == 1 else NUMBER

    def is_space(self, piece: bytes) -> bool:
        return self._classes[ord(piece.decode()[0])] == SPACE

    def _folded(self, text: str) -> str:
        """Normalised around special tokens, which stay as they are."""
        out, at = [], 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            out += [self.tokenizer.normalizer.normalize_str(text[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, self.tokenizer.normalizer.normalize_str(text[at:])])

    def _points(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = arrays.utf8(column)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = (data & 0xC0) != 0x80
        bounds = np.concatenate([np.zeros(1, np.int32), np.cumsum(begins, dtype=np.int32)])[offsets].astype(np.int64)
        if self.prefixed:
            return points, bounds
        odd = points >= _PLAIN_END
        for low, high in _PLAIN_BLOCKS:
            odd &= (points < low) | (points >= high)
        odd[~odd] = self._unsafe[np.minimum(points[~odd], _PLAIN_END - 1)] & (points[~odd] < _PLAIN_END)
        if odd.any():
            changed = np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1)
            parts = [points[bounds[i] : bounds[i + 1]] for i in range(len(column))]
            for i in changed.tolist():
                parts[i] = np.frombuffer(self._folded(parts[i].tobytes().decode("utf-32-le")).encode("utf-32-le"), np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            points = np.concatenate(parts)
        return points, bounds

    def split(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes, the bounds of the pieces in them, the bounds of the rows in the pieces."""
        points, bounds = self._points(column)
        n = len(points)
        if n == 0:
            return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(len(column) + 1, np.int64)
        edges, special = bounds, []
        if self.special_pattern and any(s in (raw := arrays.utf8(column)[0].tobytes()) for s in self.specials):
            text = points.tobytes().decode("utf-32-le")
            row_of = lambda i: int(np.searchsorted(bounds, i, "right"))
            special = [m.span() for m in self.special_pattern.finditer(text) if row_of(m.start()) == row_of(m.end() - 1)]
            edges = np.unique(np.concatenate([bounds, np.array(special, np.int64).ravel()]))
        if not self.prefixed:
            plain = points < _PLAIN_END
            lowered = points.copy()
            lowered[plain] = self._lower[points[plain]]
            for a, b in special:
                lowered[a:b] = points[a:b]
            points = lowered
        starts = self._starts(points, edges)
        for a, b in special:
            starts[a + 1 : b] = False
            starts[a] = True
        at = np.flatnonzero(starts)
        size = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
        data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        return data, np.concatenate([byte_at[at], byte_at[-1:]]), np.searchsorted(at, bounds).astype(np.int64)

    def _starts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        kind, n = self._class_of(points), len(points)
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        run = np.empty(n, bool)
        run[0], run[1:] = True, kind[1:] != kind[:-1]
        run |= edge[:n]
        space = kind == SPACE
        starts = run.copy()
        if self.prefixed:
            joined = np.zeros(n, bool)
            joined[1:] = ~space[1:] & (points[:-1] == BLANK) & ~edge[1:n]
            starts &= ~joined
            last = np.zeros(n, bool)
            last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
            starts |= last
        else:
            starts |= kind == NUMBER
        # An apostrophe that is a piece of its own takes a contraction's letters with it.
        quote = np.flatnonzero(starts[:-1] & (points[:-1] == QUOTE) & (kind[1:] == LETTER) & ~edge[1:n])
        if len(quote):
            padded, closed = np.append(points, [0, 0, 0]), np.append(edge[: n + 1], [True, True])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                pair |= (one == ord(a)) & (two == ord(b))
            pair &= ~short & ~closed[quote + 2]
            starts[quote[short | pair] + 1] = False
            for q in (quote[short] + 2, quote[pair] + 3):
                starts[q[q < n]] = True
        return starts


class Store:
    """Ids of the pieces met of late, as packed uint32; two generations of ``most`` pieces.

    A piece found in the old generation moves to the young one; when that is
    full it becomes the old one. So frequent pieces stay and memory is bounded.
    ``encode`` turns a list of pieces into a list of id lists.
    """

    def __init__(self, splitter: Splitter, encode: Callable[[list[bytes]], list[list[int]]], most: int = 250_000):
        self.splitter, self.encode, self.most = splitter, encode, most
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._fixed = {p: np.array([i], np.uint32).tobytes() for p, i in splitter.specials.items()}

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        if len(self._young) >= self.most:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        found = list(map(young.get, pieces))
        fresh = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            p = pieces[k]
            ids = old.get(p)
            if ids is None:
                ids = self._fixed.get(p)
            if ids is None and not self.splitter.prefixed and self.splitter.is_space(p):
                ids = b""
            if ids is None:
                fresh.append(k)
            else:
                young[p] = found[k] = ids
        if fresh:
            for k, ids in zip(fresh, self.encode([pieces[k] for k in fresh]), strict=True):
                young[pieces[k]] = found[k] = array("I", ids).tobytes()
        return found

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice (uint32) and the bounds of its rows in them."""
        data, bounds, rows = self.splitter.split(column)
        if len(bounds) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        piece, distinct = arrays.numbered(data, bounds)
        packed = self._look_up(distinct)
        length = np.fromiter(map(len, packed), np.int32, len(packed)) >> 2
        start = np.cumsum(length) - length
        lengths = length[piece]
        ids = arrays.take_ragged(np.frombuffer(b"".join(packed), np.uint32), start[piece], lengths)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[rows]


def library_encoder(splitter: Splitter) -> Callable[[list[bytes]], list[list[int]]]:
    """Encodes pieces with the tokenizers library, many to a call.

    Pieces are joined by a line end or a blank, at which the pre-tokenizer parts
    them again, and their ids are told apart by the separator's own id or by the
    tokens that end a word. Pieces that hold white space go one by one.
    """
    tokenizer = splitter.tokenizer
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    if splitter.prefixed:
        (mark,) = tokenizer.encode("\n", add_special_tokens=False).ids
    else:
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def joined(texts: list[str]) -> list[list[int]] | None:
        glue = "\n" if splitter.prefixed else " "
        ids = np.array(tokenizer.encode(glue.join(texts) + glue, add_special_tokens=False).ids, np.int64)
        at = np.flatnonzero(ids == mark if splitter.prefixed else ends[ids])
        if len(at) != len(texts):
            return None
        every, stops = ids.tolist(), at.tolist()
        if splitter.prefixed:
            return [every[a:b] for a, b in zip([0, *(k + 1 for k in stops)], stops)]  # noqa: B905
        return [every[a : b + 1] for a, b in zip([0, *(k + 1 for k in stops)], stops)]  # noqa: B905

    def encode(pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode() for p in pieces]
        out: list[list[int] | None] = [None] * len(texts)
        easy = [k for k, t in enumerate(texts) if not any(map(str.isspace, t[1:])) and not t.isspace()]
        for a in range(0, len(easy), 256):
            part = easy[a : a + 256]
            for k, ids in zip(part, joined([texts[k] for k in part]) or (), strict=False):
                out[k] = ids
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    return encode


@lru_cache(maxsize=2)
def library_store(path: str) -> Store:
    """One store for each Python worker, so that its tasks share the pieces met."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    splitter = Splitter(path)
    return Store(splitter, library_encoder(splitter))
