"""Byte-level BPE by a contiguous rank array (operator 9).

A word is held as its part boundaries beside the rank of each adjacent pair.
The smallest rank is found by a scan, its boundary is deleted and the two
neighbouring ranks are refreshed, until no pair has a rank. Words are short, so
a scan over a contiguous list beats any heap. A scan's work grows with the square
of a word's bytes, so a piece longer than ``scan_bytes`` (a long run of one class
without white space) takes a heap over the same pairs, which gives the same merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, quoted, type_of, without
from siltstone.llm.pieces import Splitter, Store, load

NO_RANK = 1 << 60
#: Pieces of up to so many bytes are scanned; at about this length a heap becomes as fast.
SCAN_BYTES = 96
SLICE_BYTES = 4 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


class RankedMerges:
    """Pair ranks by token ids, and the bytes of every token."""

    def __init__(self, path: str, scan_bytes: int = SCAN_BYTES):
        self.scan_bytes = scan_bytes
        spec = json.loads(load(path).to_str())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.shift = max(vocab.values()).bit_length()
        self.rank, self.merged = {}, []
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] << self.shift | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.token_bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.token_bytes |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}

    def encode_piece(self, piece: bytes) -> list[int]:
        parts = [self.first[b] for b in piece]
        if len(parts) > self.scan_bytes:
            return self._encode_long(parts)
        shift, rank, merged = self.shift, self.rank.get, self.merged
        ranks = [rank(a << shift | b, NO_RANK) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            parts[at] = merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << shift | parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(parts[at] << shift | parts[at + 1], NO_RANK)
        return parts

    def _encode_long(self, parts: list[int]) -> list[int]:
        n, shift, rank = len(parts), self.shift, self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << shift | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(parts[a] << shift | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.encode_piece(p) for p in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are not UTF-8 become U+FFFD, as the tokenizers library has it."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def ranked_merges(path: str) -> RankedMerges:
    return RankedMerges(path)


@lru_cache(maxsize=2)
def ranked_store(path: str) -> Store:
    """One store for each Python worker, so that its tasks share the words met."""
    return Store(Splitter(path), ranked_merges(path).encode)


def _with_columns(batch: pa.RecordBatch, drop: str, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != drop]
    return pa.RecordBatch.from_pydict(dict(kept) | extra)


def encode_texts(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace ``text_col`` by its token ids, an array of ints.

    ``vocabulary`` is the path of a byte-level BPE file on every executor. A null
    or empty text has no ids; special tokens in a text are recognised as such;
    texts of any length are encoded whole. Other columns pass through, repeated
    rows stay repeated and an empty table stays empty. Another column named
    ``ids_col`` is replaced.
    """
    docs = without(docs, *{ids_col} - {text_col})
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = ranked_store(vocabulary)
        for part in arrays.slices(batches, text_col, SLICE_BYTES):
            ids, rows = store(part.column(part.schema.get_field_index(text_col)))
            lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids.astype(np.int32)))
            yield _with_columns(part, text_col, {ids_col: lists})

    schema = docs.select(*map(quoted, rest)).schema.add(ids_col, ArrayType(IntegerType()))
    return map_arrow(docs.select(*map(quoted, [*rest, text_col])), run, schema)


def decode_ids(docs: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Replace ``ids_col`` by the text it decodes to (null ids: the empty text).

    An id that the vocabulary lacks raises KeyError. Another column named
    ``text_col`` is replaced; repeated rows and empty tables stay as they are.
    """
    docs = without(docs, *{text_col} - {ids_col})
    rest = [c for c in docs.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = ranked_merges(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            texts = [merges.decode(np.asarray(x.values)) if x.is_valid else "" for x in column]
            yield _with_columns(batch, ids_col, {text_col: pa.array(texts, pa.string())})

    schema = docs.select(*map(quoted, rest)).schema.add(text_col, "string")
    return map_arrow(docs.select(*map(quoted, [*rest, ids_col])), run, schema)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; keep digests of both sides instead of the ids.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` for each row, nulls
    as empty texts: what ``encode_texts`` and ``decode_ids`` give, hashed where
    the ids are, so that ids never leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, store = ranked_merges(vocabulary), ranked_store(vocabulary)
        for part in arrays.slices(batches, "text", SLICE_BYTES):
            ids, rows = store(part.column(1))
            raw, at = ids.astype("<u4", copy=False), rows.tolist()
            spans = list(zip(at, at[1:]))  # noqa: B905
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(rows)),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans]),
                    pa.array([hashlib.sha256(merges.decode(ids[a:b]).encode()).hexdigest() for a, b in spans]),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"{quoted(id_col)} {type_of(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.selectExpr(quoted(id_col), f"{quoted(text_col)} AS text"), run, schema)

