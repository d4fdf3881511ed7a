"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

A text is encoded by halves. Two encoded neighbours are joined by encoding a window around their border anew; the window grows
until the tokens outside it provably stay as they are. The join is associative in its result (the tokens of the
concatenation), so halves can be encoded apart and in any order. Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import ship

#: Characters that one leaf encodes in a single call, bytes of a leaf inside one long match, and the first window.
LEAF, PIECE_LEAF, WINDOW = 4096, 512, 32
#: Places where a match of the split pattern ends whatever stands further left or right: no alternative goes on from a letter to
#: something else, from a digit to something else, or from a visible character to white space.
BORDER = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)")


class Coder:
    """Encodes and decodes with one rank file and one split pattern."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF, window: int = WINDOW):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.single = self.plain._encode_single_piece  # takes bytes, also such as are no whole characters
        self.split = regex.compile(pattern)
        self.piece_of = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in self.piece_of}
        self.leaf, self.piece_leaf, self.window = leaf, piece_leaf, window

    def encode(self, text: str) -> list[int]:
        """The ids that encoding every match of the pattern on its own gives; no special tokens."""
        if len(text) <= self.leaf:
            return self.plain.encode_ordinary(text)
        middle = len(text) // 2
        return self.join(text, middle, self.encode(text[:middle]), self.encode(text[middle:]))

    def join(self, text: str, middle: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of ``text`` from those of its two parts.

        The window goes from the last border of the left part to the first one of the right part. Matches before a border are
        decided by what stands up to it and by the character behind it, matches after it by what follows, so both
        keep their tokens. A side without a border in the window is searched in a window twice as long; a side without
        any is encoded anew as a whole.
        """
        n = self.window
        while True:
            low, high = max(0, middle - n), min(len(text), middle + n)
            # the character before the window decides whether its first place is a border, so search from one further on
            places = [m.start() for m in BORDER.finditer(text, low, high)]
            start = max((p for p in places if low < p < middle), default=0 if low == 0 else None)
            end = min((p for p in places if middle < p < high), default=len(text) if high == len(text) else None)
            if start is not None and end is not None:
                break
            n *= 2
        drop_left, drop_right = len(text[start:middle].encode()), len(text[middle:end].encode())
        return self._without(left, drop_left, tail=True) + self._anew(text[start:end]) + self._without(right, drop_right, tail=False)

    def _without(self, ids: list[int], size: int, tail: bool) -> list[int]:
        """Leaves out the tokens of the last or first ``size`` bytes; these are whole tokens, as a border ends a match."""
        k = 0
        while size > 0:
            k += 1
            size -= len(self.piece_of[ids[-k if tail else k - 1]])
        return ids[: len(ids) - k] if tail else ids[k:]

    def _anew(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.plain.encode_ordinary(text)
        ids: list[int] = []
        for m in self.split.finditer(text):
            ids += self.piece(m[0].encode())
        return ids

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern. A long one is encoded by halves too.

        A sequence of tokens is the encoding of its bytes if each two neighbours are the encoding of theirs. So if the window
        begins and ends with the tokens that the halves had there, every pair outside has been seen before, and stays.
        """
        if len(data) <= self.piece_leaf:
            return self.single(data)
        left, right = self.piece(data[: len(data) // 2]), self.piece(data[len(data) // 2 :])
        n = 4
        while True:
            a, b = left[-n:], right[:n]
            ids = self.single(b"".join(self.piece_of[x] for x in a + b))
            if (len(a) == len(left) or ids[0] == a[0]) and (len(b) == len(right) or ids[-1] == b[-1]):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            n *= 2

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: leaves are looked up, halves concatenated."""
        if len(ids) <= self.leaf:
            return self.plain.decode_bytes(ids)
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


@lru_cache(maxsize=4)
def coder(path: str, pattern: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF, window: int = WINDOW) -> Coder:
    return Coder(path, pattern, leaf, piece_leaf, window)


def default_ranks() -> tuple[str, str]:
    """Rank file and split pattern of the installed public vocabulary for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks: tuple[str, str] | None = None, ids: bool = True, **tree: int) -> DataFrame:
    """Encodes ``text`` of every row and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, with the ids themselves as ``ids`` if asked for. A null text
    counts as empty; an empty one has no ids. Repeated rows and null doc_ids stay as they are, other columns go. ``ranks`` (file and
    pattern) must exist on every executor; by default they are looked up there. A row is encoded in one task, so
    memory follows the longest text, not the number of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*(ranks or default_ranks()), **tree)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text"):
                got = c.encode(text.as_py() or "")
                whole = hashlib.sha256(c.decode(got)).hexdigest()
                out.append((len(got), hashlib.sha256(",".join(map(c.digits.__getitem__, got)).encode()).hexdigest(), whole, got if ids else None))
            n, digest, whole, kept = zip(*out, strict=True) if out else ((), (), (), ())
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(whole, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * ids, names + ["ids"] * ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return ship(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
