"""Harmonic packing of token sequences, with no shuffle: each worker fills its own bins.

A length r <= capacity belongs to class k = capacity // r, whose bins take exactly k pieces of up to capacity / k
tokens. Documents are cut so that nearly all tokens lie in classes that waste nothing: whole sequences, then halves,
quarters and so on down to `grain` tokens; only what remains below `grain` goes to a class with a remainder, where a
full bin wastes less than one token in grain. Bins that a worker can't fill are merged at its end, largest piece
first into the fullest bin that takes it; there are fewer than grain * capacity such tokens.

Ids are those of the tokenizer file. Nearly all texts get them from the ranks and split pattern of the same vocabulary,
at a quarter of the time (tests compare both); that pattern looks ahead at the end of white space and gives up on runs of
about a million characters, so texts with a run of `LONG_RUN` go through the tokenizer file itself.

Defined cases: a null or empty text is its end id alone; repeated rows are packed once each; null ids stay null; an
empty table gives no piece; further columns are ignored; a text of any length, whatever its runs, is cut into whole
sequences.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import tidied

CAPACITY, GRAIN, END_ID = 1024, 64, 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequence ids are the worker's partition number times this, plus a count from 0.
STRIDE = 1 << 36
#: Characters of white space in a row from which on the look-ahead of the split pattern is avoided.
LONG_RUN = 100_000
_RUN = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


@cache
def encoder(file: str, ranks_path: str, pattern: str, specials: tuple[tuple[str, int], ...]) -> Callable[[str], list[int]]:
    """A function from text to the ids of the tokenizer file; made once in each Python worker."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))

    @cache
    def exact() -> Tokenizer:
        return Tokenizer.from_file(file)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and _RUN.search(text):
            return exact().encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


def cut(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then exact halves down to grain, then what is left."""
    out, n = [capacity] * (n // capacity), n % capacity
    size = capacity // 2
    while size >= grain:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Bins:
    """One worker's bins. `place` and `close` yield (piece, bin, offset); bins count from 0."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.next, self.open = capacity, 0, {}

    def _emit(self, held: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        at = 0
        for p in held:
            yield p, self.next, at
            at += len(p[2])
        self.next += 1

    def place(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        k = self.capacity // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            yield from self._emit(self.open.pop(k))

    def close(self) -> Iterator[tuple[Piece, int, int]]:
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -len(p[2]))
        bins: list[list[Piece]] = []
        room: list[int] = []
        for p in rest:
            n = len(p[2])
            fits = [i for i, r in enumerate(room) if r >= n]
            i = min(fits, key=room.__getitem__, default=len(bins))
            if i == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[i].append(p)
            room[i] -= n
        for held in bins:
            yield from self._emit(held)
        self.open = {}


def pack(docs: DataFrame, file: str, ranks_path: str, pattern: str, specials: tuple[tuple[str, int], ...] = (), capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text), with its ids as little-endian unsigned 32-bit bytes.

    file and ranks_path: one vocabulary as a tokenizer file and as ranks, which pattern and specials go with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(file, ranks_path, pattern, specials), Bins(capacity)
        first = TaskContext.get().partitionId() * STRIDE
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def add(placed: Iterator[tuple[Piece, int, int]]) -> None:
            out.extend((d, at, len(ids), ids.tobytes(), n, first + b, off) for (d, at, ids, n), b, off in placed)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                at = 0
                for n in cut(len(ids), capacity, grain):
                    add(bins.place((doc, at, ids[at : at + n].copy(), len(ids))))
                    at += n
                    if len(out) >= 2048:
                        yield batch()
        add(bins.close())
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
