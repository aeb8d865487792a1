"""Token counts, where huge documents are encoded in overlapping chunks that are spliced again.

Two chunks overlap. A place where both part words is one where the whole text does: the first chunk,
right from its start, has seen enough of what follows, and splitting from there on only depends on what
follows. So the counts before it are taken from the first chunk and those after it from the second. Where
the overlap has no such place it is widened, up to the whole first chunk.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers; beyond that it starts anew. About 130 bytes each.
REMEMBERED = 1_200_000
#: Characters of a chunk, and of the first overlap of two.
CHUNK = 16_384
OVERLAP = 256
#: Pieces encoded in one call.
TOGETHER = 500
#: What the tokenizer's file says of a byte-level one whose words take the space before them.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def parted(left: str, right: str) -> bool:
    """Whether a space between two pieces surely begins a word: no white space touches it."""
    return bool(left) and bool(right) and not left[-1].isspace() and not right[0].isspace()


class TokenCounter:
    """count() gives how many tokens a text has."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self.by_piece = layout["normalizer"] is None and layout["pre_tokenizer"] == BYTE_LEVEL
        # a special token that a chunk's end cuts looks like other text
        self.margin = 2 + max((len(t["content"]) for t in layout["added_tokens"]), default=0)
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        """Tokens of a text; of a null or empty one, none."""
        if not text:
            return 0
        if not self.by_piece:
            [got] = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            return len(got.ids)
        if len(text) <= self.chunk:
            return sum(self._pieces(text)[1])
        return self._spliced(text)

    def _spliced(self, text: str) -> int:
        # `total` counts what lies before `done`, a sure place; `base` is what the chunk at hand has before it
        total = done = base = 0
        end = self.chunk
        stops, counts = self._stops(text[:end], 0)
        while end < len(text):
            overlap, until = self.overlap, min(len(text), end + self.chunk)
            while True:
                begin = max(done, end - overlap)
                if begin == done:
                    # nothing in common: a longer chunk from the sure place on, at least twice as long
                    until = min(len(text), max(until, 2 * end - done))
                    stops, counts = self._stops(text[done:until], done)
                    base = 0
                    break
                next_stops, next_counts = self._stops(text[begin:until], begin)
                common = {p for p in stops if done <= p <= end - self.margin}.intersection(next_stops)
                if common:
                    splice = max(common)
                    total += counts[stops.index(splice)] - base
                    base, done = next_counts[next_stops.index(splice)], splice
                    stops, counts = next_stops, next_counts
                    break
                overlap *= 2
            end = until
        return total + counts[-1] - base

    def _stops(self, text: str, at: int) -> tuple[list[int], list[int]]:
        """Where words part in a chunk, as places in the text, and the tokens of the chunk up to each."""
        pieces, numbers = self._pieces(text)
        stops: list[int] = []
        counts: list[int] = []
        place, tokens = at, 0
        for piece, n in zip(pieces, numbers):
            if "  " in piece or piece[-1].isspace() or piece[:1].isspace() and piece[1:2].isspace():
                # offsets of the tokens say where the words within it part
                got = self.tokenizer.encode(piece, add_special_tokens=False)
                before = None
                for i, (word, (a, _)) in enumerate(zip(got.word_ids, got.offsets)):
                    if i and word != before and a > 0:
                        stops.append(place + a)
                        counts.append(tokens + i)
                    before = word
            place += len(piece)
            tokens += n
            stops.append(place)
            counts.append(tokens)
        return stops, counts

    def _pieces(self, text: str) -> tuple[list[str], list[int]]:
        """A text in pieces that begin at sure places, and the tokens of each."""
        first, *rest = text.split(" ")
        # all but the first have their space before them
        numbers = list(map(self.known.get, rest))
        if None in numbers:
            self._learn({p for p, n in zip(rest, numbers) if n is None and parted(p, p)})
            numbers = list(map(self.known.get, rest))
        if first and not first[-1].isspace() and None not in numbers:
            return [first, *(f" {p}" for p in rest)], [self._alone(first), *numbers]
        joined, last = [[first]], first
        for p in rest:
            if parted(last, p):
                joined.append([f" {p}"])
            else:
                joined[-1].append(f" {p}")
            last = p
        pieces = ["".join(some) for some in joined]
        found = [self.known.get(p[1:]) if i and p[:1] == " " and parted(p[1:], p[1:]) else None for i, p in enumerate(pieces)]
        return pieces, [self._alone(p) if n is None else n for p, n in zip(pieces, found)]

    def _alone(self, piece: str) -> int:
        [got] = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)
        return len(got.ids)

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        listed = list(pieces)
        for i in range(0, len(listed), TOGETHER):
            some = listed[i : i + TOGETHER]
            got = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            starts = [a for a, _ in got.offsets]
            begins = list(accumulate((len(p) + 1 for p in some), initial=0))
            at = np.searchsorted(starts, begins).tolist()
            self.known.update((p, b - a) for p, a, b in zip(some, at, at[1:]))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter per worker and file; what it remembers serves later tasks too."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8) and n_tokens.

    Special strings inside texts count as the tokenizer takes them by default; none are added. A null or
    empty text has no bytes and no tokens. Each row gives one row, repeated rows and rows without a doc_id
    too; an empty table gives none. Only doc_id and text are read, whatever other columns there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            numbers = pa.array([own.count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], numbers], names=["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").cast("string").alias("text"),
    )
    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
