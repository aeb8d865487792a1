"""Byte-level BPE by replaying the merges over the words of many documents at once.

The different words of a block of the corpus are laid out as one row of symbols. An index leads from each
pair of neighbours, named by the token it makes, to the places where it stands; taking the tokens in rank
order and touching only the neighbours of each place applies every merge to all words together. Words are
then remembered, so that later documents look them up.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker remembers; beyond that it starts anew. About 200 bytes each.
REMEMBERED = 800_000
#: Longer words, in characters, are encoded each time they come up.
LONGEST_REMEMBERED = 64
#: Texts of more characters are split into words step by step.
BLOCK = 1 << 18
#: Documents taken at a time.
ROWS = 1_000
#: Words that are looked at before the unknown ones among them are encoded.
TOGETHER = 1 << 18


def merge_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def later_letters() -> str:
    """Letters and digits of this Unicode that the tiktoken library's older one doesn't know, as a class.

    The library is asked: of a point it takes for a letter it makes one word with an "a", of a digit with "1".
    """
    import sys
    import unicodedata

    import regex
    import tiktoken

    later = ""
    for kind, mate in (("L", "a"), ("N", "1")):
        known = regex.compile(rf"\p{{{kind}}}")
        asked = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and known.match(c)]
        ranks = {bytes([b]): b for b in range(256)} | {(c + mate).encode(): 256 + i for i, c in enumerate(asked)}
        library = tiktoken.Encoding("asked", pat_str=rf"\p{{{kind}}}+|[^\p{{{kind}}}]+", mergeable_ranks=ranks, special_tokens={})
        taken = set(library.encode_ordinary("".join(f"{c}{mate}!" for c in asked)))
        later += "".join(c for i, c in enumerate(asked) if 256 + i not in taken)
    return later


def replay(words: Iterable[bytes], ranks: dict[bytes, int], spelt: Sequence[bytes]) -> dict[bytes, list[int]]:
    """The ids of each word: itself where it is a token, else what the merges leave of its bytes."""
    single = [ranks[bytes([b])] for b in range(256)]
    found: dict[bytes, list[int]] = {}
    rows: list[tuple[bytes, int, int]] = []
    symbol: list[int] = []
    for word in words:
        if word in ranks:
            found[word] = [ranks[word]]
        elif word:
            rows.append((word, len(symbol), len(symbol) + len(word)))
            symbol.extend(map(single.__getitem__, word))
            symbol.append(-1)  # parts it from the next word
        else:
            found[word] = []
    after = list(range(1, len(symbol) + 1))
    before = list(range(-1, len(symbol) - 1))
    pairs: dict[tuple[int, int], int | None] = {}
    index: dict[int, list[int]] = defaultdict(list)
    waiting: list[int] = []

    def made(left: int, right: int) -> int | None:
        """The token that a pair makes, if any."""
        if left < 0 or right < 0:
            return None
        try:
            return pairs[left, right]
        except KeyError:
            token = pairs[left, right] = ranks.get(spelt[left] + spelt[right])
            return token

    def note(token: int, place: int) -> None:
        if token not in index:
            heapq.heappush(waiting, token)
        index[token].append(place)

    for i in range(len(symbol) - 1):
        if (token := made(symbol[i], symbol[i + 1])) is not None:
            note(token, i)
    while waiting:
        token = heapq.heappop(waiting)
        places = sorted(index.pop(token))
        for k, i in enumerate(places):
            j = after[i]
            # an earlier merge may have taken either side
            if symbol[i] < 0 or j >= len(symbol) or made(symbol[i], symbol[j]) != token:
                continue
            symbol[i], symbol[j] = token, -2
            n = after[i] = after[j]
            before[n] = i
            lower = False
            p = before[i]
            for place, other in ((p, made(symbol[p], token) if p >= 0 else None), (i, made(token, symbol[n]))):
                if other is not None:
                    note(other, place)
                    lower |= other < token
            if lower:  # it goes before what is left of this one
                for place in places[k + 1 :]:
                    note(token, place)
                break
    for word, start, end in rows:
        found[word] = [s for s in symbol[start:end] if s >= 0]
    return found


class MergeEncoder:
    """encode() gives the ids of texts as little-endian unsigned 32-bit integers; decode() their bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = merge_ranks(path)
        self.spelt: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.spelt[rank] = token
        self.pattern = regex.compile(pattern)
        later = later_letters()
        # to the pattern they are signs like the first point for private use
        self.signs = dict.fromkeys(map(ord, later), "\ue000")
        self.maybe = regex.compile(f"[{min(later)}-\U0010ffff]") if later else None
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> Iterator[list[str]]:
        plain = text.isascii() or not self.maybe or not self.maybe.search(text)
        if plain and len(text) <= BLOCK:
            yield self.pattern.findall(text)
            return
        if plain:
            matches = map(methodcaller("group"), self.pattern.finditer(text))
        else:
            matches = (text[slice(*m.span())] for m in self.pattern.finditer(text.translate(self.signs)))
        while some := list(islice(matches, BLOCK)):
            yield some

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; of a null or empty text, none."""
        done: list[list[bytes]] = []
        waiting: list[tuple[list[bytes], list[bytes | None], list[str]]] = []
        held = 0
        for text in texts:
            own: list[bytes] = []
            done.append(own)
            for words in self.words(text or ""):
                ids = list(map(self.known.get, words))
                if None in ids:
                    own.append(b"")
                    waiting.append((own, ids, words))
                    waiting[-1] += (len(own) - 1,)
                    held += len(words)
                else:
                    own.append(b"".join(ids))
                if held >= TOGETHER:
                    self._fill(waiting)
                    waiting, held = [], 0
        self._fill(waiting)
        return [b"".join(own) for own in done]

    def _fill(self, waiting: list[tuple]) -> None:
        missing = {w for _, ids, words, _ in waiting for v, w in zip(ids, words) if v is None}
        spelt = {w: w.encode() for w in missing}
        merged = replay(set(spelt.values()), self.ranks, self.spelt)
        found = {w: np.array(merged[b], dtype="<u4").tobytes() for w, b in spelt.items()}
        for own, ids, words, at in waiting:
            own[at] = b"".join(found[w] if v is None else v for v, w in zip(ids, words))
        if len(self.known) + len(found) > REMEMBERED:
            self.known.clear()
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST_REMEMBERED)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelt.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_encoders: dict[tuple[str, str], MergeEncoder] = {}


def encoder(path: str, pattern: str) -> MergeEncoder:
    """One encoder per worker; what it remembers serves later tasks too."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = MergeEncoder(path, pattern)
    return _encoders[path, pattern]


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document: doc_id and `ids`, binary, as little-endian unsigned 32-bit integers.

    `pattern` splits texts into words that are encoded each by itself, without special tokens. A null or
    empty text has no ids. Each row gives one row, repeated rows and rows without a doc_id too; an empty
    table gives none. Only doc_id and text are read, whatever other columns there are.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary, pattern)
        for batch in batches:
            ids = pa.array(codec.encode(batch.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, "doc_id long, ids binary")


def decoded(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Rows of `encoded` with `decoded`, the bytes that their ids stand for."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary, pattern)
        for batch in batches:
            ids = batch.column(1)
            back = pa.array([codec.decode(x) for x in ids.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, back], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """`encoded` and `decoded` in one pass, so that each task needs one worker."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                ids = codec.encode(some.column(1).to_pylist())
                back = pa.array([codec.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), back], names=["doc_id", "ids", "decoded"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(both, "doc_id long, ids binary, decoded binary")
