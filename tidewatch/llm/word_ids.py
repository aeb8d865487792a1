"""Ids of a word tokenizer, where every spelling is encoded once per worker.

A tokenizer that drops white space and never joins what white space parts gives a text the ids of its
chunks between white space, one after the other. Chunks repeat, so their ids are remembered. Any other
tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np

#: Chunks that a worker remembers; beyond that it starts anew. About 170 bytes each.
REMEMBERED = 1_200_000
#: Bytes of a text that are taken at a time.
BLOCK = 1 << 20
#: Words encoded in one call.
TOGETHER = 2_000
#: Letters up to here are letters in every version of Unicode and keep their form.
LATIN_END = "ɐ"
WHITE = b" \t\n\r\x0b\x0c"
#: Signs that never belong to the word before them.
TRAILING = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: What the tokenizer's file says of a tokenizer that works by word.
WORD_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def blocks(data: bytes) -> Iterator[bytes]:
    """A text in blocks that end before white space, or as one where it has none."""
    start = 0
    while len(data) - start > BLOCK:
        end = start + BLOCK
        while end < len(data) and data[end] not in WHITE:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:] if start else data


def _missing(ids: list[bytes | None]) -> list[int]:
    """The places of nulls; they are few, and looked for without a step of Python for each of the others."""
    found, at = [], -1
    for _ in range(ids.count(None)):
        at = ids.index(None, at + 1)
        found.append(at)
    return found


def _plain(stem: bytes) -> bool:
    """Whether it is a word of small Latin letters, which its tokenizer takes as it is."""
    if stem.isascii():
        return stem.isalpha() and stem.islower()
    word = stem.decode()
    return word.isalpha() and max(word) < LATIN_END and word == word.lower()


class WordEncoder:
    """encode() gives the ids of texts as little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.word_end = np.zeros(size, dtype=bool)
        for token, number in vocabulary.items():
            self.word_end[number] = token.endswith("</w>")
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        normalizer, splitter = layout["normalizer"] or {}, layout["pre_tokenizer"] or {}
        parts = splitter.get("pretokenizers", [{}])
        self.by_word = (
            normalizer.get("normalizers") == WORD_NORMALIZERS
            and parts[0].get("pattern") == {"Regex": WORD_PATTERN}
            and layout["model"].get("end_of_word_suffix") == "</w>"
        )
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; of a null or empty text, none."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]
        done: list[list[bytes]] = []
        waiting: list[tuple[list[bytes | None], list[bytes]]] = []
        held = 0
        for text in texts:
            own: list = []
            done.append(own)
            data = (text or "").encode()
            # a special token is only one as it is spelt
            if b"<|" not in data:
                data = data.lower()
            for block in blocks(data):
                chunks = block.split()
                ids = list(map(self.known.get, chunks))
                if None in ids:
                    waiting.append((ids, chunks))
                    held += len(chunks)
                    own.append(ids)
                else:
                    own.append(b"".join(ids))
                if held > BLOCK:
                    self._fill(waiting)
                    waiting, held = [], 0
        self._fill(waiting)
        return [b"".join(x if isinstance(x, bytes) else b"".join(x) for x in own) for own in done]

    def _fill(self, waiting: list[tuple[list[bytes | None], list[bytes]]]) -> None:
        gaps = [_missing(ids) for ids, _ in waiting]
        missing = {chunks[i] for (_, chunks), at in zip(waiting, gaps) for i in at}
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
        found = self._encoded(missing)
        for (ids, chunks), at in zip(waiting, gaps):
            for i in at:
                ids[i] = found[chunks[i]]
        self.known.update(found)

    def _encoded(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks: of plain words many in one call, with the signs after them added."""
        signed: list[tuple[bytes, bytes, bytes]] = []
        words: set[bytes] = set()
        others: set[bytes] = set()
        for chunk in chunks:
            stem = chunk.rstrip(TRAILING)
            if not _plain(stem):
                others.add(chunk)
            elif len(stem) < len(chunk):
                tail = chunk[len(stem) :]
                signed.append((chunk, stem, tail))
                words.add(stem)
                others.add(tail)
            else:
                words.add(chunk)
        found = {w: self.known[w] for some in (words, others) for w in some if w in self.known}
        rest = [w for w in words if w not in found]
        for i in range(0, len(rest), TOGETHER):
            some = rest[i : i + TOGETHER]
            [got] = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(got.ids, dtype=self.kind)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(some):
                data, at = ids.tobytes(), (ends * self.kind.itemsize).tolist()
                found.update(zip(some, (data[a:b] for a, b in zip([0, *at], at))))
            else:
                others.update(some)
        single = [w for w in others if w not in found]
        for i in range(0, len(single), TOGETHER):
            some = single[i : i + TOGETHER]
            got = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            found.update((w, np.array(e.ids, dtype=self.kind).tobytes()) for w, e in zip(some, got))
        for chunk, stem, tail in signed:
            found[chunk] = found[stem] + found[tail]
        return {c: found[c] for c in chunks}


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file; what it remembers serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
