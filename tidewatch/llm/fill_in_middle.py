"""Fill-in-middle: documents cut in three and put in another order, with cuts located by chunk counts.

Units are runs of ASCII letters and single other characters. A rolling hash cuts a text into chunks where
its content says so, so that passages that documents share fall into the same chunks. A worker remembers
each chunk, looked up by its content itself, with a summary: how many units it has, and whether it begins and
ends with a letter. Two neighbours that meet in letters share one unit; with that, the counts of chunks add
up to those of the text, and only the chunks that hold a cut are read again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
LETTERS = re.compile("[A-Za-z]*")
#: Characters of a chunk at least, and at most where no hash cuts; a hash does once in 256 characters.
LEAST, MOST = 64, 2_048
#: Chunks that a worker remembers; beyond that it starts anew. About 700 bytes each.
REMEMBERED = 150_000
#: Characters that are hashed at a time.
BLOCK = 1 << 20
#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain at most, and of 100 cut ones so many begin with the suffix.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20


def marks(text: str) -> np.ndarray:
    """Places behind which the rolling hash of the last 32 characters asks for a cut."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    rolled = points * np.uint64(0x9E3779B97F4A7C15)
    rolled ^= rolled >> np.uint64(29)
    for k in (1, 2, 4, 8, 16):
        wider = rolled.copy()
        wider[k:] += rolled[:-k] << np.uint64(k)
        rolled = wider
    return np.flatnonzero(rolled >> np.uint64(56) == 0) + 1


def chunks(text: str) -> list[str]:
    """A text in chunks, in order."""
    found, last = [], 0
    for at in range(0, len(text), BLOCK):
        # 31 characters before a block are part of its first hashes
        begin = max(0, at - 31)
        places = marks(text[begin : at + BLOCK]) + begin
        for place in places[places > at].tolist():
            while place - last > MOST:
                found.append(text[last : last + MOST])
                last += MOST
            if place - last >= LEAST:
                found.append(text[last:place])
                last = place
    while len(text) - last > MOST:
        found.append(text[last : last + MOST])
        last += MOST
    if last < len(text):
        found.append(text[last:])
    return found


def _letter(sign: str) -> bool:
    return sign.isascii() and sign.isalpha()


class Chunked:
    """The counts of a text's units, and where each ends."""

    #: What the worker knows of chunks: units, first sign a letter, last one too.
    known: dict[str, tuple[int, bool, bool]] = {}

    def __init__(self, text: str) -> None:
        self.chunks = chunks(text)
        self.joined: list[bool] = []
        #: Units that began up to the end of each chunk.
        self.sums: list[int] = []
        total, open_run = 0, False
        for chunk in self.chunks:
            units, first, last = self._summary(chunk)
            joined = open_run and first
            total += units - joined
            self.joined.append(joined)
            self.sums.append(total)
            open_run = last
        self.units = total

    @classmethod
    def _summary(cls, chunk: str) -> tuple[int, bool, bool]:
        summary = cls.known.get(chunk)
        if summary is None:
            if len(cls.known) >= REMEMBERED:
                cls.known.clear()
            summary = cls.known[chunk] = len(UNIT.findall(chunk)), _letter(chunk[0]), _letter(chunk[-1])
        return summary

    def end_of(self, units: int) -> int:
        """How many characters the first `units` have."""
        if not units:
            return 0
        k = bisect_left(self.sums, units)
        place = sum(map(len, self.chunks[:k]))
        # of the chunk's own pieces; the first one may belong to a unit that began before
        local = units - (self.sums[k - 1] if k else 0) + self.joined[k]
        for i, piece in enumerate(UNIT.finditer(self.chunks[k]), 1):
            if i == local:
                place += piece.end()
                break
        if piece.end() == len(self.chunks[k]):
            while k + 1 < len(self.chunks) and self.joined[k + 1]:
                k += 1
                run = LETTERS.match(self.chunks[k]).end()
                place += run
                if run < len(self.chunks[k]):
                    break
        return place


def transformed_text(doc_id: int | None, text: str | None) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one document."""
    text = text or ""
    counted = Chunked(text)
    n = counted.units
    drawn = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= CUT_PERCENT:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = counted.end_of(first), counted.end_of(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    What is drawn follows from the doc_id alone, so a task that runs again draws the same; rows without one
    share a draw. A null or empty text stays plain and empty, as does one that holds a marker. Every row,
    repeated ones too, gives one row; an empty table none. Only doc_id and text are read, whatever other
    columns there are. Texts are taken whole, whatever their length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for batch in batches:
            rows = [transformed_text(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            made = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:4], made[4].cast(pa.string())], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, from an output and its form.

    A text that is cut holds no marker, and none comes about where a part meets one, as `<` only begins them.
    """
    text = F.col(output)
    before = lambda marker: F.substring_index(text, marker, 1)

    def part(after: str, marker: str) -> Column:
        # what stands between two markers
        start = F.length(before(after)) + len(after) + 1
        return F.substring(before(marker), start, F.length(text))

    middle, head = F.substring_index(text, MIDDLE, -1), F.lit(len(PREFIX) + 1)
    psm = F.concat(F.substring(before(SUFFIX), head, F.length(text)), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, F.substring(before(PREFIX), head, F.length(text)))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(text)
