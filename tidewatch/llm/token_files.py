"""Token ids as flat unsigned integer files with 64-bit document offsets.

A part is three files: `.bin`, the ids of its documents one after the other; `.off`, where each document
starts in it, and the end of the last, as 64-bit integers; `.doc`, the doc_ids as 64-bit integers. The
manifest has a row per part with its base: the ids of all parts before it, a prefix sum of their counts.
Reading maps the files into memory, or takes ranges of them from a store, so any document is reached without
reading the others.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import new_folder, stored
from tidewatch.llm.word_ids import encoder

PART = "part int, file string, width int, no_id long, documents long, tokens long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Ids that are read together; a longer document is read alone.
READ_IDS = 1 << 20


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the ids of all documents below `folder` in ascending doc_id order; returns the manifest.

    A null text is empty and holds the end id alone. Rows without a doc_id come first; rows that share
    one are ordered by a hash of their texts. Only doc_id and text are read, whatever other columns
    there are. No row is lost or joined: an empty table gives an empty manifest. Texts are dealt out by
    ranges of doc_id and written by the tasks themselves, each attempt to files of its own; the manifest
    names the files of the attempts that ended well, so a lost executor leaves at most files that nothing
    points to.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash only orders rows that share a doc_id
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        codec = encoder(tokenizer)
        last = np.array([end_id], dtype=codec.kind).tobytes()
        store, top = _place(folder)
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        documents = tokens = no_id = 0
        opened = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if not opened:
                store.create_dir(top, recursive=True)
                opened = {x: store.open_output_stream(f"{top}/{name}.{x}") for x in ("bin", "off", "doc")}
            starts = []
            for ids in codec.encode(batch.column(1).to_pylist()):
                starts.append(tokens)
                opened["bin"].write(ids)
                opened["bin"].write(last)
                tokens += len(ids) // codec.kind.itemsize + 1
            opened["off"].write(np.array(starts, dtype="<i8").tobytes())
            keys = batch.column(0)
            opened["doc"].write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            no_id += keys.null_count
            documents += batch.num_rows
        if opened:
            opened["off"].write(np.array([tokens], dtype="<i8").tobytes())
            for stream in opened.values():
                stream.close()
            row = [[number], [name], [codec.kind.itemsize], [no_id], [documents], [tokens]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["part", "file", "width", "no_id", "documents", "tokens"],
            )

    written = stored(ordered.mapInArrow(parts, PART), "token-parts")
    # one row per part, however many documents it holds
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class Ranged:
    """A file of a store that nothing is mapped from: each slice is read as it is asked for, and no more."""

    def __init__(self, source: pa.NativeFile, kind: str) -> None:
        self.source, self.kind = source, np.dtype(kind)

    def __getitem__(self, span: slice) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.source.read_at((span.stop - span.start) * width, span.start * width), self.kind)


def opened(store: fs.FileSystem, path: str, kind: str) -> np.ndarray | Ranged:
    """A file as an array: mapped into memory where the system has it, else read from the store by ranges."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    return Ranged(store.open_input_file(path), kind)


def _checks(ids: np.ndarray | Ranged, own: np.ndarray) -> list[int]:
    """The crc32 of each document's ids, which begin and end at `own`; about READ_IDS of them are held at once."""
    found = []
    for group in np.split(np.arange(len(own) - 1), np.flatnonzero(np.diff(own[:-1] // READ_IDS)) + 1):
        spans = own[group[0] : group[-1] + 2]
        block = ids[int(spans[0]) : int(spans[-1])]
        inside = (spans - spans[0]).tolist()
        found += [zlib.crc32(block[x:y].astype("<u4").tobytes()) for x, y in zip(inside[:-1], inside[1:])]
    return found


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens and ids_crc32.

    ids_crc32 is the unsigned crc32 of its ids as little-endian unsigned 32-bit integers.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                store, top = _place(folder)
                ids = opened(store, f"{top}/{part['file']}.bin", f"<u{part['width']}")
                offsets = opened(store, f"{top}/{part['file']}.off", "<i8")
                keys = opened(store, f"{top}/{part['file']}.doc", "<i8")
                for a in range(0, part["documents"], 10_000):
                    b = min(a + 10_000, part["documents"])
                    own = np.array(offsets[a : b + 1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(keys[a:b]), pa.int64(), mask=np.arange(a, b) < part["no_id"]),
                            pa.array(own[:-1] + part["base"], pa.int64()),
                            pa.array(np.diff(own), pa.int64()),
                            pa.array(_checks(ids, own), pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # a part is a unit of reading, one task for each; the number is given as adaptive execution would
    # take such short rows together
    return manifest.repartition(max(1, manifest.count()), "part").mapInArrow(documents, DOCUMENT)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the files below `folder` (default: a new one in the shared folder) and reads them back."""
    folder = folder or new_folder(spark, "token-files")
    return read(write(docs, folder, tokenizer, end_id), folder)
