"""Token ids in patched frame-of-reference blocks.

A segment (one file image) holds the ids of consecutive documents:

    magic "PFOR1", then as little-endian 64-bit numbers: documents, tokens, blocks, exceptions, bytes of packed values
    document ids (i8), their validity (u1), tokens of each document (u4)
    of each block: smallest id (u4), bits of a value (u1), number of exceptions (u1), start in the packed values (u4)
    packed values: 128 differences to the block's smallest id, each block at its own width, high bits first
    exceptions, block by block: place in the block (u1), and the whole difference (u4)
    crc32 of all that (u4)

The width is that of the block's 90th percentile of differences; a larger one
keeps its low bits in place and is patched from the exception list. Any block
can be read alone through its start.

Spark writes the images (committed atomically, in the shared folder), ordered
by document id over range partitions, so no task needs another's data. The images travel in
a Parquet column, which every store takes; `write_files` and `read_files` have them as files of their own.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .common import SLICE, map_arrow, written

MAGIC = b"PFOR1"
BLOCK = 128
PERCENTILE = 90
END_ID = 0
#: A segment is closed at so many tokens.
SEGMENT_TOKENS = 1 << 18
#: Images of a row group of the stored table at most: each has about half a megabyte, and a reader holds a group's rows at once.
GROUP_IMAGES = 16


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def write_segment(doc_ids: list[int | None], counts: list[int], tokens: np.ndarray) -> bytes:
    """The image of a segment; counts are the tokens of each document, in order."""
    n = len(tokens)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = tokens
    if n < len(padded):
        padded[n:] = tokens[-1]
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rows = rows - low[:, None]
    at = BLOCK * PERCENTILE // 100
    typical = np.partition(rows, at, axis=1)[:, at] if blocks else low
    width = _bits(typical)
    outside = rows >> width[:, None].astype(np.uint32) != 0 if blocks else np.zeros((0, BLOCK), bool)
    where = np.argwhere(outside)
    starts = np.concatenate(([0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))))
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            cell, size = (">u2", 16) if w <= 16 else (">u4", 32)
            bits = np.unpackbits(rows[own].astype(cell).view(np.uint8), axis=1).reshape(len(own), BLOCK, size)
            made = np.packbits(bits[:, :, size - w :].reshape(len(own), BLOCK * w), axis=1)
            packed[(starts[own][:, None] + np.arange(made.shape[1])).ravel()] = made.ravel()
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    body = b"".join(
        [
            MAGIC,
            struct.pack("<5q", len(doc_ids), n, blocks, len(where), len(packed)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(), valid.tobytes(), np.array(counts, "<u4").tobytes(),
            low.astype("<u4").tobytes(), width.tobytes(), outside.sum(axis=1).astype(np.uint8).tobytes(), starts[:-1].astype("<u4").tobytes(),
            packed.tobytes(), where[:, 1].astype(np.uint8).tobytes(), rows[outside].astype("<u4").tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """Reads a segment's image; `block(i)` reads one block alone."""

    def __init__(self, image: bytes):
        if image[: len(MAGIC)] != MAGIC or zlib.crc32(image[:-4]) != struct.unpack("<I", image[-4:])[0]:
            raise ValueError("not a whole segment")
        docs, self.tokens, blocks, exceptions, packed = struct.unpack_from("<5q", image, len(MAGIC))
        at = len(MAGIC) + 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        ids, valid = take("<i8", docs), take("u1", docs)
        self.doc_ids = [i if v else None for i, v in zip(ids.tolist(), valid.tolist())]
        self.counts = take("<u4", docs)
        self.low, self.width, self.n_out, self.starts = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u4", blocks)
        self.packed, self.place, self.value = take("u1", packed), take("u1", exceptions), take("<u4", exceptions)
        self.out_at = np.concatenate(([0], np.cumsum(self.n_out, dtype=np.int64)))

    def _unpack(self, own: np.ndarray, w: int) -> np.ndarray:
        raw = self.packed[(self.starts[own].astype(np.int64)[:, None] + np.arange(BLOCK // 8 * w)).ravel()].reshape(len(own), -1)
        cell, size = (">u2", 16) if w <= 16 else (">u4", 32)
        bits = np.zeros((len(own), BLOCK, size), np.uint8)
        bits[:, :, size - w :] = np.unpackbits(raw, axis=1).reshape(len(own), BLOCK, w)
        return np.packbits(bits.reshape(len(own), -1), axis=1).view(cell).astype(np.uint32)

    def block(self, i: int) -> np.ndarray:
        """The ids of block i, by its start."""
        w = int(self.width[i])
        row = self._unpack(np.array([i]), w)[0] if w else np.zeros(BLOCK, np.uint32)
        lo, hi = self.out_at[i], self.out_at[i + 1]
        row[self.place[lo:hi]] = self.value[lo:hi]
        return (row + self.low[i])[: self.tokens - i * BLOCK]

    def read(self) -> np.ndarray:
        """All ids."""
        rows = np.zeros((len(self.low), BLOCK), np.uint32)
        for w in np.unique(self.width).tolist():
            if w:
                own = np.flatnonzero(self.width == w)
                rows[own] = self._unpack(own, w)
        rows[np.repeat(np.arange(len(self.low)), self.n_out), self.place] = self.value
        return (rows + self.low[:, None]).ravel()[: self.tokens]


def write_token_file(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all documents, each with the end id, in ascending id order; returns the segments as written.

    Columns: part (range partition, in order), base (tokens before the segment in its part), n_docs, n_tokens,
    image. Null text counts as empty; a null id comes first; rows that repeat an
    id stand next to each other, ordered by a hash of their text. A very long text lies in one segment, which is closed behind it. An empty table
    gives no segments. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, base = byte_bpe(model), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal base, size
            image = write_segment(ids, [len(x) for x in held], np.concatenate(held))
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "base": pa.array([base], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "image": pa.array([image], pa.binary())})
            base, size = base + size, 0
            ids.clear()
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                for doc, found in zip(some.column(0).to_pylist(), own.encode([x or "" for x in some.column(1).to_pylist()])):
                    ids.append(doc)
                    held.append(np.append(found, np.uint32(end_id)))
                    size += len(held[-1])
                    if size >= SEGMENT_TOKENS:
                        yield close()
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    return written(ordered.mapInArrow(run, "part int, base long, n_docs long, n_tokens long, image binary"), "token-file", GROUP_IMAGES)


def read_token_file(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document from the images: id, start (ids of all documents before it), n_tokens, ids_crc32.

    The offsets of the parts are one number for each range partition.
    """
    spark = segments.sparkSession
    sums = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sums:
        offsets.append((part, total))
        total += n
    placed = segments.join(F.broadcast(spark.createDataFrame(offsets, "part int, first long")), "part")

    def make():
        def each(batch):
            out: dict[str, list] = {k: [] for k in ("id", "start", "n_tokens", "ids_crc32")}
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment = Segment(image.as_py())
                tokens, at = segment.read().astype("<u4"), 0
                for doc, n in zip(segment.doc_ids, segment.counts.tolist()):
                    for k, v in zip(out, (doc, start + at, n, zlib.crc32(tokens[at : at + n].tobytes()))):
                        out[k].append(v)
                    at += n
            return out

        return each

    found = map_arrow(placed.select((F.col("first") + F.col("base")).alias("start"), "image"), make, "id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id_col)


_NAME = re.compile(r"(\d+)-(\d+)\.pfor$")


def write_files(segments: DataFrame, folder: str) -> DataFrame:
    """Writes every image as a file of its own, part-base.pfor, in a folder of a file system that all executors share; returns the paths.

    A file is renamed when it is whole, so a task that runs twice does no harm. The names sort in the order of the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for part, base, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                path = os.path.join(folder, f"{part:06d}-{base:015d}.pfor")
                with open(f"{path}.{os.getpid()}.tmp", "wb") as f:
                    f.write(image.as_py())
                os.replace(f"{path}.{os.getpid()}.tmp", path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return segments.select("part", "base", "image").mapInArrow(run, "path string")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of such files, from any store that Spark reads: part, base, n_docs, n_tokens, image."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)

    def make():
        def each(batch):
            names = [_NAME.search(x) for x in batch.column(0).to_pylist()]
            heads = [struct.unpack_from("<2q", x.as_py(), len(MAGIC)) for x in batch.column(1)]
            return {"part": [int(m[1]) for m in names], "base": [int(m[2]) for m in names], "n_docs": [d for d, _ in heads], "n_tokens": [n for _, n in heads], "image": batch.column(1)}

        return each

    return map_arrow(files.select("path", "content"), make, "part int, base long, n_docs long, n_tokens long, image binary")


def token_file_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Writes the token file and reads it back (see the two functions); an empty table gives an empty result."""
    return read_token_file(write_token_file(docs, id_col, text_col, model, end_id), id_col)
