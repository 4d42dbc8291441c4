"""First-fit-decreasing packing with a tournament tree, in randomised groups of documents.

Documents become token pieces of at most the sequence length. Only piece
records (a few numbers) are shuffled, by a hash of document and start; each
partition cuts its sorted stream into groups of a fixed number of pieces and
packs each group alone, so memory is bounded however many rows there are. In a
group, longest pieces go first, each into the first sequence that has room: the
tree holds the largest free capacity below each node, so that sequence is
found in one descent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .common import map_arrow

LENGTH = 2048
END_ID = 1
#: Pieces that are packed together.
GROUP = 32_768


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece (numbered from 0) and its offset there; lengths are at most the capacity."""
    n = len(lengths)
    size = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * size)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < size:
            at *= 2
            if room[at] < need:
                at += 1
        sequence[i], offset[i] = at - size, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
    return sequence, offset


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "byte_bpe_50k.json", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row's ids, the end id included: id, start, length, ids_crc32, doc_tokens.

    Null and empty texts have the end id alone. Very long texts are encoded whole and cut every `length` ids. Ids of rows are only
    carried, null and repeated ones, too. An empty table gives no pieces. Other columns are not read.
    """

    def make():
        own = byte_bpe(model)

        def each(batch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens")}
            for at in range(0, len(texts), 128):
                for doc, found in zip(ids[at : at + 128], own.encode([x or "" for x in texts[at : at + 128]])):
                    found = np.append(found, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(found), length):
                        piece = found[start : start + length]
                        for k, v in zip(out, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(found))):
                            out[k].append(v)
            return out

        return each

    out = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), make, "id long, start long, length long, ids_crc32 long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns as `token_pieces` returns them).

    Pieces, not documents, are dealt to groups at random, so the pieces of a long document lie in several groups. The deal hashes
    the whole record: rows of one id (all null ids, too) are spread, and only rows equal in every column stand together, in
    order. Pieces of equal length keep that order. An empty table gives an empty result; other columns are dropped.
    """
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(part: int, done: int, rows: pa.Table) -> tuple[int, pa.Table]:
        sequence, offset = first_fit_decreasing(rows.column("length").to_numpy(), capacity)
        rows = rows.append_column("sequence_id", pa.array(sequence + done + (part << 32)))
        return done + int(sequence.max()) + 1, rows.append_column("offset", pa.array(offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            while batch.num_rows:
                free = group - sum(x.num_rows for x in held)
                held.append(batch.slice(0, free))
                batch = batch.slice(free)
                if free <= held[-1].num_rows:
                    done, rows = place(part, done, pa.Table.from_batches(held))
                    held = []
                    yield from rows.to_batches()
        if held:
            yield from place(part, done, pa.Table.from_batches(held))[1].to_batches()

    rows = pieces.select(id_col, "start", "length", "ids_crc32", "doc_tokens")
    dealt = rows.withColumn("deal", F.xxhash64(*rows.columns, F.lit(3))).repartition("deal").sortWithinPartitions("deal", *rows.columns)
    return dealt.select(*rows.columns).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "byte_bpe_50k.json", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (null text: none) end with the end id; documents longer than
    a sequence are cut every `length` ids, shorter ones stay whole. Sequence ids
    are unique, not dense. Null and repeated ids are kept: each row is packed on
    its own. An empty table gives no pieces. Other columns are not read.
    """
    return pack(token_pieces(docs, id_col, text_col, model, length, end_id), id_col, length)
