"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within `2r` differing bits have a value in common that is
within `r` bits of either. So every fingerprint emits all its variants within
half the radius (2,081 for r = 2), variants are shuffled, and fingerprints that
meet on a variant are verified and linked.

What is shuffled is the fingerprint, once for each partition that some of its
variants belong to. A variant's partition is made of parities: the 64 bits are
dealt over k blocks, and bit i of the partition is the parity of block i. That is
linear, `part(f xor m) = part(f) xor part(m)`, and a mask of two bits changes two
parities at most, so the 2,081 variants of a fingerprint lie in 1 + k + k(k-1)/2 of
the 2^k partitions, and a partition lists for itself those that fall into it. The meetings are
those of shuffling 2,081 rows a fingerprint. k grows by one when the fingerprints double, so the copies
of a fingerprint grow with the square of the logarithm: 29 at 128 partitions, 79 at
4,096, 211 at a million. A flipped bit always changes a parity, so a large group
of near copies is dealt over many partitions. Within a partition variants are listed
and sorted in slices of bounded size, by parities of other blocks.

Fingerprints that share a variant are all within the radius of each other, so
links between neighbours in the sorted list connect them all: no group of near
copies is expanded into pairs, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, local_roots
from ..sources.shared import release
from .common import map_arrow, written

BITS = 64
SEED = 42
WORDS = 4
RADIUS = 4
#: Parities of a variant's partition at least, and the variants that one partition takes on average at most.
LEAST_BITS, PART_VARIANTS = 7, 1 << 26
#: Variants that are listed and sorted at once in a partition, and copies of fingerprints that are dealt out at once.
SLICE_VARIANTS, SLICE_COPIES = 2_000_000, 1_000_000


def fingerprint(data: bytes, words: int = WORDS) -> bytes:
    """Eight bytes, most significant bit first: bit set where over half of the shingles' XXH64 have it.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space, and
    shingles count as often as they occur. A shorter text is one shingle; one
    without words gives zero.
    """
    import xxhash

    found = data.lower().split()
    if not found:
        return bytes(8)
    line, digest = b" ".join(found), xxhash.xxh64_digest
    if len(found) <= words:
        made = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
        made = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(made), 4096):
        some = np.frombuffer(b"".join(made[at : at + 4096]), np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(some, axis=1), axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(made)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """`doc` and `fp` (the fingerprint as a signed long) of every row.

    Null and empty texts and those without words have zero. Ids are only carried, null and repeated ones, too. A very long
    text is hashed whole, 4,096 shingles at a time. An empty table gives an empty result. Other columns are not read, whatever their names.
    """

    def make():
        def each(batch):
            made = [fingerprint((x or "").encode("utf-8", "surrogatepass"), words) for x in batch.column(1).to_pylist()]
            return {"doc": batch.column(0), "fp": np.frombuffer(b"".join(made), ">i8").astype(np.int64)}

        return each

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), make, "doc long, fp long")


def ball(radius: int) -> np.ndarray:
    """All masks of at most `radius` of the 64 bits."""
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    layers, last = [np.zeros(1, np.uint64)], [(np.uint64(0), -1)]
    for _ in range(radius):
        last = [(m | one[j], j) for m, i in last for j in range(i + 1, BITS)]
        layers.append(np.array([m for m, _ in last], np.uint64))
    return np.concatenate(layers)


def parities(values: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """`bits` parities of each value: a linear hash over GF(2). The 64 bits are dealt over as many blocks in an order that the salt draws."""
    order = np.random.Generator(np.random.PCG64([SEED, salt])).permutation(BITS)
    out = np.zeros(len(values), np.int64)
    for i in range(bits):
        block = np.bitwise_or.reduce(np.uint64(1) << order[i::bits].astype(np.uint64))
        out |= (np.bitwise_count(values & block) & 1).astype(np.int64) << i
    return out


def _by_class(values: np.ndarray, hashed: np.ndarray) -> dict[int, np.ndarray]:
    """The values of each hash."""
    order = np.argsort(hashed, kind="stable")
    begins = np.flatnonzero(np.diff(hashed[order], prepend=-1))
    return dict(zip(hashed[order][begins].tolist(), np.split(values[order], begins[1:])))


def meet(fps: np.ndarray, part: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints that meet on a variant of this partition: each with the first of its group."""
    fps = np.unique(fps)
    masks = ball(radius // 2)
    here = _by_class(np.arange(len(fps)), parities(fps, bits) ^ part)
    there = _by_class(masks, parities(masks, bits))
    total = sum(len(own) * len(there.get(c, ())) for c, own in here.items())
    more = max(0, (total - 1) // SLICE_VARIANTS).bit_length()
    cells = [(_by_class(own, parities(fps[own], more, 1)), _by_class(there[c], parities(there[c], more, 1))) for c, own in here.items() if c in there]
    left, right = [], []
    for piece in range(1 << more):
        variants, owners = [], []
        for own, flips in cells:
            for c, m in flips.items():
                if (some := own.get(c ^ piece)) is not None:
                    variants.append((fps[some][:, None] ^ m[None, :]).ravel())
                    owners.append(np.repeat(some, len(m)))
        if not variants:
            continue
        variants, owners = np.concatenate(variants), np.concatenate(owners)
        by = np.argsort(variants)
        variants, owners = variants[by], owners[by]
        equal = np.flatnonzero(variants[1:] == variants[:-1])
        a, b = owners[equal], owners[equal + 1]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        left.append(a[near])
        right.append(b[near])
    if not left:
        return fps[:0], fps[:0]
    root = local_roots(len(fps), np.concatenate(left), np.concatenate(right))
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def part_bits(n: int, radius: int = RADIUS) -> int:
    """The parities that n fingerprints take, so that a partition has `PART_VARIANTS` variants or fewer on average."""
    over = -(-n * len(ball(radius // 2)) // PART_VARIANTS)
    return max(LEAST_BITS, (over - 1).bit_length() if over > 1 else 0)


def dealt(fps: np.ndarray, bits: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The partitions that fingerprints go to, in slices: parts, where each one's fingerprints begin, the fingerprints."""
    parts = np.unique(parities(ball(radius // 2), bits))
    step = max(1, SLICE_COPIES // len(parts))
    for at in range(0, len(fps), step):
        some = fps[at : at + step]
        to = (parities(some, bits)[:, None] ^ parts[None, :]).ravel()
        order = np.argsort(to, kind="stable")
        to = to[order]
        begins = np.flatnonzero(np.diff(to, prepend=-1))
        yield to[begins], begins, some[order // len(parts)]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (`a`, `b`) that connect the fingerprints (column `fp`, distinct) at `radius` or fewer differing bits.

    They join the same fingerprints as all pairs do, without listing all pairs.
    """
    if radius % 2 or radius > 6:
        raise ValueError("the radius must be even and at most 6")
    bits = part_bits(distinct.count(), radius)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for parts, begins, copies in dealt(fps, bits, radius):
                offsets = np.append(begins, len(copies)).astype(np.int32) * np.int32(8)
                held = pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(copies.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), held], ["part", "fps"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.frombuffer(b"".join(pdf["fps"]), np.uint64)
        a, b = meet(fps, int(pdf["part"].iloc[0]), bits, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    emitted = distinct.select("fp").mapInArrow(deal, "part long, fps binary")
    return emitted.groupBy("part").applyInPandas(join, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """`doc`, `fp`, `component_id` (the smallest id that a row reaches over links, itself included) for every row.

    Equal fingerprints link, so exact copies, repeated rows and all texts
    without words fall together. Null text counts as empty; a row with a null id
    takes part and gets the smallest id of its component, null if there is none.
    Rows that share an id are rows of their own. Very long texts are fingerprinted whole. An empty table gives an empty result. Other
    columns are not read.
    """
    found = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    least = written(found.groupBy("fp").agg(F.min("doc").alias("least")), "distinct-fingerprints")
    classes = connected_components(links(least, radius), write=written)
    members = classes.unionByName(classes.select(F.col("component").alias("node"), "component").distinct())
    linked = written(members.join(least, members.node == least.fp).select("fp", "component", "least"), "linked-fingerprints")
    # written, so that the joins below read tables: rows of a hot component or fingerprint are 16 bytes, and skewed partitions can be split
    lowest = written(linked.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    ids = linked.join(lowest, "component").select("fp", "component_id")
    named = written(least.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named-fingerprints")
    release(least, linked, lowest)
    return found.join(named, "fp").select("doc", "fp", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 lower-case hex digits), component_id of every document (see `near_groups`)."""
    return near_groups(docs, id_col, text_col).select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[[DataFrame, str, str], DataFrame] = near_groups) -> DataFrame:
    """One row of each component, that with the smallest id, with the columns of docs.

    `groups` gives `doc` and `component_id` of every row, by linked fingerprints if not told otherwise.
    Rows are told apart by a number that is stored with them, so of rows that
    repeat an id exactly one stays; a row with a null id stays only where its component has no
    other. All texts without words (null ones, too) are one component. Very long texts count whole. Columns come back in their order, whatever
    their names. An empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = written(docs.select(F.monotonically_increasing_id().alias("n"), row.alias("row")), "numbered-documents")
    grouped = groups(held.select("n", F.col(f"row.{text_col}").alias("t")), "n", "t").select(F.col("doc").alias("n"), F.col("component_id").alias("group"))
    ids = held.select("n", F.col(f"row.{id_col}").alias("id"))
    first = grouped.join(ids, "n").groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first"))
    return held.join(first.select(F.col("first.n").alias("n")), "n", "left_semi").select("row.*")
