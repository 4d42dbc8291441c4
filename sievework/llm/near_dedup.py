"""Near-duplicate texts by their shingles: Jaccard similarity at or over a limit, checked exactly.

Candidates share a key. One key of a text is its SimHash component (`simhash.near_groups` over the same shingles), so
all texts whose fingerprints are linked share it. Texts at similarity 0.8 mostly differ in more bits than any
ball of variants reaches; for these there are MinHash bands as well: 32 keys of four minima each, so two texts
at similarity 0.8 share a key with probability 1 - 5e-8, and more similar ones
with a higher one. All that follows is exact: of two similar texts that share a key, either
a chain of checked links joins them already, or their shingle sets are compared.

1. Every text is compared with its keys' hubs: of a key, the text that shares most keys with others. In a group of near copies that is the
   original or what is closest to it, so one comparison a text joins most of the group.
2. Keys whose texts are one component by now are done. In other keys of up to 32 texts all pairs from different components are compared.
3. In larger ones the texts outside the key's largest component are compared with all others of the key, in tiles of two blocks
   by matrix products of shingle sets; a tile returns a star for each group that it joins. No pairs are listed, and
   rows of the largest component only meet those outside it. This costs the product of both numbers, which no method that compares sets
   can avoid for many texts that share a key and are not similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, local_roots
from ..sources.shared import release
from .common import map_arrow, written
from .simhash import near_groups

SEED = 42
WORDS, LEAST = 5, 0.8
BANDS, ROWS = 32, 4
#: Texts of a key up to which pairs are listed, and of a block beyond.
ALL_PAIRS, BLOCK = 32, 512
#: Different shingles whose matrix is multiplied at once.
SLICE_COLUMNS = 4_096
#: Shingles whose hashes are multiplied at once.
SLICE_SHINGLES = 1_024


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of all runs of `words` words, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(line, SEED)] if found else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts)))


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sets (sorted, distinct) have this Jaccard similarity; empty sets are equal."""
    short, long = sorted((len(a), len(b)))
    if short < least * long - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def band_keys(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """A signed key for each band of minima."""
    import xxhash

    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLICE_SHINGLES):
        least = np.minimum(least, (factors[:, None] * hashes[None, at : at + SLICE_SHINGLES]).min(axis=1))
    data = least.tobytes()
    size = 8 * ROWS
    made = [xxhash.xxh64_digest(data[k * size : (k + 1) * size], k) for k in range(BANDS)]
    return np.frombuffer(b"".join(made), ">i8").astype(np.int64).tolist()


def _keys(docs: DataFrame, words: int) -> DataFrame:
    """doc, n (its shingles) and each of its keys: the bands of minima, and the component of its fingerprint."""

    def make():
        factors = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

        def each(batch):
            sets = [shingles(x, words) for x in batch.column(1).to_pylist()]
            return {"doc": batch.column(0), "n": list(map(len, sets)), "keys": [band_keys(x, factors) for x in sets]}

        return each

    bands = written(map_arrow(docs, make, "doc long, n long, keys array<long>"), "band-keys")
    groups = near_groups(docs, "doc", "text", words).select("doc", F.xxhash64("component_id").alias("key"))
    keys = written(bands.select("doc", "n", F.explode("keys").alias("key")).unionByName(bands.select("doc", "n").join(groups, "doc")), "shingle-keys")
    release(bands)
    return keys


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc and the bytes of its sorted shingles."""

    def make():
        return lambda batch: {"doc": batch.column(0), "set": [shingles(x, words).tobytes() for x in batch.column(1).to_pylist()]}

    return map_arrow(docs, make, "doc long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are similar. b is joined first: a may be a hub, whose set then stays where it is."""
    full = pairs.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("t")), "b").join(sets.select(F.col("doc").alias("a"), F.col("set").alias("s")), "a")

    @F.pandas_udf("boolean")
    def close(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(s, t)], dtype=bool)

    return full.where(close("s", "t")).select("a", "b")


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set of the left has in common with each of the right."""
    sets = [*left, *right]
    rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    values, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = np.cumsum(counts > 1) - 1  # a shingle of one set is in no intersection
    some = counts[columns] > 1
    rows, columns = rows[some], kept[columns[some]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, SLICE_COLUMNS):
        lo, hi = np.searchsorted(columns, (at, at + SLICE_COLUMNS))
        held = np.zeros((len(sets), SLICE_COLUMNS), np.float32)
        held[rows[lo:hi], columns[lo:hi] - at] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out.astype(np.int64)


def tile_links(docs: np.ndarray, components: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], i: int, j: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group that similar texts of different components make in the tile of blocks i and j."""
    x, y = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    if not len(x) or not len(y):
        return docs[:0], docs[:0]
    sizes = np.array(list(map(len, sets)))
    common = common_shingles([sets[k] for k in x], [sets[k] for k in y])
    near = common >= least * (sizes[x][:, None] + sizes[y][None, :] - common) - 1e-9
    a, b = np.nonzero(near & (components[x][:, None] != components[y][None, :]))
    root = local_roots(len(docs), x[a], y[b])
    linked = np.flatnonzero(root != np.arange(len(docs)))
    return docs[linked], docs[root[linked]]


def _tiles(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between texts of different components that share a key, by tiles; rest has key, doc, component, size, main, n_main."""

    def block(rows: Column) -> Column:
        return F.greatest(F.ceil(rows / F.lit(BLOCK)), F.lit(1)).cast("int")

    outside = F.col("component") != F.col("main")
    own = rest.select("*", block(F.col("size") - F.col("n_main")).alias("others"), block(F.col("n_main")).alias("mains"))
    own = own.withColumn("block", F.when(outside, F.pmod(F.xxhash64("doc"), F.col("others"))).otherwise(F.col("others") + F.pmod(F.xxhash64("doc"), F.col("mains"))).cast("int"))
    # blocks of the largest component come last; a tile's first block lies outside of it
    across = F.transform(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    tiles = F.when(F.col("block") < F.col("others"), across).otherwise(F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: F.struct(k.alias("i"), F.col("block").alias("j"))))
    held = own.join(sets, "doc").select("key", "doc", "component", "block", "set", F.explode(tiles).alias("t")).select("key", "t.i", "t.j", "doc", "component", "block", "set")
    dealt = held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.Table) -> pa.RecordBatch:
            docs, components, blocks = (rows.column(c).to_numpy() for c in ("doc", "component", "block"))
            own = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
            a, b = tile_links(docs, components, blocks, own, rows.column("i")[0].as_py(), rows.column("j")[0].as_py(), least)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            tile = np.stack([batch.column(k).to_numpy() for k in range(3)])
            starts = np.concatenate(([0], np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1, [batch.num_rows])) if batch.num_rows else [0]
            for lo, hi in zip(starts, starts[1:]):
                now = tuple(tile[:, lo].tolist())
                if held and now != last:
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = now
        if held:
            yield links(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_links(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """Links (a, b) that join the rows of docs (`doc`, distinct, and `text`) as all pairs of similar shingles do."""
    keys = _keys(docs, words)
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(keys.join(many, "key"), "shared-keys")
    release(keys)
    weights = shared.groupBy("doc").agg(F.sum("size").alias("weight"))
    sets = written(_sets(docs.join(weights.select("doc"), "doc", "left_semi").select("doc", "text"), words), "candidate-sets")

    def size_fits(n: Column, m: Column) -> Column:
        return F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9

    # written, so that the join is one of two tables and rows of a hot key can be split
    hubs = written(shared.join(weights, "doc").groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc")).alias("minus"), "n")).alias("h")).select("key", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("m")), "hubs")
    near_hub = shared.join(hubs, "key").where((F.col("doc") != F.col("hub")) & size_fits(F.col("n"), F.col("m")))
    first = written(_verified(near_hub.select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct(), sets, least), "links-to-hubs")
    classes = connected_components(first, write=written)
    release(hubs, first)

    rooted = shared.join(classes, shared.doc == classes.node, "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("component"))
    rooted = written(rooted, "rooted-keys")
    release(shared)
    parts = rooted.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    sizes = parts.groupBy("key").agg(F.sum("rows").alias("size"), F.max(F.struct("rows", "component")).alias("main"))
    open_keys = sizes.where("size > 2 AND main.rows < size").select("key", "size", F.col("main.component").alias("main"), F.col("main.rows").alias("n_main"))
    open_keys = written(open_keys, "open-keys")
    rest = written(rooted.join(open_keys, "key"), "open-rows")
    release(rooted, open_keys)

    row = F.struct("doc", "n", "component")
    lists = rest.where(F.col("size") <= ALL_PAIRS).groupBy("key").agg(F.collect_list(row).alias("rows"))
    others = F.filter("rows", lambda x: (x["doc"] > F.col("one.doc")) & (x["component"] != F.col("one.component")) & size_fits(x["n"], F.col("one.n")))
    pairs = lists.select("rows", F.explode("rows").alias("one")).select("one", F.explode(others).alias("other")).select(F.col("one.doc").alias("a"), F.col("other.doc").alias("b")).distinct()
    listed = written(_verified(pairs, sets, least), "links-in-small-keys")
    tiled = written(_tiles(rest.where(F.col("size") > ALL_PAIRS), sets, least), "links-in-large-keys")
    release(rest, sets)
    return classes.toDF("a", "b").unionByName(listed).unionByName(tiled)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """`doc`, `component_id` (the smallest id that a row reaches over similar pairs, itself included); ids must be distinct.

    Null text counts as empty, and all texts without words are one component. Texts of fewer words than a shingle are one
    shingle. Long texts are read whole: their shingle sets have eight bytes a word. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    classes = connected_components(similar_links(rows, words, least), write=written)
    return rows.select("doc").join(classes, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("component_id"))
