"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a key draws an exponential number for every child from a hash of
the key and the child's name, divided by the child's weight, and descends into
the smallest. A child's draws depend on nothing but its own weight, so when a
weight changes, keys move only into the subtree that grew or out of the one
that shrank, and all other draws stand.

A further shard opens a region of its own: only the draw at the root gains a
child, so it takes rows only into itself. `law` is therefore `key`: the id and
the number of shards decide. A grown tree of any other form is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width

LAW = "key"
#: Shards of the first build-out: racks of four, two racks to a region.
RACK, RACKS = 4, 2

#: region -> rack -> shard number -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def tree(shards: int, first: int = 16) -> Tree:
    """Regions of two racks of four for the `first` shards, then a region for each further one.

    Fewer shards than the first build-out would move rows among old shards when they grow, so that is an error;
    a store that began with 9 shards has `first=9` for ever.
    """
    if not 1 <= first <= shards:
        raise ValueError("there must be as many shards as in the first build-out, and one at least")
    out: Tree = {}
    for s in range(shards):
        if s < first:
            region, rack = f"region{s // (RACK * RACKS)}", f"rack{s // RACK}"
        else:
            region, rack = f"added{s}", f"added{s}"
        out.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return out


def leaves(shards: Tree) -> list[int]:
    """The numbers of a tree's shards."""
    return [s for racks in shards.values() for rack in racks.values() for s in rack]


def grows_by_regions(shards: Tree, grown: Tree) -> bool:
    """Whether `grown` has all regions of `shards` as they are, and further ones with further shards: then no row moves between old shards."""
    old = leaves(shards)
    added = [s for region, racks in grown.items() if region not in shards for rack in racks.values() for s in rack]
    return all(grown.get(region) == racks for region, racks in shards.items()) and len(set(old + added)) == len(old + added)


def _nearest(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What belongs to the child with the smallest draw; ties go to the first."""
    if len(children) == 1:
        return children[0][2]
    draws = []
    for i, (name, weight, _) in enumerate(children):
        if weight <= 0:
            raise ValueError("weights must be positive")
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double") + 1) / float(2**52)
        draws.append(F.struct((-F.log(unit) / weight).alias("draw"), F.lit(i).alias("i")))
    chosen = F.least(*draws)["i"]
    out = None
    for i, (_, _, value) in enumerate(children):
        out = F.when(chosen == i, value) if out is None else out.when(chosen == i, value)
    return out


def shard_of(key: Column, shards: Tree) -> Column:
    """The shard that the key descends to."""
    regions = []
    for region, racks in sorted(shards.items()):
        below = []
        for rack, leaves in sorted(racks.items()):
            nodes = [(f"shard {s}", w, F.lit(s)) for s, w in sorted(leaves.items())]
            below.append((f"rack {rack}", sum(leaves.values()), _nearest(key, nodes)))
        regions.append((f"region {region}", sum(sum(x.values()) for x in racks.values()), _nearest(key, below)))
    return _nearest(key, regions)


def shard(docs: DataFrame, shards: Tree | None = None, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row.

    `shards` is the tree (16 equal shards if not told otherwise), `grown` the one after the next growth (one more
    shard); weights may differ. A grown tree that would move rows between old shards raises ValueError.

    `size` is the UTF-8 bytes of the text (null: none) plus 1, `text_crc32` the
    unsigned crc32 of those bytes. Equal ids share a shard, and so do all null ids. Slots count from 0 without gaps in
    each shard, in the order of a hash of id, size and crc32, so rows that share an id are dealt over slices; only rows equal in
    all three (repeated rows) stand together. A shard's slots are
    numbered in slices of the hash, each by itself, and the slices' offsets come from
    counts of shards times shuffle partitions, so no task holds a shard. Very long texts only pass through
    crc32. An empty table gives an empty result; other columns are not read.
    """
    shards = shards or tree(16)
    if grown is None:
        new = max(leaves(shards)) + 1
        grown = {**shards, f"added{new}": {f"added{new}": {new: 1.0}}}
    if not grows_by_regions(shards, grown):
        raise ValueError("the grown tree must add regions and leave the others as they are")
    slices = shuffle_width(docs.sparkSession)
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(key.alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = F.shiftrightunsigned(F.xxhash64("id", "size", "text_crc32", F.lit("slot")), 32)
    rows = held.select(
        "*", shard_of(F.col("id"), shards).alias("shard"), order.alias("order"),
        F.floor(order * slices / F.lit(float(2**32))).cast("int").alias("slice"), shard_of(F.col("id"), grown).alias("grown_shard"),
    )
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "slice").orderBy("order", "id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "slice"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int"), (F.col("first") + F.col("place")).cast("long").alias("slot"), F.col("grown_shard").cast("int")
    )
