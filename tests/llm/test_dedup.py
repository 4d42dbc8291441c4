"""Exact dedup (8), SimHash (10) and sharding (4) against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import exact_dedup, near_dedup, queries, sharding, simhash

SF = "/root/testdata/sf0.001"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def classes(texts):
    out = defaultdict(list)
    for i, t in enumerate(texts):
        out[lowered(t)].append(i)
    return out


@pytest.mark.parametrize("often", [256, 2])  # 2: every group of copies takes the salted way
def test_exact_dedup(docs, texts, monkeypatch, often):
    monkeypatch.setattr(exact_dedup, "LEAST_FREQUENT", often)
    groups = classes(texts)
    for keep, best in (("max", max), ("min", min)):
        got = exact_dedup.exact_dedup(docs, keep=keep).collect()
        assert len(got) == len(texts)
        for r in got:
            t = lowered(texts[r.doc_id])
            own = groups[t]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best(own), len(own), r.doc_id == best(own), hashlib.sha256(t.encode()).hexdigest())
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == sorted(max(x) for x in groups.values())
    assert exact_dedup.drop_copies(docs).columns == docs.columns


@pytest.mark.parametrize("often", [256, 1])
def test_exact_dedup_of_repeated_rows_and_null_ids(repeated, nothing, monkeypatch, often):
    monkeypatch.setattr(exact_dedup, "LEAST_FREQUENT", often)
    got = exact_dedup.exact_dedup(repeated).collect()
    assert sorted((r.keep_id, r.group_size) for r in got) == [(1, 4)] * 4 + [(2, 3)] * 3
    assert sum(r.kept for r in got) == 2  # one row of each class
    assert exact_dedup.exact_dedup(nothing).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(repeated, keep="any")


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


def test_exact_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op8_exact_dedup"]).df()
    got = queries.queries()["op8_exact_dedup"](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].to_numpy())) == sorted(map(tuple, want[columns].to_numpy()))


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text).encode())
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    values = np.array(fps, np.uint64)
    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= 4) + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(fps))]


def test_simhash_components(docs, texts):
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(fps)


def test_simhash_on_a_table(spark):
    got = {r.doc_id: r for r in queries.queries()["op10_simhash_components"](spark, SF).collect()}
    ids = sorted(got)
    want = plain_components([int(got[i].fingerprint, 16) for i in ids])
    assert [got[i].component_id for i in ids] == [ids[c] for c in want]


def fingerprints_with_partners(n, seed=3):
    """Random fingerprints, two extreme ones, and partners at each distance from 1 to 6, some in chains."""
    rng = np.random.default_rng(seed)
    fps = [0, 2**64 - 1, *rng.integers(0, 2**64, n, dtype=np.uint64).tolist()]
    for base in fps[: n // 2]:
        for d in range(1, 7):
            fps.append(int(base) ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    return list(dict.fromkeys(map(int, fps)))


def joined(fps, found):
    place = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("slice_variants", [2_000_000, 1_500])
def test_one_partition_finds_all_links(monkeypatch, slice_variants):
    monkeypatch.setattr(simhash, "SLICE_VARIANTS", slice_variants)
    fps = fingerprints_with_partners(60)
    a, b = simhash.meet(np.array(fps, np.uint64), 0, 0, 4)
    assert joined(fps, zip(a.tolist(), b.tolist())) == plain_components(fps)


@pytest.mark.parametrize("bits,slice_variants", [(7, 2_000_000), (7, 200), (13, 2_000_000)])
def test_links_at_any_number_of_partitions(spark, monkeypatch, bits, slice_variants):
    """13: as many partitions as two billion fingerprints take."""
    monkeypatch.setattr(simhash, "SLICE_VARIANTS", slice_variants)
    monkeypatch.setattr(simhash, "SLICE_COPIES", 500)
    fps = fingerprints_with_partners(60)
    monkeypatch.setattr(simhash, "PART_VARIANTS", -(-len(fps) * 2081 // 2**bits))
    assert simhash.part_bits(len(fps)) == bits
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(table).collect()]
    assert joined(fps, found) == plain_components(fps)


def test_partitions_grow_smoothly_and_every_variant_is_listed_once():
    bits = [simhash.part_bits(n) for n in (0, 1, 10**6, 8 * 10**6, 8 * 10**6 + 1, 16 * 10**6, 10**8, 10**9, 5 * 10**10)]
    assert bits == sorted(bits) and bits[0] == 7 and bits[3] == bits[4] and bits[5] <= bits[4] + 1
    masks, fps = simhash.ball(2), np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    for k in (7, 12, 16, 20):
        parts = np.unique(simhash.parities(masks, k))
        assert len(parts) == 1 + k + k * (k - 1) // 2
        got = {}
        for to, begins, copies in simhash.dealt(fps, k):
            for part, some in zip(to.tolist(), np.split(copies, begins[1:])):
                got.setdefault(part, []).extend(some.tolist())
        want = {}
        for f in fps.tolist():
            for part in set(simhash.parities(masks ^ np.uint64(f), k).tolist()):
                want.setdefault(part, []).append(f)
        assert {p: sorted(x) for p, x in got.items()} == {p: sorted(x) for p, x in want.items()}


def test_large_group_of_near_copies_is_dealt_over_many_partitions():
    """20,000 fingerprints within 8 bits of one: no partition of 512 holds more than four times its share of variants."""
    rng = np.random.default_rng(8)
    center = rng.integers(0, 2**64, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(20_000)], np.uint64)
    fps, masks = np.unique(center ^ flips), simhash.ball(2)
    load = np.bincount(np.concatenate([simhash.parities(fps ^ m, 9) for m in masks]), minlength=512)
    assert load.sum() == len(fps) * len(masks) and load.max() < 4 * load.mean()


def test_hash_is_linear():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**64, (2, 500), dtype=np.uint64)
    for salt in (0, 1):
        assert (simhash.parities(a ^ b, 9, salt) == simhash.parities(a, 9, salt) ^ simhash.parities(b, 9, salt)).all()
    assert len(simhash.ball(2)) == len(np.unique(simhash.ball(2))) == 2081


def test_simhash_of_repeated_rows_null_ids_and_empty_tables(repeated, nothing):
    got = simhash.simhash_components(repeated).collect()
    assert sorted(r.component_id for r in got) == [1, 1, 1, 1, 2, 2, 2]
    assert simhash.simhash_components(nothing).count() == 0
    assert sorted(r.doc_id for r in simhash.drop_near_copies(repeated).collect()) == [1, 2]
    assert simhash.drop_near_copies(nothing).count() == 0
    only = repeated.where("doc_id IS NULL AND text IS NOT NULL")
    assert [r.component_id for r in simhash.simhash_components(only).collect()] == [None] and simhash.drop_near_copies(only).count() == 1


def test_near_copies_keep_one_row_each(docs, texts):
    kept = simhash.drop_near_copies(docs)
    groups = {r.component_id for r in simhash.simhash_components(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups) and kept.columns == docs.columns


def plain_similar_components(texts):
    """Components of all pairs whose 5-word shingles have Jaccard similarity 0.8 or more."""
    sets = []
    for t in texts:
        words = lowered(t).split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 5 * small >= 4 * large and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(texts))]


def test_common_shingles_of_sets(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, n, dtype=np.uint64)) for n in (0, 1, 5, 90, 300, 300, 40, 700)]
    monkeypatch.setattr(near_dedup, "SLICE_COLUMNS", 37)
    got = near_dedup.common_shingles(sets[:3] + sets[4:6], sets[3:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:3] + sets[4:6]]
    assert near_dedup.common_shingles(sets[:1], sets[:1]).tolist() == [[0]]


def edited(rng, words, share):
    out = list(words)
    for at in rng.choice(len(out), max(1, round(len(out) * share)), replace=False):
        out[at] = f"x{rng.integers(10**6)}"
    return out


@pytest.mark.parametrize("all_pairs,block", [(32, 512), (2, 7), (10, 40)])
def test_large_group_of_near_copies_and_a_common_passage(spark, monkeypatch, all_pairs, block):
    """Copies of one text with few and many changes, copies of copies, and texts that share half of their words."""
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(21)
    base = [f"w{k}" for k in range(120)]
    copies = [edited(rng, base, rng.choice((0.01, 0.02, 0.05, 0.09))) for _ in range(70)]
    copies += [edited(rng, copies[k], 0.02) for k in range(0, 70, 2)]
    passage = [f"p{k}" for k in range(60)]
    common = [passage + [f"y{rng.integers(10**6)}" for _ in range(rng.choice((8, 14, 40)))] for _ in range(60)]
    texts = [" ".join(x) for x in copies + common] + [" ".join(base)]
    want = plain_similar_components(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: r.component_id for r in near_dedup.similar_groups(rows.repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == want and 20 < len(set(want)) < 160


@pytest.mark.parametrize("all_pairs", [32, 2])  # 2: most keys take the way of large groups
def test_pipeline_drops_near_copies_by_shingles(spark, monkeypatch, all_pairs):
    """Copies with 1 to 4 % of the words changed; SimHash at 4 bits misses most of them."""
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", all_pairs)
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(20_000)}"
    texts = [None, "", " ", "two words", "Two words"]
    for k in range(24):
        base = [word() for _ in range(60 + 25 * k)]
        texts.append(" ".join(base))
        for j in range(8 if k < 4 else 3):
            copy = list(base)
            for at in rng.choice(len(base), (len(base) * (1 + j % 4)) // 100 + 1, replace=False):
                copy[at] = word()
            texts.append(" ".join(copy))
    want = plain_similar_components(texts)
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_copies(spark, rows.repartition(3), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want)) and got.columns == rows.columns


def test_pipeline_takes_fingerprint_components_as_candidates(spark, monkeypatch):
    """Without a common MinHash key: what fingerprints link is found, also beside a hub that is like neither, and only what is similar stays linked."""
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(near_dedup, "band_keys", lambda hashes, factors: [int(hashes.view(np.int64).sum()) + k for k in range(near_dedup.BANDS)])
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(10**6)}"
    often = " ".join(word() for _ in range(12))
    first, second, base = ([word() for _ in range(n)] for n in (60, 60, 900))
    texts = [" ".join([often] * 400 + x) for x in (first, second, [*second[:-1], word()])]
    texts += [" ".join(base), " ".join([*base[:-1], word()]), " ".join(word() for _ in range(900))]
    bits = lambda a, b: (int.from_bytes(simhash.fingerprint(texts[a].encode(), 5)) ^ int.from_bytes(simhash.fingerprint(texts[b].encode(), 5))).bit_count()
    assert max(bits(0, 1), bits(0, 2), bits(1, 2), bits(3, 4)) <= simhash.RADIUS < bits(3, 5)
    assert plain_similar_components(texts) == [0, 1, 1, 3, 3, 5]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_copies(spark, rows.repartition(3), SF).collect()) == [0, 1, 3, 5]


def test_sharding(docs, texts):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def plain_shard(key, shards):
    """The descent by plain numbers: the smallest exponential draw of each level, from the xxhash64 that Spark chains over key and name."""

    def draw(name, weight):
        h = xxhash.xxh64_intdigest(name.encode(), seed=xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed=42))
        return -math.log(((h >> 12) + 1) / 2**52) / weight

    size = lambda x: sum(map(size, x.values())) if isinstance(x, dict) else x
    for level in ("region", "rack", "shard"):
        # names sort by text, shard numbers by value; min takes the first of equal draws
        chosen = min(sorted(shards), key=lambda name: draw(f"{level} {name}", size(shards[name])))
        shards = shards[chosen]
    return chosen


@pytest.mark.parametrize("shards", [sharding.tree(16), sharding.tree(19), {"a": {"x": {0: 1.0, 1: 2.5}, "y": {2: 0.5}}, "b": {"x": {7: 3.0}}}])
def test_descent_equals_plain_draws(spark, shards):
    keys = [-5, 0, *range(1, 3000, 7), 2**40 + 1]
    rows = spark.createDataFrame([(k,) for k in keys], "id long").select("id", sharding.shard_of(F.col("id"), shards).alias("s"))
    assert {r.id: r.s for r in rows.collect()} == {k: plain_shard(k, shards) for k in keys}


def test_query_with_an_own_tree(docs, texts, spark):
    own = {"big": {"r": {0: 3.0, 4: 1.0}}, "small": {"r": {2: 1.0}}}
    rows = sharding.shard(docs, own).collect()
    assert {r.shard for r in rows} <= {0, 2, 4} and all(r.shard == plain_shard(r.doc_id, own) and r.grown_shard in (r.shard, 5) for r in rows)
    grown = {**own, "more": {"r": {9: 2.0}}}
    assert {r.grown_shard for r in sharding.shard(docs, own, grown).collect()} <= {0, 2, 4, 9}
    for bad in (sharding.tree(17), {**own, "small": {"r": {2: 2.0}}}, {**own, "more": {"r": {4: 1.0}}}):
        with pytest.raises(ValueError):
            sharding.shard(docs, own, bad)
    for shards, first in ((15, 16), (0, 0)):
        with pytest.raises(ValueError):
            sharding.tree(shards, first)


def test_shards_are_even_and_growth_moves_only_to_the_new_one(spark):
    sizes = [(first, n) for first, last in ((1, 3), (9, 11), (16, 19)) for n in range(first, last)]
    columns = [sharding.shard_of(F.col("id"), sharding.tree(m, first)).alias(f"s{first}_{m}") for first, n in sizes for m in (n, n + 1)]
    keys = spark.range(40_000).select(*{c._jc.toString(): c for c in columns}.values())
    counts = [r["count"] for r in keys.groupBy("s16_16").count().collect()]
    assert len(counts) == 16 and max(counts) < 1.1 * min(counts)
    for first, n in sizes:
        moved = keys.where(f"s{first}_{n} <> s{first}_{n + 1}")
        assert moved.where(f"s{first}_{n + 1} <> {n}").count() == 0
        assert abs(moved.count() / 40_000 - 1 / (n + 1)) < 0.01


def test_slots_where_one_id_holds_most_rows(spark):
    """Null and repeated ids with long texts: gapless slots, and rows of one id lie in many slices."""
    rows = [(None, "x" * (i % 900)) for i in range(1500)] + [(7, "word " * i) for i in range(500)] + [(None, None)] * 20 + [(8, "y" * 300_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and max(r["size"] for r in got) == 300_001


def test_weights_decide_and_changes_stay_in_their_subtree(spark):
    before, after = sharding.tree(16), sharding.tree(16)
    after["region0"]["rack0"][2] = 3.0
    keys = spark.range(20_000).select(sharding.shard_of(F.col("id"), before).alias("a"), sharding.shard_of(F.col("id"), after).alias("b"))
    assert abs(keys.where("b = 2").count() / 20_000 - 3 / 18) < 0.02
    assert keys.where("a <> b AND a > 7 AND b > 7").count() == 0  # region1 only gives
    assert keys.where("a <> b AND a BETWEEN 4 AND 7 AND b BETWEEN 4 AND 7").count() == 0  # so does rack1
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), {"r": {"k": {0: 0.0, 1: 1.0}}})


def test_sharding_of_repeated_rows_null_ids_and_empty_tables(repeated, nothing):
    rows = sharding.shard(repeated).collect()
    assert len(rows) == 7 and len({r.shard for r in rows if r.doc_id is None}) == 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(nothing).count() == 0
