"""BPE round trip (1), token counts (9), packing (3) and the token file (7) against the libraries."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from sievework.llm import bpe, packing, token_counts, token_file  # noqa: E402
from sievework.llm.byte_bpe import byte_bpe  # noqa: E402
from sievework.llm.packing import first_fit_decreasing  # noqa: E402
from sievework.llm.token_file import Segment, write_segment  # noqa: E402


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def byte_ids(texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_round_trip_equals_library(docs, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))), repr(t)[:60]


def test_encode_then_decode(docs, texts):
    coded = bpe.bpe_encode(docs)
    back = {r.doc_id: r.text for r in bpe.bpe_decode(coded).collect()}
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        assert back[i] == library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_every_code_point_equals_library():
    """Also those that are newer than the tables of Python's standard library."""
    own, library = bpe.word_bpe("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    signs = [chr(c) for c in [*range(0x20000), *range(0x2F800, 0x2FA20), 0x31350, *range(0xE0000, 0xE01F0), 0x10FFFF] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b1{c} {c}É" for c in signs]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert not [hex(ord(c)) for c, t, e in zip(signs, texts, want) if own.encode(t) != e.ids]


def test_newer_code_points_among_added_tokens(spark):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["x\u1c89Y<|endoftext|>\ua7cb  Z\u0558", "\u1c89" * 3000 + " end", "ΑΣ\u0c5c ΣΑΣ"]
    for r in bpe.bpe_round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_merging_long_and_short_words_together():
    own, library = bpe.word_bpe("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(0)
    words = ["".join(rng.choice("aabcdethn") for _ in range(rng.randint(1, 60))) for _ in range(800)] + ["a" * n for n in range(1, 40)]
    merged = own.merge([w.encode() for w in words])
    for w, ids in zip(words, merged):
        assert ids.tolist() == library.encode(w, add_special_tokens=False).ids


def test_words_merged_alone_equal_library_and_rounds():
    own, library = bpe.word_bpe("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    words = ["".join(rng.choice("aabcdethn") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    words += ["".join(rng.choice(signs) for _ in range(n)) for n in (1_023, 1_024, 5_000, 30_000) for signs in ("etaoinshrdlu", "ab", "aaaaaaab", "日本語的中文字é")]
    words += ["a" * n for n in (1, 2, 3, 1_024, 9_999)] + ["ab" * 3_000]
    alone, mixed = [own.merge_long(w.encode()).tolist() for w in words], own.merge([w.encode() for w in words])
    for w, a, b in zip(words, alone, mixed):
        assert a == b.tolist() == library.encode(w, add_special_tokens=False).ids, w[:40]


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    own = bpe.WordBPE(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "KEPT_LETTERS", 5_000)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeth") for _ in range(200)) for _ in range(10)) for _ in range(20)]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for t in texts:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert sum(map(len, own.known)) <= 5_000


def test_kept_byte_words_and_piece_tables_are_bounded(monkeypatch):
    import sentencepiece

    from sievework.llm import byte_bpe as byte_level

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdeth") for _ in range(200)) for _ in range(10)) for _ in range(20)]
    monkeypatch.setattr(byte_level, "KEPT_LETTERS", 5_000)
    own, library = byte_level.ByteBPE(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in texts:
        assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
        assert sum(map(len, own.known)) <= 5_000 + len(t) + 100
    monkeypatch.setattr(token_counts, "KEPT_LETTERS", 5_000)
    pieces, library = token_counts.Pieces(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for t in texts:
        assert pieces.count(t) == len(library.encode(t))
        assert sum(map(len, pieces.tables)) <= 5_000 + len(t) + 10


def test_byte_ids_equal_library_on_random_signs(byte_ids, texts):
    own, library = byte_bpe("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in own.encode([t or "" for t in texts])] == byte_ids
    rng = random.Random(1)
    signs = [chr(c) for c in [*range(0, 0x300), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x660, 0x4E00, 0x1F600]] + list(" \n'st're  ") * 40
    for _ in range(500):
        x = "".join(rng.choice(signs) for _ in range(30))
        assert own.encode([x])[0].tolist() == library.encode(x, add_special_tokens=False).ids, repr(x)


def test_counts_equal_library(docs, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), repr(t)[:60]


def test_every_prefix_is_exact(texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = token_counts.pieces("piece_bpe_32k.model")
    for t in [x for x in texts if x][:70]:
        t = t[:300]
        assert own.prefix_counts(t).tolist() == [len(library.encode(t[:k])) for k in range(len(t) + 1)], repr(t)[:60]
        fits = own.fits(t, 20)
        assert len(library.encode(t[:fits])) <= 20 and (fits == len(t) or len(library.encode(t[: fits + 1])) > 20)


def test_packing(docs, byte_ids):
    rows = packing.pack_documents(docs).collect()
    ids = {i: np.array([*x, 1], "<u4") for i, x in enumerate(byte_ids)}
    covered = {i: [] for i in ids}
    sequences = {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        covered[r.doc_id].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, spans in covered.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[i])
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    total = sum(map(len, ids.values()))
    assert len(sequences) * packing.LENGTH - total <= 8 * packing.LENGTH + 0.05 * total


def plain_first_fit(lengths, capacity):
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        for b in range(len(bins) + 1):
            if b == len(bins):
                bins.append(0)
            if bins[b] + lengths[i] <= capacity:
                out[i] = (b, bins[b])
                bins[b] += lengths[i]
                break
    return out


def test_tournament_tree_equals_plain_first_fit():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 500):
        lengths = rng.integers(1, 101, n)
        sequence, offset = first_fit_decreasing(lengths, 100)
        assert list(zip(sequence.tolist(), offset.tolist())) == plain_first_fit(lengths.tolist(), 100)


def test_small_groups_pack_all(docs):
    pieces = packing.token_pieces(docs)
    rows = packing.pack(pieces, group=7).collect()
    assert len(rows) == pieces.count() and max(r.offset + r.length for r in rows) <= packing.LENGTH
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) == max(o + n for o, n in x) for x in used.values())


def test_token_file(docs, byte_ids):
    got = sorted(token_file.token_file_round_trip(docs).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, ids in zip(got, byte_ids, strict=True):
        ids = np.array([*ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_segments_as_files(spark, docs, byte_ids, tmp_path, monkeypatch):
    segments = token_file.write_token_file(docs)
    paths = [r.path for r in token_file.write_files(segments, str(tmp_path / "ids")).collect()]
    assert sorted(paths) == sorted(str(p) for p in (tmp_path / "ids").iterdir()) and len(paths) == segments.count()
    back = token_file.read_files(spark, f"file://{tmp_path}/ids")
    columns = ["part", "base", "n_docs", "n_tokens", "image"]
    assert sorted(back.select(columns).collect()) == sorted(segments.select(columns).collect())
    joined = np.concatenate([Segment(open(p, "rb").read()).read() for p in sorted(paths)])
    assert joined.tolist() == [i for ids in byte_ids for i in [*ids, 0]]
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in token_file.read_token_file(back).collect())
    assert [x[2] for x in got] == [len(ids) + 1 for ids in byte_ids]


def test_a_reader_of_the_stored_images_holds_few_at_once(docs, byte_ids, monkeypatch):
    # without a limit a file of the whole job is one row group and a few large pages; a reader of it ran out of memory
    monkeypatch.setattr(token_file, "SEGMENT_TOKENS", 100)
    segments = token_file.write_token_file(docs.coalesce(1))
    files = list(Path(segments._stored.removeprefix("file://")).glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) == segments.count() > token_file.GROUP_IMAGES * len(files) and max(groups) <= token_file.GROUP_IMAGES
    got = sorted((r.doc_id, r.n_tokens) for r in token_file.read_token_file(segments).collect())
    assert [n for _, n in got] == [len(ids) + 1 for ids in byte_ids]


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000, 70_000])
def test_segment_round_trip(n):
    rng = np.random.default_rng(n)
    for tokens in (np.minimum(rng.zipf(1.2, n), 50_256), rng.integers(0, 2**32, n), np.full(n, 7), np.where(rng.random(n) < 0.01, 4_000_000_000, 3)):
        tokens = tokens.astype(np.uint32)
        image = write_segment([5, None], [n, 0], tokens)
        segment = Segment(image)
        assert (segment.read() == tokens).all() and segment.doc_ids == [5, None]
        for i in range(0, len(segment.low), 37):
            assert (segment.block(i) == tokens[i * 128 : (i + 1) * 128]).all()
    assert len(write_segment([1], [70_000], np.minimum(rng.zipf(1.2, 70_000), 50_256).astype(np.uint32))) < 3 * 70_000
    with pytest.raises(ValueError):
        Segment(image[:-5] + bytes([image[-5] ^ 1]) + image[-4:])


@pytest.mark.parametrize("operator", [bpe.bpe_round_trip, token_counts.token_counts, packing.pack_documents, token_file.token_file_round_trip])
def test_repeated_rows_null_ids_and_empty_tables(repeated, nothing, operator):
    got = operator(repeated)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1)] * 3 + [(False, 2)] * 2 + [(True, 0)] * 2
    assert operator(nothing).count() == 0
