"""Exact token counts of every prefix, by dynamic programming over a piece vocabulary.

The encoding of a prefix ends in exactly one piece. `last[i]` is that piece for
the prefix of i characters: a piece of the vocabulary that ends at i and that,
after `last[i - len]`, stays apart from it when the two are encoded alone (a
sequence of pieces is an encoding if and only if each two neighbours are). The
count is the one before it plus one, so each prefix costs one step and
truncation or budget questions are look-ups, without encoding anything again.

Pieces never join what `Pieces.split` keeps apart (white-space marks begin
pieces, letters and other signs do not mix, signs without a longer piece stand
alone); the table of each such part is kept, as parts recur.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MARK = "▁"
#: Parts whose tables a worker keeps, and their letters; all are dropped when there are more.
KEPT, KEPT_LETTERS = 700_000, 14_000_000
#: Pairs of neighbours whose merging is known, likewise.
KEPT_PAIRS = 500_000
#: Sizes of pieces that end anywhere.
SHORT = (2, 1)


class Pieces:
    """A byte-fallback piece vocabulary whose merges go by score, leftmost first."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or not norm.escape_whitespaces or norm.remove_extra_whitespaces or not model.trainer_spec.byte_fallback or model.trainer_spec.model_type != 2:
            raise ValueError("only a byte-fallback BPE model without a character map is supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        #: type 1: ordinary pieces; control and unknown pieces never match in a text
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        #: the sizes of pieces that end in three characters, longest first
        sizes: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 2:
                sizes.setdefault(p[-3:], set()).add(len(p))
        self.tails = {t: (*sorted(x, reverse=True), *SHORT) for t, x in sizes.items()}
        self.pattern = self._pattern()
        self.apart: dict[tuple[str, str], bool] = {}
        self.tables: dict[str, bytes | array] = {}
        self.letters = 0

    def _pattern(self) -> re.Pattern:
        """What splits a marked text into parts that no piece crosses, tried on every piece."""
        long = [p for p in self.score if len(p) > 1]
        inside = sorted(set("".join(long)) - {MARK})
        kinds = ([c for c in inside if c.isalpha()], [c for c in inside if not c.isalpha()])
        runs = [f"[{''.join(map(re.escape, k))}]+" for k in kinds if k]
        split = re.compile(f"{MARK}+(?:{'|'.join(runs)})?|{'|'.join(runs)}|[\\s\\S]")
        if any(split.fullmatch(p) is None for p in long):
            split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        if any(split.fullmatch(p) is None for p in long):
            split = re.compile(r"[\s\S]+")
        return split

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the rule that `last` is checked against."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stay_apart(self, a: str, b: str) -> bool:
        if len(self.apart) > KEPT_PAIRS:
            self.apart.clear()
        known = self.apart[a, b] = self.merge(a + b) == [a, b]
        return known

    def table(self, part: str) -> bytes | array:
        """Token counts of the prefixes of 1, 2, ... characters of a part."""
        score, tails, apart = self.score, self.tails, self.apart
        n = len(part)
        last, count = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for size in tails.get(part[i - 3 : i], SHORT) if i > 2 else SHORT[2 - i :]:
                if size > i:
                    continue
                piece = part[i - size : i]
                if size > 1 and piece not in score:
                    continue
                before = last[i - size]
                if before:
                    stays = apart.get((before, piece))
                    if stays is None:
                        stays = self._stay_apart(before, piece)
                    if not stays:
                        continue
                last[i] = piece
                count[i] = count[i - size] + (1 if piece in score else len(piece.encode("utf-8", "surrogatepass")))
                break
            else:
                raise AssertionError("a prefix has no encoding")
        return bytes(count[1:]) if count[n] < 256 else array("l", count[1:])

    def tables_of(self, text: str) -> list[bytes | array]:
        """The tables of the parts of a text, in order."""
        parts, tables = self.split(text), self.tables
        new = set(parts).difference(tables)
        if len(tables) + len(new) > KEPT or self.letters > KEPT_LETTERS:
            tables.clear()
            self.letters, new = 0, set(parts)
        for part in new:
            tables[part] = self.table(part)
            self.letters += len(part)
        return [tables[x] for x in parts]

    def count(self, text: str) -> int:
        return sum([t[-1] for t in self.tables_of(text)])

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token counts of the prefixes of 0, 1, ... characters of the text."""
        out, base = [0], 0
        for t in self.tables_of(text):
            out += [base + x for x in t]
            base = out[-1]
        return np.array([0, *out[1 + len(self.prefix) :]] if text else [0], np.int64)

    def fits(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens such that all shorter ones fit, too."""
        if not text or budget < 1:
            return 0
        tables = self.tables_of(text)
        ends = list(accumulate(t[-1] for t in tables))
        at = bisect_right(ends, budget)
        chars = sum(len(t) for t in tables[:at])
        if at < len(tables):
            # counts within a part may fall as pieces grow; a prefix is safe while every prefix before it is
            base = ends[at - 1] if at else 0
            for c in tables[at]:
                if base + c > budget:
                    break
                chars += 1
        return max(0, chars - len(self.prefix))


def _path(model: str) -> str:
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """The vocabulary, once in each worker; `model` is a path or the name of a public tokenizer's file."""
    if model not in _loaded:
        _loaded[model] = Pieces(_path(model))
    return _loaded[model]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit and fit_chars of every row.

    `fit_chars` is the number of characters that fit the limit (all, where it is
    kept), read off the prefix counts. Null text counts as empty: 0 bytes, 0
    tokens. Ids are only carried: null and repeated ones are kept as they are.
    Very long texts are counted whole, part by part. An empty table gives an empty result.
    Other columns are not read.
    """

    def make():
        own = pieces(model)

        def each(batch):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [own.count(x) for x in texts]
            return {
                "id": batch.column(0),
                "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts],
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
                "fit_chars": [len(x) if n <= limit else own.fits(x, limit) for x, n in zip(texts, counts)],
            }

        return each

    out = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), make, "id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return out.withColumnRenamed("id", id_col)
