"""BPE encoding and decoding with word ends, in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks the keys of all
neighbouring pairs up in the sorted pair keys by binary search, finds each
word's lowest rank, merges that pair wherever it stands in the word (left to
right), and closes the gaps; words without a further merge leave the array. A
merge only makes pairs of later rank than its own, so merging all places of a
word's best pair at once equals merging them one by one.

A long word is merged alone: its pair ranks stay, and a round looks up only the
pairs next to what it merged.

Words recur, so a worker keeps what it has encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Words that a worker keeps, and their letters; all are dropped when there are more.
KEPT, KEPT_LETTERS = 300_000, 6_000_000
#: Symbols from which a word is merged alone.
LONG = 1_024
#: Bytes of words that are merged at once.
ROUND_BYTES = 1_000_000
NO_RANK = np.iinfo(np.int64).max


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


#: Signs outside the Latin blocks and general punctuation, where every code point has long been assigned.
UNUSUAL = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")


class WordBPE:
    """A BPE vocabulary file whose words end in a suffix: lower case, words by a pattern, byte-level signs."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["dropout"] or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("not a word-end BPE file of the supported form")
        self.vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # \s is stated as a property, so that it means the same in any pattern library
        self.words = regex.compile(pre[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        # a text with newer code points is lower-cased and cut by the library; the merges are the same
        self.normalizer, self.older = Tokenizer.from_file(path).normalizer, set(map(chr, range(0x250)))
        self.cutter = pre_tokenizers.Split(Regex(pre[0]["pattern"]["Regex"]), pre[0]["behavior"].lower(), pre[0]["invert"])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for t, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = t
        signs = byte_signs()
        self.inner = np.array([self.vocab[s] for s in signs], np.int64)
        self.final = np.array([self.vocab[s + suffix] for s in signs], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)[order]
        self.known: dict[str, tuple[str, str, int]] = {}
        self.letters = 0

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs stand in the sorted keys, and their ranks."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return at, np.where(self.keys[at] == pair, self.ranks[at], NO_RANK)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word. Symbols are chained; a round changes only the places it merges and their neighbours."""
        raw = np.frombuffer(word, np.uint8)
        symbols = self.inner[raw]
        symbols[-1] = self.final[raw[-1]]
        while True:
            n = len(symbols)
            ahead, behind = np.arange(1, n + 1), np.arange(-1, n)
            at, rank = self._find(symbols[:-1], symbols[1:])
            at, rank, alive, left = np.append(at, 0), np.append(rank, NO_RANK), np.ones(n, bool), n
            while 2 * left > n:
                best = rank.min()
                if best == NO_RANK:
                    return symbols[alive]
                places = np.flatnonzero(rank == best)
                places = places[_every_second(ahead[places[:-1]] == places[1:])]
                gone = ahead[places]
                symbols[places] = self.made[at[places[0]]]
                ahead[places] = ahead[gone]
                behind[ahead[places]] = places
                rank[gone], alive[gone] = NO_RANK, False
                left -= len(gone)
                before = behind[places]
                touched = np.concatenate((places, before[before >= 0]))
                after = ahead[touched]
                at[touched], new = self._find(symbols[touched], symbols[np.minimum(after, n - 1)])
                rank[touched] = np.where(after < n, new, NO_RANK)
            symbols = symbols[alive]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty)."""
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        if len(short) == len(words):
            return self.merge_together(words)
        together = dict(zip(short, self.merge_together([words[i] for i in short])))
        return [together[i] if i in together else self.merge_long(w) for i, w in enumerate(words)]

    def merge_together(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty), all in the same rounds."""
        if not words:
            return []
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[raw[ends]]
        names = np.arange(len(words))
        while len(symbols):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            at, rank = self._find(symbols[:-1], symbols[1:])
            rank = np.append(rank, NO_RANK)
            rank[starts + sizes - 1] = NO_RANK  # a pair must not reach into the next word
            best = np.minimum.reduceat(rank, starts)
            done = best == NO_RANK
            if done.any():
                for w in np.flatnonzero(done).tolist():
                    out[names[w]] = symbols[starts[w] : starts[w] + sizes[w]]
                keep = np.repeat(~done, sizes)
                symbols, rank, at = symbols[keep], rank[keep], np.append(at, 0)[keep]
                sizes, names, best = sizes[~done], names[~done], best[~done]
                if not len(symbols):
                    break
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            else:
                at = np.append(at, 0)
            hit = rank == np.repeat(best, sizes)
            # of places that overlap (a a a), every second one from the left
            index = np.arange(len(hit))
            begins = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), index, 0))
            hit &= (index - begins) % 2 == 0
            places = np.flatnonzero(hit)
            symbols[places] = self.made[at[places]]
            gone = np.ones(len(symbols), bool)
            gone[places + 1] = False
            word = np.repeat(np.arange(len(sizes)), sizes)
            sizes = sizes - np.bincount(word[places], minlength=len(sizes))
            symbols = symbols[gone]
        return out

    def has_newer(self, text: str) -> bool:
        """Whether there are code points that Python's Unicode tables don't know: their lower case, and whether they are letters, depend on the library's version."""
        for c in set(text) - self.older:
            if unicodedata.category(c) in ("Cn", "Cs"):
                return True
            self.older.add(c)
        return False

    def parts(self, text: str) -> list[str]:
        """The words of a text, with the strings of added tokens as they are."""
        if self.specials is not None and any(s in text for s in self.added):
            out = []
            for piece in self.specials.split(text):
                out += [piece] if piece in self.added else self.parts(piece)
            return out
        if not text.isascii() and UNUSUAL.search(text) and self.has_newer(text):
            text = self.normalizer.normalize_str(text.encode("utf-8", "replace").decode("utf-8"))
            return [w for w, _ in self.cutter.pre_tokenize_str(text)]
        # one sign at a time, so that the final sigma stays an ordinary one
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.words.findall(text)

    def learn(self, new: set[str]) -> None:
        """Encodes words that are not known yet: ids in decimal, tokens, and their number."""
        some: list[str] = []
        size = 0
        for w in new:
            if w in self.added:
                self.known[w] = (str(self.added[w]), w, 1)
                continue
            some.append(w)
            size += len(w)
            if size > ROUND_BYTES:
                self._learn(some)
                some, size = [], 0
        if some:
            self._learn(some)

    def _learn(self, words: list[str]) -> None:
        tokens = self.tokens
        for w, ids in zip(words, self.merge([w.encode("utf-8", "surrogatepass") for w in words])):
            ids = ids.tolist()
            self.known[w] = (" ".join(map(str, ids)), " ".join([tokens[i] for i in ids]), len(ids))

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self.look_up([self.parts(text)])[0] for i in x[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces; special tokens are not skipped."""
        return " ".join([self.tokens[i] for i in ids])

    def look_up(self, texts: list[list[str]]) -> list[list[tuple[str, str, int]]]:
        new = set().union(*texts).difference(self.known)
        letters = sum(map(len, new))
        if len(self.known) + len(new) > KEPT or self.letters + letters > KEPT_LETTERS:
            self.known.clear()
            new = set().union(*texts)
            self.letters, letters = 0, sum(map(len, new))
        self.letters += letters
        self.learn(new)
        known = self.known
        return [[known[w] for w in words] for words in texts]


def _every_second(chained: np.ndarray) -> np.ndarray:
    """Of places that overlap (a a a), every second one from the left; chained[i] says that place i + 1 begins where place i ends."""
    index = np.arange(len(chained) + 1)
    begins = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), index, 0))
    return (index - begins) % 2 == 0


_loaded: dict[str, WordBPE] = {}


def word_bpe(model: str) -> WordBPE:
    """The vocabulary, once in each worker; `model` is a path or the name of a public tokenizer's file."""
    if model not in _loaded:
        path = model
        if "/" not in model:
            import public_tokenizers

            path = public_tokenizers.path(model)
        _loaded[model] = WordBPE(path)
    return _loaded[model]


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "word_bpe_49k.json") -> DataFrame:
    """id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of every row.

    Null text counts as empty (no ids, empty decoding). Ids are only carried: null ones stay null, and
    rows that repeat give rows that repeat. Very long texts are encoded whole; a worker holds the words of 128 texts at once. An empty table
    gives an empty result. Other columns are not read, whatever their names.
    """

    def make():
        own = word_bpe(model)

        def digest(strings: list[str]) -> str:
            return hashlib.sha256(" ".join(strings).encode("utf-8", "surrogatepass")).hexdigest()

        def each(batch):
            out = {"id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 128):
                for found in own.look_up([own.parts(x or "") for x in texts[at : at + 128]]):
                    out["n_tokens"].append(sum([x[2] for x in found]))
                    out["ids_sha256"].append(digest([x[0] for x in found]))
                    out["decoded_sha256"].append(digest([x[1] for x in found]))
            return out

        return each

    out = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), make, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "word_bpe_49k.json") -> DataFrame:
    """id and `ids` (array of int) of every row.

    Null and empty texts give an empty array. Ids are only carried, null and repeated ones, too. A very long text is one row of
    as many ids. An empty table gives an empty result. Other columns are not read.
    """

    def make():
        own = word_bpe(model)
        return lambda batch: {"id": batch.column(0), "ids": [own.encode(x or "") for x in batch.column(1).to_pylist()]}

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), make, "id long, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = "word_bpe_49k.json") -> DataFrame:
    """id and `text` of every row of ids (column `ids`).

    Null and empty arrays give the empty text; an id that the vocabulary lacks is an error. Ids of rows are only carried, null and repeated ones, too. An
    empty table gives an empty result. Other columns are not read.
    """

    def make():
        own = word_bpe(model)
        return lambda batch: {"id": batch.column(0), "text": [own.decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_arrow(coded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")), make, "id long, text string").withColumnRenamed("id", id_col)
