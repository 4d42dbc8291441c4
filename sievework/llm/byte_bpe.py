"""Token ids of a byte-level BPE file from the tokenizers library, a word at a time.

The library splits a text by its pattern and encodes each word alone; words
recur, so a worker hands each to the library's model once and keeps its ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np

from .bpe import byte_signs

#: Words whose ids a worker keeps, and their letters; all are dropped when there are more.
KEPT, KEPT_LETTERS = 1_200_000, 24_000_000


class ByteBPE:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a byte-level BPE file of the supported form")
        if max(spec["model"]["vocab"].values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        # the pattern of the library's byte-level pre-tokenizer; fixed value
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {x["content"]: np.array([x["id"]], "<u2").tobytes() for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.signs = dict(enumerate(byte_signs()))
        usual = _usual()
        self.unlike = re.compile(f"[^{_listed(usual)}]")
        self.quick, self.ascii = _quick(usual), _quick([c for c in usual if c.isascii()])
        self.plain = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
        self.known = _Known(self)

    def parts(self, text: str) -> list[str]:
        if any(s in text for s in self.added):
            out = []
            for piece in self.specials.split(text):
                out += [piece] if piece in self.added else self.words.findall(piece)
            return out
        # the standard library is faster, with its signs listed by class
        if text.isascii() and not self.plain.search(text):
            return self.ascii.findall(text)
        return (self.words if self.unlike.search(text) else self.quick).findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without adding special tokens."""
        if len(self.known) > KEPT or self.known.letters > KEPT_LETTERS:
            self.known = _Known(self)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, self.parts(x))), "<u2").astype("<u4") for x in texts]


class _Known(dict):
    """The ids of words, as 16-bit numbers; a new word goes to the library."""

    def __init__(self, owner: ByteBPE):
        super().__init__(owner.added)
        self.merge, self.signs, self.space, self.letters = owner.library.model.tokenize, owner.signs, owner.signs[32], 0

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            signs = word.replace(" ", self.space)  # the others stand for themselves
        else:
            signs = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs)
        ids = [t.id for t in self.merge(signs)]
        found = self[word] = array("H", ids).tobytes()
        self.letters += len(word)
        return found


def _usual() -> list[str]:
    """The signs, up to the end of the Latin blocks and in punctuation, that are listed by class; not the separators U+001C to U+001F, which Python takes for spaces."""
    return [chr(c) for c in [*range(0x1C), *range(0x20, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)] if unicodedata.category(chr(c)) not in ("Cn", "Cs")]


def _listed(signs: list[str]) -> str:
    return "".join(map(re.escape, signs))


def _quick(signs: list[str]) -> re.Pattern:
    """The library's pattern for texts of these signs alone: letters, numbers, white space, and the rest."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], " ": [], "other": []}
    for c in signs:
        kind = " " if c.isspace() else unicodedata.category(c)[0]
        kinds[kind if kind in kinds else "other"].append(c)
    letter, number, space, other = (f"[{_listed(x)}]" for x in kinds.values())
    return re.compile(f" ?{letter}+| ?{number}+|'(?:s|t|re|ve|m|ll|d)| ?{other}+|{space}+(?!\\S)|{space}+")


_loaded: dict[str, ByteBPE] = {}


def byte_bpe(model: str) -> ByteBPE:
    """The vocabulary, once in each worker; `model` is a path or the name of a public tokenizer's file."""
    if model not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = model
        if "/" not in model:
            import public_tokenizers

            path = public_tokenizers.path(model)
        _loaded[model] = ByteBPE(path)
    return _loaded[model]
