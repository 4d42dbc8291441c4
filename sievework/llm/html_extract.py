"""Main text of pages: a linear-chain conditional random field over leaf blocks.

Each block has features of the tags and names it stands under and of its text;
the chain says whether its neighbours agree. The field is fitted on labelled
pages by maximum likelihood (forward-backward over all pages at once) and a page
is decoded by Viterbi.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .html_blocks import Block, blocks
from .labelled_pages import labelled_pages

#: The bound of the labelled sample.
PAGES = 600
_RIGHTS = re.compile(r"©|\bcopyright\b|all rights reserved", re.I)
_CALLS = re.compile(r"\b(cookies?|subscribe|newsletter|sign (in|up)|log ?in|advertisement|sponsored|share (this|on)|read more|related|privacy|terms of|leave a (comment|reply)|reply)\b", re.I)


def text_features(block: Block) -> list[str]:
    """Features of the text and the block's own tag."""
    text, n = block.text, len(block.text)
    share = block.linked / n
    size = "xs" if n < 20 else "s" if n < 80 else "m" if n < 250 else "l"
    out = ["bias", f"tag:{block.tag}", f"size:{size}", f"place:{block.place}", f"place:{block.place} tag:{block.tag}", f"place:{block.place} size:{size}"]
    out.append("links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
    if text[-1] in ".!?…\"”»)":
        out.append("ends")
    if n < 200 and _RIGHTS.search(text):
        out += ["rights", f"place:{block.place} rights"]
    if n < 200 and _CALLS.search(text):
        out += ["calls", f"place:{block.place} calls"]
    return out


class Field:
    """Weights of features for main against other, and of neighbouring labels; label 1 is main."""

    def __init__(self, weights: dict[str, float], first: np.ndarray, step: np.ndarray):
        self.weights, self.first, self.step = weights, first, step
        self._under: dict[frozenset[str], float] = {}

    def score(self, block: Block) -> float:
        get = self.weights.get
        under = self._under.get(block.under)
        if under is None:
            if len(self._under) > 100_000:
                self._under.clear()
            under = self._under[block.under] = sum(get(f, 0.0) for f in sorted(block.under))
        return under + sum([get(f, 0.0) for f in text_features(block)])

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not page:
            return []
        (a00, a01), (a10, a11) = self.step.tolist()
        zero, one = float(self.first[0]), float(self.first[1]) + self.score(page[0])
        back = []
        for block in page[1:]:
            e = self.score(block)
            back.append((zero + a00 < one + a10, zero + a01 < one + a11))
            zero, one = max(zero + a00, one + a10), max(zero + a01, one + a11) + e
        label = one > zero
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[str, list[str]]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a small quadratic penalty, by gradient steps with adapted rates."""
    parsed, labels = [], []
    for html, main in pages:
        found, wanted = blocks(html), set(main)
        if found:
            parsed.append(found)
            labels.append([b.text in wanted for b in found])
    names: dict[str, int] = {}
    rows, columns, at = [], [], 0
    steps, width = max(map(len, parsed)), len(parsed)
    place = np.full((steps, width), -1)
    y = np.zeros((steps, width), int)
    for p, (page, truth) in enumerate(zip(parsed, labels)):
        for t, (block, label) in enumerate(zip(page, truth)):
            for f in [*sorted(block.under), *text_features(block)]:
                rows.append(at)
                columns.append(names.setdefault(f, len(names)))
            place[t, p], y[t, p] = at, label
            at += 1
    rows, columns = np.array(rows), np.array(columns)
    real = place >= 0
    size = len(names)
    w = np.zeros(size + 6)  # features, first label (2), step between labels (2 x 2)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    seen = np.zeros(at)
    seen[place[real]] = y[real]
    both = real[1:] & real[:-1]
    counted = np.concatenate((np.bincount(columns, seen[rows], size), [(y[0] == 0).sum(), (y[0] == 1).sum()], [((y[:-1] == a) & (y[1:] == b) & both).sum() for a in (0, 1) for b in (0, 1)]))
    for i in range(1, rounds + 1):
        emit = np.bincount(rows, w[columns], at)
        e = np.where(real, emit[place], 0.0)
        first, step = w[size : size + 2], w[size + 2 :].reshape(2, 2)
        forward, backward = np.zeros((steps, width, 2)), np.zeros((steps, width, 2))
        forward[0] = first + np.stack((np.zeros(width), e[0]), 1)
        for t in range(1, steps):
            new = np.logaddexp.reduce(forward[t - 1][:, :, None] + step, axis=1)
            new[:, 1] += e[t]
            forward[t] = np.where(real[t][:, None], new, forward[t - 1])
        total = np.logaddexp.reduce(forward[-1], axis=1)
        for t in range(steps - 2, -1, -1):
            ahead = backward[t + 1].copy()
            ahead[:, 1] += e[t + 1]
            backward[t] = np.where(real[t + 1][:, None], np.logaddexp.reduce(step + ahead[:, None, :], axis=2), backward[t + 1])
        likely = np.exp(forward + backward - total[:, None])[:, :, 1]
        expected = np.zeros(at)
        expected[place[real]] = likely[real]
        ahead = backward[1:].copy()
        ahead[:, :, 1] += e[1:]
        pairs = np.exp(forward[:-1][:, :, :, None] + step + ahead[:, :, None, :] - total[None, :, None, None])[both].sum(axis=0)
        model = np.concatenate((np.bincount(columns, expected[rows], size), [(1 - likely[0]).sum(), likely[0].sum()], pairs.ravel()))
        gradient = (counted - model) / width - decay * w
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w + rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8) / (1 + i / 30)
    return Field({f: float(w[i]) for f, i in names.items()}, w[size : size + 2], w[size + 2 :].reshape(2, 2))


_fitted: dict[tuple[int, int], Field] = {}


def field(pages: int = PAGES, seed: int = 3) -> Field:
    """The field, fitted once in a program on labelled pages (a documented bound that no table changes)."""
    if (pages, seed) not in _fitted:
        _fitted[pages, seed] = fit(labelled_pages(pages, seed))
    return _fitted[pages, seed]


def main_text(html: str, model: Field) -> str:
    page = blocks(html)
    return "\n".join([b.text for b, main in zip(page, model.decode(page)) if main])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Field | None = None) -> DataFrame:
    """id, url, text (empty if none) and n_chars of every page.

    Null html counts as empty. Ids and urls are only carried: null and repeated
    ones are kept as they are. An empty table gives an empty result. Other columns are not
    read, whatever their names. A page, however long, is read whole; nothing is capped.
    """
    model = model or field()
    weights, first, step = model.weights, model.first, model.step

    def make():
        own = Field(weights, first, step)

        def each(batch):
            texts = [main_text(x or "", own) for x in batch.column(2).to_pylist()]
            return {"id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts))}

        return each

    out = map_arrow(pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)), make, "id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
