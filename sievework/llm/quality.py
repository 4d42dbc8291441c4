"""Quality rules by compression bands.

A text is compressed whole and in fixed chunks. Its ratio must lie in a band
that depends on its length: repetitive text compresses far better than prose,
and noise or encoded data hardly at all. Texts of a chunk or more are also rejected when a
quarter of their bytes lie in chunks outside the chunk band, which finds
repetition or noise that the rest of the text hides. The chunks cover the whole text.

Base counts (words, lines, repeats) give a first verdict that the bands only
tighten.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

LEVEL = 3
#: Bytes below which a band holds, its smallest and its largest ratio. Longer texts compress better, so limits rise with
#: length. The largest are 0.05 to 0.3 over the largest ratio of documents labelled good in each class of length, the
#: smallest 0.02 to 0.08 under their smallest one (the last class has no such document and takes the limit before).
BANDS = (
    (400, 1.3, 2.1), (700, 1.35, 2.0), (1_000, 1.47, 2.05), (1_500, 1.6, 2.12), (2_500, 1.72, 2.22), (4_000, 1.84, 2.29),
    (8_000, 1.9, 2.41), (16_000, 2.08, 2.49), (32_000, 2.2, 2.6), (64_000, 2.25, 2.68), (float("inf"), 2.25, 2.8),
)
#: Bytes of a chunk, its band, and the share of bytes in chunks outside the band from which a text is rejected.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4_096, (1.9, 2.8), 0.25
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def fit_bands(sizes: np.ndarray, ratios: np.ndarray, below: float = 0.06, above: float = 0.12) -> tuple[tuple[float, float, float], ...]:
    """Bands for the classes of `BANDS` from the sizes and ratios of good documents: their smallest and largest ratio, and room on either side.

    A class without documents takes the limits before it. `BANDS` are rounded by hand from such a fit.
    """
    out, at = [], (0.0, float("inf"))
    least = 0.0
    for size, _, _ in BANDS:
        own = ratios[(sizes >= least) & (sizes < size)]
        if len(own):
            at = (float(own.min()) - below, float(own.max()) + above)
        out.append((size, *at))
        least = size
    return tuple(out)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that occur twice or more, the first one included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    key = ids[: n - window + 1]
    for k in range(1, window):
        if int(key.max()) >= (1 << 62) // len(numbers):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(numbers) + ids[k : n - window + 1 + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : n - window + 1 + k] |= twice
    return int(covered.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(SPACE):
            seen.add(line)
    return n


def bands_hold(data: bytes, compress, bands: tuple[tuple[float, float, float], ...] = BANDS) -> tuple[float, float, bool]:
    """The whole text's ratio, the share of bytes in chunks outside the chunk band, and the verdict."""
    if not data:
        return 0.0, 0.0, False
    ratio = len(data) / len(compress(data))
    low, high = next((lo, hi) for size, lo, hi in bands if len(data) < size)
    outside = 0
    if len(data) >= CHUNK:
        for end in range(CHUNK, len(data) + CHUNK, CHUNK):
            # the last chunk ends with the text and counts for the bytes that no chunk before it holds
            at = min(end, len(data)) - CHUNK
            r = CHUNK / len(compress(data[at : at + CHUNK]))
            outside += (at + 2 * CHUNK - end) * (not CHUNK_BAND[0] <= r <= CHUNK_BAND[1])
    share = outside / len(data)
    return ratio, share, low <= ratio <= high and share < CHUNK_SHARE


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Counts and verdict of every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, outside_share.

    Null and empty texts have no words and fail. Ids are only carried: null and
    repeated ones are kept as they are. Very long texts are read and compressed whole, one at a time. An empty table gives an empty
    result. Other columns are not read, whatever their names.
    """

    def make():
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "outside_share")

        def each(batch):
            out: dict = {"id": batch.column(0)} | {k: [] for k in names}
            for text in batch.column(1).to_pylist():
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                repeats = repeated_words(words)
                failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
                ratio, share, holds = bands_hold(data, compress)
                spaces = len(data) - len(data.translate(None, SPACE))
                found = (len(words), len(text) - spaces, len(data) - len(data.translate(None, SYMBOLS)), duplicate_lines(data), repeats, failed, holds and not failed, ratio, share)
                for k, v in zip(names, found):
                    out[k].append(v)
            return out

        return each

    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, outside_share double"
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), make, schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is kept, with their columns: a filter without a shuffle.

    Rows with a null, empty or short text go; a null id, repeated rows and further
    columns make no difference. Very long texts are judged whole. An empty table stays empty.
    """

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress

        def verdict(text: str | None) -> bool:
            data = (text or "").encode("utf-8", "surrogatepass")
            words = data.split()
            return len(words) >= MIN_WORDS and 100 * repeated_words(words) <= MAX_REPEAT_PERCENT * len(words) and bands_hold(data, compress)[2]

        return texts.map(verdict).astype(bool)

    return docs.where(kept(F.col(text_col)))
