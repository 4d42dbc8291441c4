"""Secret scan: patterns find candidates, a random forest removes false positives. DataFrame operations only.

One pattern cuts a text into stretches and candidates: private key blocks, values
after the name of a password or key, and long runs of key signs. Every candidate gets
features of its length, its character transitions, the share that word parts
cover, path signs around it and the words next to it (48 characters before and 24 after, other
candidates included, so the name of a variable counts however long it is). The forest is fitted on a
bounded, documented sample of labelled findings and evaluated as a SQL
expression inside the row, so a scan reads each text where it lies: no
shuffle, no Python on executors, and memory bounded by a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .secret_findings import AFTER, BEFORE, WORD_PARTS, labelled_findings

#: The bound of the labelled sample, and the forest's form.
FINDINGS, TREES, DEPTH, LEAST_LEAF = 6_000, 16, 6, 8
THRESHOLD = 0.5
MARK = "[SECRET]"
#: Cuts whose sizes are added up in one piece.
CHUNK = 256
_SIGN = "[A-Za-z0-9+/_-]"
_BLOCK_START, _BLOCK_END = (f"-----{x} [A-Z ]{{0,40}}PRIVATE KEY-----" for x in ("BEGIN", "END"))
#: A private key block to its END line, whatever lies between (at most 64 single dashes, which stand in headers);
_BLOCK = f"{_BLOCK_START}[^-]*+(?:-(?!----)[^-]*+){{0,64}}+{_BLOCK_END}|{_BLOCK_START}[A-Za-z0-9+/=\\s]*+"
#: a value of six signs or more after the name of a password or key, whatever its signs up to a space or quote;
_NAME = "(?=[pPsStTaA])(?i:passw(?:or)?d|passphrase|pass|pwd|pw|secret|token|api[_-]?key)[A-Za-z0-9_-]{0,12}"
_ASSIGN = "[\"']?[ ]{0,2}(?:=>|[:=])[ ]{0,2}[\"']?"
_VALUE = "[^\\s\"'<>]{5,}[^\\s\"'<>,;.)\\]}]"
#: or a run of 16 or more signs of keys and encodings.
_RUN = f"(?<!{_SIGN}){_SIGN}{{16,}}+={{0,2}}"
CANDIDATE = f"{_BLOCK}|{_NAME}{_ASSIGN}{_VALUE}|{_RUN}"
#: A gap, which ends behind a name or before another candidate, and what follows. The name may also be the candidate before; names
#: are looked for forwards, and backwards only where a cut begins or a value does.
_GAP = f"(?:(?<={_NAME}){_ASSIGN}|(?<={_NAME}=)[ ]{{0,2}}[\"']?)(?={_VALUE})|.*?(?:{_NAME}{_ASSIGN}(?={_VALUE})|(?={_BLOCK}|{_RUN}|\\z))"
_CUT = f"(?s)({_GAP})({_BLOCK}|(?<={_NAME}{_ASSIGN}){_VALUE}|{_RUN}|\\z)"
_SECRET_WORDS = "(?i)(key|token|secret|pass|pwd|\\bpw|auth|bearer|credential|signing)"
_PLAIN_WORDS = "(?i)(sha-?(1|256|512)|md5|checksum|digest|hash|commit|revision|etag|integrity|uuid|guid|build|blob|tree|example|\\bid\\b)"
_PREFIXES = "^(AKIA|ASIA|gh[opsu]_|glpat-|npm_|[sr]k_live_|sk-|pk-|xox[bpa]-|AIza|eyJ|-----BEGIN)"
_PLACEHOLDER = "(?i)(example|your|change_?me|insert|replace|sample|dummy|(.)\\2{7,})"

_CALL = "^[$]?[{(\\[]|^[A-Za-z_.]+[(\\[]|^[A-Za-z_]+[.][A-Za-z_.]+$"


def features(match: Column, before: Column, after: Column) -> list[tuple[str, Column]]:
    """Name and value of each feature of a finding, all double."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    size = F.length(match).cast("double")
    kinds = F.translate(match, lower + upper + "0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    sounds = F.translate(F.lower(match), lower + "0123456789", "".join("v" if c in "aeiouy" else "c" for c in lower) + "0" * 10)

    def left(pattern: str, of: Column) -> Column:
        """The share of signs that remain without the pattern."""
        return F.length(F.regexp_replace(of, F.lit(pattern), F.lit(""))) / size

    def runs(of: Column) -> Column:
        return F.length(F.regexp_replace(of, F.lit("(.)\\1*"), F.lit("x"))) / size

    def yes(condition: Column) -> Column:
        return condition.cast("double")

    parts = "|".join(sorted(set(WORD_PARTS), key=lambda w: (-len(w), w)))
    return [
        ("size", size),
        ("kind_changes", runs(kinds)),
        ("sound_changes", runs(sounds)),
        ("digits", 1 - left("0", kinds)),
        ("uppers", 1 - left("A", kinds)),
        ("vowels", 1 - left("v", sounds)),
        ("clusters", 1 - left("c{4,}", sounds)),
        ("distinct", F.size(F.array_distinct(F.split(match, ""))) / size),
        ("uncovered", left(parts, F.lower(match))),
        ("hex", yes(match.rlike("^[0-9a-f]+$"))),
        ("prefix", yes(match.rlike(_PREFIXES))),
        ("placeholder", yes(match.rlike(_PLACEHOLDER))),
        ("slashes", 1 - left("/", match)),
        ("joins", 1 - left("[-_]", match)),
        ("others", 1 - left("[^A-Za-z0-9+/_=-]", match)),
        ("code", 1 - left("[(){}\\[\\].$]", match)),
        ("call", yes(match.rlike(_CALL))),
        ("block", yes(match.rlike("^-----BEGIN"))),
        ("assigned_after", yes(after.rlike("^[\"']?[ ]{0,2}[:=]") | match.rlike("^[A-Za-z][A-Za-z0-9_-]*=$"))),
        ("path_before", yes(before.rlike("(://|\\./|/)[^\\s]*$"))),
        ("path_after", yes(after.rlike("^(/|\\.[a-z]{2,4}\\b)"))),
        ("secret_word", yes(before.rlike(_SECRET_WORDS))),
        ("secret_word_near", yes(before.rlike(_SECRET_WORDS + "[A-Za-z0-9_-]*[\"']?( is)?[ :=>]*[\"']?$"))),
        ("plain_word", yes(before.rlike(_PLAIN_WORDS + "[A-Za-z0-9_]*[\"']?[ :=>/]*[\"']?$"))),
        ("assigned", yes(before.rlike("[=:]>?[ ]?[\"']?$"))),
        ("quoted", yes(before.rlike("[\"']$") & after.rlike("^[\"']"))),
    ]


class Forest:
    """Bagged trees on histograms of the features; a leaf holds the share of secrets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        self.names, rng = names, np.random.default_rng(seed)
        seen = [np.unique(np.concatenate(([c.min(), c.max()], np.quantile(c, np.linspace(0.02, 0.98, 40))))) for c in x.T]
        self.cuts = [(c[:-1] + c[1:]) / 2 if len(c) > 1 else c + 1 for c in seen]
        bins = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(self.cuts, x.T)], axis=1)
        self.trees = []
        for _ in range(trees):
            own = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(bins[own], y[own], depth, rng))

    def _grow(self, bins: np.ndarray, y: np.ndarray, depth: int, rng) -> tuple | float:
        share = float(y.mean())
        if depth == 0 or len(y) < 2 * LEAST_LEAF or share in (0.0, 1.0):
            return share
        best = None
        for f in rng.permutation(bins.shape[1])[: max(1, round(bins.shape[1] ** 0.5) + 1)].tolist():
            n = len(self.cuts[f]) + 1
            total, ones = np.bincount(bins[:, f], minlength=n).cumsum(), np.bincount(bins[:, f], y, minlength=n).cumsum()
            a, b = total[:-1], total[-1] - total[:-1]
            fine = (a >= LEAST_LEAF) & (b >= LEAST_LEAF)
            if not fine.any():
                continue
            p, q = ones[:-1] / np.maximum(a, 1), (ones[-1] - ones[:-1]) / np.maximum(b, 1)
            impure = np.where(fine, a * p * (1 - p) + b * q * (1 - q), np.inf)
            at = int(impure.argmin())
            if best is None or impure[at] < best[0]:
                best = (impure[at], f, at)
        if best is None or best[0] >= len(y) * share * (1 - share):
            return share
        _, f, at = best
        low = bins[:, f] <= at
        return f, float(self.cuts[f][at]), self._grow(bins[low], y[low], depth - 1, rng), self._grow(bins[~low], y[~low], depth - 1, rng)

    def sql(self, row: str) -> str:
        """The mean share of secrets, as SQL over the struct `row`."""

        def of(node: tuple | float) -> str:
            if isinstance(node, float):
                return f"{node!r}D"
            f, cut, low, high = node
            return f"CASE WHEN {row}.{self.names[f]} <= {cut!r}D THEN {of(low)} ELSE {of(high)} END"

        return "(" + " + ".join(f"({of(t)})" for t in self.trees) + f") / {len(self.trees)}.0D"


_fitted: dict[tuple[int, int], Forest] = {}


def findings_table(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Labelled findings and their features, as the scan computes them."""
    rows = spark.createDataFrame(labelled_findings(n, seed), "match string, before string, after string, label int").coalesce(1)
    return rows.select("label", F.struct(*[c.alias(k) for k, c in features(F.col("match"), F.col("before"), F.col("after"))]).alias("f"))


def forest(spark: SparkSession, n: int = FINDINGS, seed: int = 11) -> Forest:
    """The forest, fitted once in a program on `n` labelled findings (a documented bound that no table changes)."""
    if (n, seed) not in _fitted:
        rows = findings_table(spark, n, seed).collect()
        names = list(rows[0]["f"].asDict())
        x = np.array([[r["f"][k] for k in names] for r in rows])
        _fitted[n, seed] = Forest(x, np.array([r["label"] for r in rows], float), names)
    return _fitted[n, seed]


def judged(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns of docs in the struct `row`, with `text` and the array `cuts`.

    A cut is (gap, match, start, score, secret): the text is the gaps and matches in order.
    `start` counts characters from 0. A text without candidates has no cuts.
    """
    whole = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("text", whole)
    some = F.col("text").rlike(CANDIDATE)
    none = F.array().cast("array<string>")
    cut = held.withColumns({k: F.when(some, F.regexp_extract_all("text", F.lit(_CUT), F.lit(i))).otherwise(none) for k, i in (("gaps", 1), ("matches", 2))})

    def piece(name: str, i: Column) -> Column:
        return F.coalesce(F.get(F.col(name), i), F.lit(""))

    # what stands around a candidate, its neighbours included: three pieces hold that many characters wherever candidates have 16 signs
    tails = F.zip_with("gaps", "matches", lambda g, m: F.right(F.concat(F.right(g, F.lit(BEFORE)), F.right(m, F.lit(BEFORE))), F.lit(BEFORE)))
    cut = cut.withColumn("tails", tails)
    befores = F.transform("gaps", lambda g, i: F.right(F.concat(piece("tails", i - 3), piece("tails", i - 2), piece("tails", i - 1), F.right(g, F.lit(BEFORE))), F.lit(BEFORE)))
    afters = F.transform("gaps", lambda g, i: F.left(F.concat(F.left(piece("gaps", i + 1), F.lit(AFTER)), F.left(piece("matches", i + 1), F.lit(AFTER)), F.left(piece("gaps", i + 2), F.lit(AFTER))), F.lit(AFTER)))
    around = cut.withColumns({"befores": befores, "afters": afters}).drop("tails")

    def described(match: Column, i: Column) -> Column:
        return F.struct(*[c.alias(k) for k, c in features(match, F.get("befores", i), F.get("afters", i))])

    found = around.withColumn("features", F.transform("matches", lambda m, i: F.when(m != "", described(m, i))))
    scored = found.withColumn("scores", F.expr(f"transform(features, x -> CASE WHEN x IS NULL THEN NULL ELSE {forest(docs.sparkSession).sql('x')} END)"))
    sizes = F.zip_with("gaps", "matches", lambda g, m: F.length(g) + F.length(m))
    scored = scored.withColumn("ends", _running(sizes))
    cuts = F.transform(
        "gaps",
        lambda g, i: F.struct(
            g.alias("gap"), F.get("matches", i).alias("match"),
            (F.get("ends", i) - F.length(F.get("matches", i))).cast("long").alias("start"),
            F.get("scores", i).alias("score"), F.coalesce(F.get("scores", i) >= threshold, F.lit(False)).alias("secret"),
        ),
    )
    return scored.select("row", "text", cuts.alias("cuts"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often lambdas in the body read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(sizes: Column) -> Column:
    """Running sums of an array of ints: within chunks, then over the chunks' totals, as an array grows by copying."""

    def plain(some: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(some, none, lambda done, x: F.array_append(done, x + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))))

    def chunked(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(CHUNK))
        return F.transform(starts, lambda at: plain(F.slice(own, at, F.lit(CHUNK))))

    def joined(chunks: Column) -> Column:
        totals = plain(F.transform(chunks, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0))))
        before = F.concat(F.array(F.lit(0)), F.slice(totals, 1, F.size(totals) - 1))
        return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c, lambda x: x + b)))

    return _let(sizes, lambda own: _let(chunked(own), joined))


def redacted(cuts: Column, text: Column) -> Column:
    """The text with every secret replaced by a mark."""
    pieces = F.transform(cuts, lambda c: F.concat(c["gap"], F.when(c["secret"], F.lit(MARK)).otherwise(c["match"])))
    return F.when(F.exists(cuts, lambda c: c["secret"]), F.array_join(pieces, "")).otherwise(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_candidates, n_secrets, secrets (start, length, score), redacted_sha256 of every row.

    `secrets` lists the spans in characters; the strings themselves are not in the
    result. Null text counts as empty. Ids are only carried: null and repeated
    ones are kept as they are. Very long texts are cut whole, in the memory of their row. An empty table gives an empty result. Other
    columns are not read, whatever their names.

    A filter on the result is best set on a stored table: pushed below, it would work the cuts out twice.
    """
    rows = judged(docs.select(id_col, text_col), text_col, threshold)
    secret = F.filter("cuts", lambda c: c["secret"])
    return rows.select(
        F.col(f"row.{id_col}").alias(id_col),
        F.size(F.filter("cuts", lambda c: c["match"] != "")).cast("long").alias("n_candidates"),
        F.size(secret).cast("long").alias("n_secrets"),
        F.transform(secret, lambda c: F.struct(c["start"].alias("start"), F.length(c["match"]).cast("long").alias("length"), F.round(c["score"], 6).alias("score"))).alias("secrets"),
        F.sha2(redacted(F.col("cuts"), F.col("text")), 256).alias("redacted_sha256"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows of docs with secrets replaced in the text, and `size_col`, where there is one, set to the new length.

    A row without secrets stays as it is, a null or empty text stays so. Every row is judged alone: ids, null and repeated ones, make no difference.
    Very long texts are cut whole, in the memory of their row. The columns come back in their order, whatever their names. An empty table
    stays empty.
    """
    rows = judged(docs, text_col)
    hit = F.exists("cuts", lambda c: c["secret"])
    new = redacted(F.col("cuts"), F.col("text"))
    out = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == text_col:
            old = F.when(hit, new).otherwise(old)
        elif c == size_col:
            old = F.when(hit, F.length(new).cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return rows.select(*out)
