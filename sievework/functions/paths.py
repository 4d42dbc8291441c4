"""Path functions. Paths sort by their components, not as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".heif")


def parts(path: Column) -> Column:
    """The components: the order of these arrays is the order of paths."""
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """The last extension in lower case, with its dot; empty for none and for a dot-file."""
    return F.lower(F.regexp_extract(path, "[^/]([.][^./]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def relative(path: Column, root: Column) -> Column:
    return F.when(path == root, F.lit("(root)")).otherwise(F.substr(path, F.length(root) + 2))


def hidden(path: Column) -> Column:
    return F.exists(parts(path), lambda x: x.startswith("."))


def ancestors(path: Column) -> Column:
    """All folders above a path, from the shortest; none for a bare name."""
    p = parts(path)
    # a sequence from 1 to 0 would count down
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def host(url: Column) -> Column:
    return F.split_part(url, F.lit("/"), F.lit(3))


def base_url(url: Column) -> Column:
    """An address without slashes at its end."""
    return F.rtrim(url, F.lit("/"))


def content_hash(content: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of the bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


def shard_prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 2)


def rank_name(rank: Column, width: Column, name: Column) -> Column:
    return F.concat(F.lpad(rank.cast("string"), width, F.lit("0")), F.lit("_"), name)
