"""Model calls on executors: embedding images, and asking a vision model for a composition score.

Models are passed in as factories that run once in each task, so nothing heavy is
pickled. Both calls are whole-partition iterators over Arrow batches.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scores import ANSWER_DEFAULT, parse
from .functions.vectors import normalize
from .operators.keyed import misses
from .sources.cache import append_cache, read_cache
from .sources.pixels import rgb, to_send
from .sources.shared import stored

#: A model that embeds a batch of images.
Embedder = Callable[[Sequence[bytes]], Sequence[Sequence[float]]]
#: A model that answers about one image.
Analyzer = Callable[[bytes], str]
EMBED_FAILED = "Failed to embed"


def device() -> str:
    """Where a task's model should run: the accelerator that Spark gave the task (resource `gpu`), else the processor."""
    from pyspark import TaskContext

    task = TaskContext.get()
    found = task.resources().get("gpu") if task else None
    return f"cuda:{found.addresses[0]}" if found else "cpu"


def in_batches(model: Embedder, images: Sequence[bytes], size: int) -> list[Sequence[float] | None]:
    """Embeds in slices of `size`; None for an image that the model refuses.

    Out of memory halves the slice and tries again, down to one, where it is raised; the size recovers after a success.
    Any other exception of a slice tries its images one by one, so a broken one costs nothing else.
    """
    out: list[Sequence[float] | None] = []
    now = size
    while len(out) < len(images):
        some = images[len(out) : len(out) + now]
        try:
            out += list(model(some))
            now = size
        except MemoryError:
            if now == 1:
                raise
            now = max(1, now // 2)
        except Exception:  # noqa: BLE001 - a broken image is a row, not a failed task
            for image in some:
                try:
                    out += list(model([image]))
                except MemoryError:
                    raise
                except Exception:  # noqa: BLE001
                    out.append(None)
    return out


def embed(images: DataFrame, make: Callable[[], Embedder], batch_size: int = 16) -> DataFrame:
    """content_hash, unit-length embedding and error of images (content_hash, content); a failed image has no embedding."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in frames:
            if not len(pdf):
                continue
            model = model or make()  # loaded only where there is something to embed
            found = in_batches(model, list(pdf["content"]), batch_size)
            yield pdf[["content_hash"]].assign(embedding=[None if v is None else list(map(float, v)) for v in found], error=[EMBED_FAILED if v is None else None for v in found])

    raw = images.select("content_hash", "content").mapInPandas(run, "content_hash string, embedding array<float>, error string")
    return raw.select("content_hash", normalize(F.col("embedding")).cast("array<float>").alias("embedding"), "error")


def embed_with_cache(images: DataFrame, make: Callable[[], Embedder], cache: str, batch_size: int = 16) -> DataFrame:
    """path, embedding and error of images (path, content_hash, content): cached ones are looked up, others embedded and added to the cache.

    Images that fail are not cached; they have an error and no embedding. Equal contents are embedded once.
    """
    spark = images.sparkSession
    todo = misses(images.where("content IS NOT NULL"), read_cache(spark, cache), "content_hash").dropDuplicates(["content_hash"])
    new = stored(embed(todo, make, batch_size), "embedded")
    append_cache(new.where("error IS NULL"), cache)
    known = read_cache(spark, cache).select("content_hash", "embedding")
    found = images.select("path", "content_hash").join(known, "content_hash", "left")
    return found.select("path", "embedding", F.when(F.col("embedding").isNull(), F.lit(EMBED_FAILED)).alias("error"))


def server_has_model(base_url: str, model: str, timeout: float = 5.0) -> bool:
    """Whether the local model server lists a model whose name holds the base name."""
    try:
        with urllib.request.urlopen(f"{base_url.rstrip('/')}/api/tags", timeout=timeout) as r:
            names = [m.get("name", "") for m in json.load(r).get("models", [])]
    except (OSError, ValueError):
        return False
    return any(base_name(model) in n for n in names)


def base_name(model: str) -> str:
    """What comes before the colon in a model's name."""
    return model.partition(":")[0]


def preview(answer: str | None) -> str:
    """The part of an answer that a message quotes."""
    return (answer or "")[:100]


def http_analyzer(base_url: str, model: str, prompt: str, timeout: float = 60.0) -> Callable[[], Analyzer]:
    """A factory of analyzers that post an image, in base64, to the local model server."""

    def make() -> Analyzer:
        def ask(image: bytes) -> str:
            body = json.dumps({"model": model, "prompt": prompt, "images": [image.decode()], "stream": False}).encode()
            request = urllib.request.Request(f"{base_url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r).get("response", "")

        return ask

    return make


def encoded(images: DataFrame) -> DataFrame:
    """path and content (base64 of the shrunk image, null where it could not be loaded) of images as `load_images` gives them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [None if pd.isna(w) else to_send(rgb(data, int(w), int(h), int(c))).encode() for w, h, c, data in zip(pdf["width"], pdf["height"], pdf["channels"], pdf["data"])]
            yield pdf[["path"]].assign(content=made)

    return images.select("path", "width", "height", "channels", "data").mapInPandas(run, "path string, content binary")


def analyze(images: DataFrame, make: Callable[[], Analyzer] | None, concurrency: int = 8, delay: float = 0.5) -> DataFrame:
    """path and composition score of images (path, content): the answer's first number in range, the default on any failure.

    `concurrency` partitions call at the same time, each waiting `delay` between its
    calls. Without a model every image gets the default. Rows without content wait for nothing.
    """
    if make is None:
        return images.select("path", F.lit(ANSWER_DEFAULT).alias("score"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, asked = None, False
        for pdf in frames:
            answers = []
            ask = ask or make()
            for image in pdf["content"]:
                answer = None
                if image is not None:
                    if asked and delay:
                        time.sleep(delay)
                    asked = True
                    try:
                        answer = ask(image)
                    except (OSError, ValueError, urllib.error.URLError):
                        answer = None
                answers.append(answer)
            yield pdf[["path"]].assign(answer=answers)

    found = images.select("path", "content").repartition(concurrency, "path").mapInPandas(run, "path string, answer string")
    return found.select("path", parse(F.col("answer")).alias("score"))
