"""Command line: cull one folder of images, or all folders below it with a quota each.

    python -m sievework.cli cull IMAGES OUT --embedder MODULE:FACTORY [options]
    python -m sievework.cli batch IMAGES OUT --embedder MODULE:FACTORY [options]

IMAGES is a folder that all executors see. An embedder is a factory without arguments whose result embeds a list of image files
(bytes); `--embeddings` takes a table of `path` and `embedding` instead. `--weights` is a JSON file with `weights` and `bias` of the
linear aesthetic score, or the `layers` of a linear network. `--use-llm` asks a vision model about the best candidates: the local
model server, or what `--analyzer MODULE:FACTORY` makes.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import infer
from .config import CullConfig
from .operators.folders import outcomes
from .plans.run import BatchRun, CullRun, Models, NoImages, read_weights

PROMPT = "Judge how well this photograph is composed: framing, balance, light, and what draws the eye. Answer with one number from 1 (poor) to 10 (excellent) and nothing else."


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("cull", "batch"):
        q = sub.add_parser(name)
        q.add_argument("images")
        q.add_argument("output")
        q.add_argument("--embedder", help="MODULE:FACTORY of the model that embeds images")
        q.add_argument("--embeddings", help="table of path and embedding, instead of an embedder")
        q.add_argument("--weights", help="JSON of the linear aesthetic score")
        q.add_argument("--threshold", type=float, default=CullConfig.similarity_threshold, help="cosine similarity of duplicates")
        q.add_argument("--batch-size", type=int, default=CullConfig.batch_size, help="images that the embedder gets at once")
        q.add_argument("--cache-dir", help="folder of the embedding cache and of unfinished phases (default: IMAGES/.cache)")
        q.add_argument("--representative", choices=("first", "best"), default=CullConfig.representative, help="which image stands for its duplicates")
        q.add_argument("--use-llm", action="store_true", help="ask a vision model about the best candidates")
        q.add_argument("--llm-candidates", type=int, default=CullConfig.llm_candidates)
        q.add_argument("--llm-url", default="http://localhost:11434")
        q.add_argument("--llm-model", default="llava:13b")
        q.add_argument("--analyzer", help="MODULE:FACTORY of a model that answers about an image, instead of the server")
        q.add_argument("--resume", action="store_true", help="go on after the last finished phase")
        q.add_argument("--verbose", "-v", action="store_true", help="tell the rows of each phase")
    one, many = sub.choices["cull"], sub.choices["batch"]
    one.add_argument("--target", type=int, default=CullConfig.target)
    one.add_argument("--analyze-only", action="store_true", help="write the report and copy nothing")
    many.add_argument("--ratio", type=float, default=CullConfig.ratio)
    many.add_argument("--min", type=int, default=CullConfig.least, dest="least")
    many.add_argument("--max", type=int, default=CullConfig.most, dest="most")
    many.add_argument("--scope", choices=("recursive", "direct"), default=CullConfig.scope, help="whether a folder chooses among the images below it, too")
    many.add_argument("--flat", action="store_true", help="copy into one folder")
    many.add_argument("--dry-run", action="store_true", help="print the plan and stop")
    return p


def validate(args: argparse.Namespace) -> None:
    if not os.path.exists(args.images):
        raise ValueError(f"{args.images} does not exist")
    if not os.path.isdir(args.images):
        raise ValueError(f"{args.images} is not a folder")
    if getattr(args, "target", 1) < 1:
        raise ValueError("--target must be at least 1")
    if not args.embedder and not args.embeddings:
        raise ValueError("--embedder or --embeddings is needed")


def named(where: str) -> Callable:
    """The factory that MODULE:NAME names."""
    module, _, name = where.partition(":")
    return getattr(importlib.import_module(module), name)


def _models(args: argparse.Namespace) -> Models:
    analyzer, name = None, f"{args.embedder}"
    if args.use_llm:
        if args.analyzer:
            analyzer = named(args.analyzer)
        elif infer.server_has_model(args.llm_url, args.llm_model):
            analyzer = infer.http_analyzer(args.llm_url, args.llm_model, PROMPT, CullConfig.request_timeout)
        else:
            print("The model server has no such model; candidates get the default score.", file=sys.stderr)
        name += f" {args.analyzer or args.llm_model}"
    return Models(named(args.embedder) if args.embedder else None, analyzer, read_weights(args.weights) if args.weights else None, name)


def _tell(args: argparse.Namespace) -> Callable[[str, int], None] | None:
    return (lambda phase, rows: print(f"{phase}: {rows}", file=sys.stderr, flush=True)) if args.verbose else None


def _run(kind: type, spark: SparkSession, args: argparse.Namespace, config: CullConfig):
    cache = f"file://{os.path.abspath(args.cache_dir)}" if args.cache_dir else None
    return kind(spark, args.images, args.output, config, _models(args), cache, args.embeddings, args.resume, _tell(args))


def run_cull(spark: SparkSession, args: argparse.Namespace) -> int:
    config = CullConfig(similarity_threshold=args.threshold, target=args.target, llm_candidates=args.llm_candidates, batch_size=args.batch_size, representative=args.representative)
    return 1 if _run(CullRun, spark, args, config).run(args.use_llm, args.analyze_only) else 0


def run_batch(spark: SparkSession, args: argparse.Namespace) -> int:
    config = CullConfig(
        similarity_threshold=args.threshold, ratio=args.ratio, least=args.least, most=args.most, llm_candidates=args.llm_candidates,
        batch_size=args.batch_size, representative=args.representative, scope=args.scope,
    )
    run = _run(BatchRun, spark, args, config)
    print(f"{'Folder':<50} {'Images':>8} {'Target':>8}")
    for row in run.printed().toLocalIterator():  # a partition at a time: there may be many folders
        print(f"{row.rel_path:<50} {row.n:>8} {row.target:>8}")
    if args.dry_run:
        return 0
    result = run.run(args.use_llm, args.flat)
    counts = outcomes(result).first()
    print(f"{counts.ok} of {counts.ok + counts.failed} folders are done: {run.output}")
    for row in result.where(~F.col("success")).toLocalIterator():
        print(f"failed: {row.rel_path}", file=sys.stderr)
    broken = run.failures().count()
    if broken:
        print(f"{broken} images could not be read or embedded", file=sys.stderr)
    if not counts.failed:
        run.phases.delete()
    return 1 if counts.failed else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        validate(args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("sievework").getOrCreate()
    try:
        return run_cull(spark, args) if args.command == "cull" else run_batch(spark, args)
    except NoImages as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        print("Interrupted; --resume goes on after the last finished phase.", file=sys.stderr)
        return 130


if __name__ == "__main__":
    sys.exit(main())
