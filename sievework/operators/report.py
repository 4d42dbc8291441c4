"""The report table, its CSV file, and ranked copies."""

from __future__ import annotations

import csv
import os
import shutil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename
from ..functions.scores import blank_if_none, two_decimals, yes_no
from .ranking import collisions

COLUMNS = ("rank", "filename", "path", "aesthetic_score", "composition_score", "final_score", "cluster_id", "selected")


def report(scored: DataFrame, *before: str) -> DataFrame:
    """The eight columns as text, behind the columns `before`; scored has path, the three scores, cluster_id, selected and rank."""
    text = {
        "rank": F.coalesce(F.col("rank").cast("string"), F.lit("")),
        "filename": basename(F.col("path")),
        "path": F.col("path"),
        "aesthetic_score": two_decimals(F.col("aesthetic_score")),
        "composition_score": blank_if_none(F.col("composition_score")),
        "final_score": two_decimals(F.col("final_score")),
        "cluster_id": F.coalesce(F.col("cluster_id").cast("string"), F.lit("")),
        "selected": yes_no(F.col("selected")),
    }
    return scored.select(*before, *[c.alias(k) for k, c in text.items()])


def write_report_folder(scored: DataFrame, path: str, order: list, header: bool = True) -> None:
    """The report as CSV part files in order, written by the executors; line ends and quotes as the csv module writes them."""
    report(scored.orderBy(*order)).write.mode("overwrite").option("header", header).option("emptyValue", "").option("nullValue", "").option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_report_file(scored: DataFrame, path: str, order: list) -> None:
    """The report as one file in a folder that all share: executors write its parts beside it, whose bytes are then joined without being read as rows."""
    parts = f"{path}.parts"
    write_report_folder(scored, f"file://{parts}", order, header=False)
    with open(f"{path}.tmp", "wb") as out:
        out.write((",".join(COLUMNS) + "\r\n").encode())
        for name in sorted(n for n in os.listdir(parts) if n.startswith("part-")):
            with open(os.path.join(parts, name), "rb") as part:
                shutil.copyfileobj(part, out)
    os.replace(f"{path}.tmp", path)
    shutil.rmtree(parts)


def write_folder_reports(scored: DataFrame, folder: str, place: str, output: str, order: list) -> DataFrame:
    """One report.csv for each folder in output/place, written by the executors row by row; returns folder and error.

    A folder's rows come to one task in order and are written as they come, under another name first; nothing holds a folder.
    """
    keys = {f"__order{i}": c for i, c in enumerate(order)}
    held = scored.withColumns(keys).repartition(folder).sortWithinPartitions(folder, *keys.values())
    text = report(held, folder, place)
    kind = text.schema[folder].dataType.simpleString()

    def write(frames):
        done: list[tuple] = []
        now, out, target, error = None, None, None, None

        def close():
            nonlocal out, error
            if out is not None:
                out.close()
                try:
                    os.replace(f"{target}.{os.getpid()}.tmp", target)
                except OSError as e:
                    error = str(e)
            if now is not None:
                done.append((now[0], error))
            out = None

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                if now is None or row[0] != now[0]:
                    close()
                    now, error = (row[0],), None
                    target = os.path.join(output, row[1], "report.csv")
                    try:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        out = open(f"{target}.{os.getpid()}.tmp", "w", newline="", encoding="utf-8")  # noqa: SIM115 - closed with its folder
                        csv.writer(out).writerow(COLUMNS)
                    except OSError as e:
                        error = str(e)
                if out is not None:
                    csv.writer(out).writerow(row[2:])
        close()
        yield pd.DataFrame(done, columns=[folder, "error"])

    return text.mapInPandas(write, f"`{folder}` {kind}, error string")


def copy_ranked(named: DataFrame, folder: str, dry_run: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Copies each `path` to folder/output_name on the executors; returns the columns `keep`, path, target and error.

    Names that collide raise before anything is copied. A copy goes to a temporary
    name first and is then renamed, so a task that runs twice does no harm; times are
    kept. `folder` must be one that the executors share.
    """
    if collisions(named, F.col("output_name")).limit(1).count():
        raise ValueError("two images would be copied to the same name")
    keep = keep or []

    def copy(frames):
        for pdf in frames:
            targets, errors = [], []
            for path, name in zip(pdf["path"], pdf["output_name"]):
                target, error = os.path.join(folder, name), None
                try:
                    if not dry_run:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        shutil.copy2(path.removeprefix("file:"), f"{target}.{os.getpid()}.tmp")
                        os.replace(f"{target}.{os.getpid()}.tmp", target)
                except OSError as e:
                    error = str(e)
                targets.append(target)
                errors.append(error)
            yield pdf[[*keep, "path"]].assign(target=targets, error=errors)

    kinds = "".join(f"`{c}` {named.schema[c].dataType.simpleString()}, " for c in keep)
    return named.select(*keep, "path", "output_name").mapInPandas(copy, f"{kinds}path string, target string, error string")
