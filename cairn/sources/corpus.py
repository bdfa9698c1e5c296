"""File corpora: a directory tree, or the documents and pages tables seen as files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path_rel string, size long, content binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """(path_rel, size, content) with path ``source/lang/<doc_id>.txt``."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))
    return docs.select(path.alias("path_rel"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


def pages_as_files(pages: DataFrame) -> DataFrame:
    """(path_rel, size, content) with the URL's host and path as the file's path."""
    content = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    path = F.btrim(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"))
    return pages.select(path.alias("path_rel"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


def walk(spark: SparkSession, root: str, slices: int = 64) -> DataFrame:
    """(path_rel, size, reason) of everything under ``root`` that is no folder; ``reason`` says why it is no file to keep, else null.

    Reasons: ``symlink`` (not followed), ``special`` (no regular file), ``unreadable`` (also folders).
    The driver lists the first level; the folders found there are walked in parallel.
    """
    first = [(e.path, e.is_dir(follow_symlinks=False)) for e in os.scandir(root)]
    tops = spark.createDataFrame(first or [("", False)], "path string, folder boolean").repartition(max(1, min(slices, len(first))))

    def look(path: str) -> tuple[str, int, str | None]:
        name = os.path.relpath(path, root).replace(os.sep, "/")
        try:
            if os.path.islink(path):
                return name, 0, "symlink"
            if not os.path.isfile(path):
                return name, 0, "special"
            if not os.access(path, os.R_OK):
                return name, 0, "unreadable"
            return name, os.path.getsize(path), None
        except OSError:
            return name, 0, "unreadable"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, folder in zip(frame["path"], frame["folder"], strict=True):
                if folder:
                    shut: list[str] = []
                    for where, folders, names in os.walk(path, onerror=lambda e: shut.append(e.filename)):  # noqa: B023
                        links = [n for n in folders if os.path.islink(os.path.join(where, n))]
                        rows += [look(os.path.join(where, n)) for n in [*names, *links]]
                    rows += [(os.path.relpath(p, root).replace(os.sep, "/"), 0, "unreadable") for p in shut]
                elif path:
                    rows.append(look(path))
            yield pd.DataFrame(rows, columns=["path_rel", "size", "reason"]).astype({"path_rel": object, "size": "int64", "reason": object})

    return tops.mapInPandas(run, "path_rel string, size long, reason string")


def list_files(spark: SparkSession, root: str, slices: int = 64) -> DataFrame:
    """(path_rel, size) of all regular files under ``root`` that can be read, empty ones too; symbolic links are not followed."""
    return walk(spark, root, slices).filter("reason is null").select("path_rel", "size")


def skipped(spark: SparkSession, root: str) -> DataFrame:
    """(reason, n): what a scan leaves out, and why."""
    return walk(spark, root).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path_rel, size, content) of a tree; contents come from the binary reader, which omits empty files, so the listing adds those."""
    root = os.path.abspath(root)
    read = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(F.regexp_replace(F.col("path"), "^file:/*", "/").alias("path"), "content")
        .select(F.expr(f"substring(path, {len(root) + 2})").alias("path_rel"), "content")
    )
    return list_files(spark, root).join(read, "path_rel", "left").select("path_rel", "size", F.coalesce("content", F.lit(b"")).alias("content"))
