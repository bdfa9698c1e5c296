"""Exact duplicates by a staged funnel; one canonical copy for each content.

Stages: size, first two bytes, last two bytes, eight bytes at the centre, whole content; contents above
a limit chunk by chunk.  A group that is left with one file drops out.  The canonical copy has the
smallest (lower(path_rel), path_rel).

Two forms.  Where contents are a column (:func:`find_duplicates`), reading a row reads its content, so
probes and digests are taken in that one scan; content bytes never cross an exchange.  Where files lie
in a folder (:func:`find_duplicates_on_disk`), each stage reads only the bytes it needs, of only the
files that are left: sizes come from the listing, probes and digests from reads by range.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage, unstage

STAGES = ("size", "first2", "last2", "center8", "digest")
LARGE = 50 << 20  # fixed value: contents above it are compared by chunks of as many bytes


def size_class(size: Column, limit: int = LARGE) -> Column:
    """``small`` up to and with the limit, else ``large``."""
    return F.when(size <= limit, "small").otherwise("large")


def probes(files: DataFrame) -> DataFrame:
    """Size, byte probes as hex and the content's digest in place of the content.

    Files under two bytes show what they have; for files under eight bytes the centre probe is the whole content.
    """
    size = F.col("size")
    cut = lambda pos, n: F.hex(F.expr(f"substring(content, {pos}, {n})"))
    return files.select(
        "path_rel", "size",
        cut("1", "2").alias("first2"),
        F.when(size < 2, F.hex("content")).otherwise(cut("-2", "2")).alias("last2"),
        F.when(size < 8, F.hex("content")).otherwise(cut("cast(size div 2 - 3 as int)", "8")).alias("center8"),
        F.sha2("content", 256).alias("digest"),
    )


def funnel_counts(files: DataFrame) -> DataFrame:
    """(stage, name, candidates, removed): how many non-empty files each stage leaves with a partner.

    The stages' keys extend each other, so the groups of one are summed up from those of the next:
    groups shrink before each exchange, and no group of equal size is sorted in one task.
    """
    level = probes(files.filter("size > 0")).groupBy(*STAGES).agg(F.count("*").alias("n"))
    total = level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("left"))
    found = []
    for i in range(len(STAGES), 0, -1):
        level = level.groupBy(*STAGES[:i]).agg(F.sum("n").alias("n"))
        left = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("left")
        found.append(level.agg(left).select(F.lit(i).alias("stage"), F.lit(STAGES[i - 1]).alias("name"), "left"))
    rows = reduce(DataFrame.union, [total.select(F.lit(0).alias("stage"), F.lit("").alias("name"), "left"), *found])
    before = rows.select((F.col("stage") + 1).alias("stage"), F.col("left").alias("before"))  # six rows
    return rows.join(before, "stage").select("stage", "name", F.col("left").alias("candidates"), (F.col("before") - F.col("left")).alias("removed"))


def _elected(keyed: DataFrame) -> DataFrame:
    """(path_rel, size, digest) to the catalog; a null digest is never a duplicate.

    A content held by a large share of all files is one group, so the canonical path comes from an
    aggregation with partial sums and is joined back, rather than from sorting the group.
    """
    order = F.struct(F.lower("path_rel").alias("low"), F.col("path_rel").alias("path"))
    first = keyed.filter("digest is not null").groupBy("size", "digest").agg(F.min(order).alias("m"), F.count("*").alias("n"))
    originals = first.filter("n > 1").select("size", "digest", F.col("m.path").alias("original"))
    return keyed.join(originals, ["size", "digest"], "left").select(
        "path_rel", "size",
        F.coalesce(F.col("original") != F.col("path_rel"), F.lit(False)).alias("is_duplicate"),
        F.when(F.col("original") != F.col("path_rel"), F.col("original")).alias("original_path"),
    )


def find_duplicates(files: DataFrame, chunk: int | None = None) -> DataFrame:
    """(path_rel, size, is_duplicate, original_path) of every file of (path_rel, size, content).

    Empty files and those whose content is null (it couldn't be read) are never duplicates.  With
    ``chunk``, the digest is that of the contents' chunk digests.
    """
    if chunk is None:
        keyed = files.select("path_rel", "size", F.when(F.col("size") > 0, F.sha2("content", 256)).alias("digest"))
    else:
        whole = F.sha2(F.array_join("digests", "").cast("binary"), 256)
        keyed = chunk_digests(files, chunk).select("path_rel", "size", F.when((F.col("size") > 0) & F.forall("digests", lambda x: x.isNotNull()), whole).alias("digest"))
    return _elected(keyed)


def duplicate_summary(catalog: DataFrame) -> DataFrame:
    """(files, total_bytes, duplicates, saved_bytes, saved_percent)."""
    total, saved = F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("is_duplicate"), F.col("size"))), F.lit(0))
    return catalog.agg(F.count("*").alias("files"), total.alias("total_bytes"), F.count_if("is_duplicate").alias("duplicates"), saved.alias("saved_bytes")).withColumn(
        "saved_percent", F.when(F.col("total_bytes") > 0, F.col("saved_bytes") * 100.0 / F.col("total_bytes")).otherwise(F.lit(0.0))
    )


def chunk_digests(files: DataFrame, chunk: int = LARGE) -> DataFrame:
    """(path_rel, size, digests): a digest for each ``chunk`` bytes, so that large files agree when the arrays do."""
    n = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("int")
    cut = lambda i: F.sha2(F.substring(F.col("content"), i * chunk + 1, F.lit(chunk)), 256)
    return files.select("path_rel", "size", F.transform(F.sequence(F.lit(0), n - 1), cut).alias("digests"))


def chunk_rounds(files: DataFrame, chunk: int = LARGE) -> DataFrame:
    """(round, candidates, remaining): files with a chunk of that number whose group (equal size and chunks before) has more than one,
    and those of them that still have a partner after it."""
    pieces = chunk_digests(files.filter("size > 0"), chunk).select("size", F.posexplode("digests").alias("round", "x"), "digests")
    prefix = lambda n: F.sha2(F.array_join(F.slice("digests", 1, n), "").cast("binary"), 256)
    keyed = pieces.select("size", "round", prefix(F.col("round")).alias("before"), prefix(F.col("round") + 1).alias("after"))
    fine = keyed.groupBy("size", "round", "before", "after").agg(F.count("*").alias("n"))
    coarse = fine.groupBy("size", "round", "before").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("left"))
    some = coarse.filter("n > 1").groupBy("round").agg(F.sum("n").alias("candidates"), F.coalesce(F.sum("left"), F.lit(0)).alias("remaining"))
    return some.select((F.col("round") + 1).alias("round"), "candidates", "remaining")


def _reads(rows: DataFrame, root: str, read: Callable, schema: str) -> DataFrame:
    """``read(file, size, row)`` for every row of (path_rel, size, ...): its results, or nulls where the file can't be read.

    ``schema`` names path_rel, size and then the results.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    with open(os.path.join(root, row["path_rel"]), "rb") as f:
                        found = read(f, int(row["size"]), row)
                except OSError:
                    found = dict.fromkeys(names[2:])
                out.append(row | found)
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def _with_partner(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once; nulls have no partner."""
    often = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(often, keys, "left_semi").select(*rows.columns)


def _probe(f, size: int, row: dict) -> dict:
    def cut(at: int, n: int) -> str:
        f.seek(max(0, at))
        return f.read(n).hex()

    return {"first2": cut(0, 2), "last2": cut(size - 2, 2), "center8": cut(size // 2 - 4 if size >= 8 else 0, 8)}


def _digest(f, size: int, row: dict) -> dict:
    h = hashlib.sha256()
    while part := f.read(1 << 20):
        h.update(part)
    return {"digest": h.hexdigest()}


def find_duplicates_on_disk(listing: DataFrame, root: str, large: int = LARGE) -> DataFrame:
    """The catalog of (path_rel, size) below ``root``, a folder that all executors see.

    No file is held whole, so sizes have no limit.  Files above ``large`` bytes are compared chunk by
    chunk: a round reads the next chunk of those that still have a partner, and ends with them.
    """
    files = stage(listing.select("path_rel", "size"), "listing")
    probed = "path_rel string, size long, first2 string, last2 string, center8 string"
    left = stage(_reads(_with_partner(files.filter("size > 0"), ["size"]), root, _probe, probed), "probes")
    kept = _with_partner(left, ["size", "first2", "last2", "center8"]).select("path_rel", "size")
    small = _reads(kept.filter(F.col("size") <= large), root, _digest, "path_rel string, size long, digest string")
    done = [stage(small, "digests")]
    rest, number = stage(kept.filter(F.col("size") > large).withColumn("digest", F.lit("")), "chunks"), 0
    while rest.take(1):

        def next_chunk(f, size: int, row: dict, at: int = number * large) -> dict:
            f.seek(at)
            return {"digest": hashlib.sha256((row["digest"] + hashlib.sha256(f.read(large)).hexdigest()).encode()).hexdigest()}

        number += 1
        read = stage(_reads(rest, root, next_chunk, "path_rel string, size long, digest string"), "chunks")
        unstage(rest)
        agreed = _with_partner(read, ["size", "digest"])
        done.append(stage(agreed.filter(F.col("size") <= number * large), "digests"))
        rest = stage(agreed.filter(F.col("size") > number * large), "chunks")
        unstage(read)
    unstage(left)
    digests = reduce(DataFrame.union, done).select("path_rel", "digest")
    return _elected(files.join(digests, "path_rel", "left").select("path_rel", "size", "digest"))
