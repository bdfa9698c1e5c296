"""Read-side queries over a catalog of files, frames and security descriptors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import fmt, paths


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns; those that an older catalog lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def with_parent(files: DataFrame) -> DataFrame:
    return files.withColumn("parent_path", paths.parent_path(F.col("path_rel")))


DETAILS = ("compressed_size", "volume_name", "frame_id", "sddl", "attrs", "mtime")


def list_dir(files: DataFrame, folder: str = "", hide_duplicates: bool = False) -> DataFrame:
    """(name, is_folder, size) of a folder's direct children, folders first, then by lower-case name; with those of DETAILS that ``files`` has."""
    folder = folder.strip("/")
    prefix = f"{folder}/" if folder else ""
    more = [c for c in DETAILS if c in files.columns]
    inside = files.filter(F.col("path_rel").startswith(prefix)) if prefix else files
    rest = inside.filter("not is_duplicate") if hide_duplicates else inside
    tail = F.substring("path_rel", len(prefix) + 1, 1 << 30)
    here = rest.filter(F.instr(tail, "/") == 0).select(tail.alias("name"), F.lit(False).alias("is_folder"), "size", *more)
    below = inside.filter(F.instr(tail, "/") > 0).select(F.substring_index(tail, "/", 1).alias("name")).distinct()
    nothing = [F.lit(None).cast(here.schema[c].dataType).alias(c) for c in ("size", *more)]
    return below.select("name", F.lit(True).alias("is_folder"), *nothing).unionByName(here).orderBy(F.desc("is_folder"), F.lower("name"), "name")


def entries(files: DataFrame, offsets: DataFrame, frames: DataFrame, frame_size: int, base: str = "archive") -> DataFrame:
    """Catalog rows with where they lie: ``start``, ``frame_id`` and ``volume_name`` of the content's first byte, ``compressed_size``.

    A duplicate lies where its original does and takes no room of its own; an empty file lies nowhere.
    A file's part of a frame's packed size goes by its bytes in the frame.
    """
    from .layout import slices, start_frames

    frames = frames.select("frame_id", "volume_no", "size", "original_size")
    share = F.col("length") * F.col("size") / F.col("original_size")
    packed = slices(offsets, frame_size).join(frames, "frame_id").groupBy("path_rel").agg(F.round(F.sum(share)).cast("long").alias("compressed_size"))
    first = start_frames(offsets, frame_size).select("path_rel", "start", F.col("start_frame").alias("frame_id"))
    placed = first.join(frames.select("frame_id", paths.volume_name(base, F.col("volume_no")).alias("volume_name")), "frame_id", "left").join(packed, "path_rel", "left")
    placed = placed.withColumnRenamed("path_rel", "source")
    joined = files.withColumn("source", F.coalesce("original_path", "path_rel")).join(placed, "source", "left")
    room = F.when(F.col("is_duplicate"), F.lit(0).cast("long")).otherwise(F.coalesce("compressed_size", F.lit(0).cast("long")))
    return joined.select(*files.columns, "start", "frame_id", "volume_name", room.alias("compressed_size"))


def with_frame_map(files: DataFrame, frame_map: DataFrame) -> DataFrame:
    """Rows of a catalog without frame numbers (``sframe_id`` null) get theirs from the computed map (path_rel, start_frame)."""
    own = frame_map.select("path_rel", F.col("start_frame").alias("_mapped"))
    return files.join(own, "path_rel", "left").withColumn("sframe_id", F.coalesce("sframe_id", "_mapped")).drop("_mapped")


def existing(acls: DataFrame, listing: DataFrame) -> DataFrame:
    """Access-list rows (p) whose target is in the listing (path_rel), or a folder above one that is."""
    there = listing.select(F.explode(F.array_append(paths.ancestors(F.col("path_rel")), F.col("path_rel"))).alias("p")).distinct()
    return acls.join(there, "p", "left_semi")


def by_id(files: DataFrame) -> DataFrame:
    """Rows in order of their surrogate id."""
    return files.orderBy("id")


def select_add(selection: DataFrame, more: DataFrame) -> DataFrame:
    """Selected paths and more, each once."""
    return selection.select("path_rel").union(more.select("path_rel")).distinct()


def select_discard(selection: DataFrame, less: DataFrame) -> DataFrame:
    return selection.select("path_rel").distinct().join(less.select("path_rel").distinct(), "path_rel", "left_anti")


def select_clear(selection: DataFrame) -> DataFrame:
    return selection.select("path_rel").limit(0)


def search(files: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` paths that match, in path order."""
    return files.filter(fmt.like_any_case(F.col("path_rel"), pattern)).orderBy("path_rel").limit(limit)


def get_file(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path_rel") == path.replace("\\", "/")).limit(1)


def files_in_folder(files: DataFrame, folder: str) -> DataFrame:
    """All files below a folder, by path; the root holds all."""
    folder = folder.strip("/")
    return (files.filter(F.col("path_rel").startswith(f"{folder}/")) if folder else files).orderBy("path_rel")


def with_duplicate_counts(files: DataFrame) -> DataFrame:
    """Adds ``duplicate_count`` and ``has_duplicates``: how many files name this one as their original."""
    counts = files.filter("is_duplicate and original_path is not null").groupBy(F.col("original_path").alias("path_rel")).agg(F.count("*").alias("n"))
    counted = files.join(counts, "path_rel", "left").withColumn("duplicate_count", F.coalesce("n", F.lit(0).cast("long")))
    return counted.withColumn("has_duplicates", F.col("duplicate_count") > 0).drop("n")


def with_originals(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duplicates joined to their originals, and duplicates whose original is missing."""
    d = files.filter("is_duplicate").select("path_rel", "original_path")
    o = files.filter("not is_duplicate").select(F.col("path_rel").alias("original_path"), F.col("size").alias("original_size"))
    return d.join(o, "original_path").select("path_rel", "original_path", "original_size"), d.join(o, "original_path", "left_anti").select("path_rel", "original_path")


def resolve_originals(files: DataFrame) -> DataFrame:
    """(path_rel, resolved) of duplicates: their original's path as named, else below the duplicate's own root folder, else null."""
    d = files.filter("is_duplicate").select("path_rel", "original_path")
    d = d.withColumn("below", F.concat_ws("/", F.nullif(paths.root_prefix(F.col("path_rel"), F.col("original_path")), F.lit("")), "original_path"))
    o = files.filter("not is_duplicate").select("path_rel")
    named = o.select(F.col("path_rel").alias("original_path"), F.col("path_rel").alias("_named"))
    rooted = o.select(F.col("path_rel").alias("below"), F.col("path_rel").alias("_rooted"))
    return d.join(named, "original_path", "left").join(rooted, "below", "left").select("path_rel", F.coalesce("_named", "_rooted").alias("resolved"))


def dictionary(files: DataFrame, column: str) -> DataFrame:
    """(id, value): distinct values numbered by first appearance in path order."""
    first = files.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(F.lower("path_rel"), "path_rel")).alias("f"))
    return first.select(F.row_number().over(Window.orderBy("f")).alias("id"), "value")  # few values


def surrogate_ids(files: DataFrame) -> DataFrame:
    """``id`` from 1 in canonical order."""
    from .layout import canonical_order, running_before

    return running_before(files.withColumn("_one", F.lit(1).cast("long")), "_one", canonical_order(), "_n").withColumn("id", F.col("_n") + 1).drop("_one", "_n")


def expand_selection(files: DataFrame, selected: list[str], folders: list[str]) -> DataFrame:
    """Selected files and all files of selected folders, each once."""
    parts = [files.filter(F.col("path_rel").isin(selected))] + [files.filter(F.col("path_rel").startswith(f"{f.strip('/')}/") if f.strip("/") else F.lit(True)) for f in folders]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["path_rel"])


def read_selection(lines: DataFrame) -> DataFrame:
    """Path lists, one a line: trimmed, blank lines dropped, anchors and backslashes removed."""
    path = paths.normalize_separators(paths.strip_anchor(F.trim("value")))
    return lines.select(path.alias("path_rel")).filter("path_rel <> ''").distinct()
