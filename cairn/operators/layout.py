"""Offsets, frames, slices and volumes of the unique bytes of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import stage

BEFORE = (Window.unboundedPreceding, -1)


def canonical_order() -> list[Column]:
    return [F.lower("path_rel"), F.col("path_rel")]


def running_before(df: DataFrame, value: str, order: list[Column], name: str) -> DataFrame:
    """Exclusive running sum in a total order, without a window over all rows in one task.

    Rows are dealt by ranges of the whole order, as many as a shuffle has partitions, and staged with
    their range's number, so they are computed once; each range has its own window, and the ranges'
    totals, one row each, are summed up and added.
    """
    dealt = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("t"))
    base = totals.select("_range", F.coalesce(F.sum("t").over(Window.orderBy("_range").rowsBetween(*BEFORE)), F.lit(0)).alias("_base"))
    local = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(*BEFORE)), F.lit(0))
    return dealt.withColumn("_local", local).join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_local")).drop("_range", "_base", "_local")


def file_offsets(catalog: DataFrame) -> DataFrame:
    """(path_rel, size, start) of the unique files, empty ones too, in canonical order."""
    return running_before(catalog.filter("not is_duplicate").select("path_rel", "size"), "size", canonical_order(), "start")


def start_frames(offsets: DataFrame, frame_size: int) -> DataFrame:
    """Adds ``start_frame`` and ``end_frame``; null for empty files."""
    frame = lambda place: F.when(F.col("size") > 0, F.floor(place / frame_size))
    last = F.col("start") + F.col("size") - 1
    return offsets.withColumn("start_frame", frame(F.col("start"))).withColumn("end_frame", frame(last))


def frames(offsets: DataFrame, frame_size: int) -> DataFrame:
    """(frame_id, frame_start, frame_end, original_size): fixed-size frames over all bytes, the last may be short."""
    total = offsets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ids = offsets.sparkSession.range(-(-total // frame_size)).withColumnRenamed("id", "frame_id")  # dealt over tasks, however many
    start = F.col("frame_id") * frame_size
    end = F.least(start + frame_size, F.lit(total))
    return ids.select("frame_id", start.alias("frame_start"), end.alias("frame_end"), (end - start).alias("original_size"))


def slices(offsets: DataFrame, frame_size: int) -> DataFrame:
    """(path_rel, frame_id, in_file, in_frame, length): the interval-overlap join of files and frames.

    All frames but the last are full, so a file's frames are known from its offsets: an explode in
    place of a join on inequalities.  Empty files overlap no frame.
    """
    hit = start_frames(offsets, frame_size).filter("size > 0").withColumn("frame_id", F.explode(F.sequence("start_frame", "end_frame")))
    first = F.greatest(F.col("start"), F.col("frame_id") * frame_size)
    last = F.least(F.col("start") + F.col("size"), (F.col("frame_id") + 1) * frame_size)
    return hit.select("path_rel", "frame_id", (first - F.col("start")).alias("in_file"), (first - F.col("frame_id") * frame_size).alias("in_frame"), (last - first).alias("length"))


def next_fit(sizes: DataFrame, max_volume: int, volume: int = 1, used: int = 0) -> DataFrame:
    """(frame_id, size) in order of frame_id to (frame_id, size, volume_no, volume_offset).

    A frame opens a new volume when it doesn't fit; one larger than a volume has its own.  The fold
    is sequential by nature; it streams over one row a frame, without payloads, in constant memory.
    It may go on from a ``volume`` of which some bytes are ``used``.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, full = volume, used
        for batch in batches:
            volumes, offsets = [], []
            for size in batch["size"]:
                if full and full + size > max_volume:
                    now, full = now + 1, 0
                volumes.append(now)
                offsets.append(full)
                full += size
            yield batch.assign(volume_no=volumes, volume_offset=offsets)

    ordered = sizes.select(F.col("frame_id").cast("long"), F.col("size").cast("long")).repartition(1).sortWithinPartitions("frame_id")
    return ordered.mapInPandas(fold, "frame_id long, size long, volume_no long, volume_offset long")


def needed_frames(selection: DataFrame, offsets: DataFrame, frame_size: int) -> DataFrame:
    """Distinct frames that hold the selected paths."""
    return slices(offsets.join(selection.select("path_rel").distinct(), "path_rel", "left_semi"), frame_size).select("frame_id").distinct()


def first_frame_after(points: DataFrame, frame_table: DataFrame, frame_size: int) -> DataFrame:
    """As-of: for each (path_rel, start) the first frame that ends after ``start``, as an equi-join on the frame number."""
    return points.withColumn("frame_id", F.floor(F.col("start") / frame_size)).join(frame_table.select("frame_id", "frame_start", "frame_end"), "frame_id", "left")
