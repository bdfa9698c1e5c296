"""Packing a corpus to an archive of tables, and restoring it."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import catalog, codecs, dedup, layout
from ..sources import index_io
from ..staging import stage


class Archive(NamedTuple):
    """``files`` (path_rel, size, is_duplicate, original_path), ``slices`` of the unique files, and ``frames`` with payloads and volumes.

    Frames of the older modes need the archive's byte dictionary and patterns, too.
    """

    files: DataFrame
    slices: DataFrame
    frames: DataFrame
    dictionary: list[int] | None = None
    patterns: list[bytes] | None = None


def frame_bytes(files: DataFrame, frame_size: int, slices: DataFrame | None = None) -> DataFrame:
    """(frame_id, data): unique contents cut into frames; no row is larger than a frame."""
    slices = layout.slices(layout.file_offsets(dedup.find_duplicates(files)), frame_size) if slices is None else slices
    cut = slices.join(files.select("path_rel", "content"), "path_rel")
    part = F.struct(F.col("in_frame").alias("at"), F.expr("substring(content, cast(in_file + 1 as int), cast(length as int))").alias("bytes"))
    return cut.groupBy("frame_id").agg(F.collect_list(part).alias("parts")).select("frame_id", codecs.joined("parts", "at", "bytes").alias("data"))


def pack(files: DataFrame, frame_size: int = 16 << 20, max_volume: int = 98 << 20, mode: str = "lz4") -> Archive:
    """The catalog, the slices and the encoded frames are each computed once and written to the shared folder, as later steps read them more than once."""
    catalog = stage(dedup.find_duplicates(files), "catalog")
    slices = stage(layout.slices(layout.file_offsets(catalog), frame_size), "slices")
    encoded = stage(codecs.encode_frames(frame_bytes(files, frame_size, slices), mode), "frames")
    placed = layout.next_fit(encoded.select("frame_id", "size"), max_volume).select("frame_id", "volume_no", "volume_offset")
    return Archive(catalog, slices, encoded.join(placed, "frame_id"))


def write(archive: Archive, path: str) -> None:
    """Tables below ``path``; payloads are apart by volume, so browsing reads none and extracting reads only what it needs."""
    archive.files.write.parquet(f"{path}/files")
    archive.slices.write.parquet(f"{path}/slices")
    archive.frames.repartition("volume_no").write.partitionBy("volume_no").parquet(f"{path}/frames")


def read(spark: SparkSession, path: str) -> Archive:
    return Archive(*[spark.read.parquet(f"{path}/{name}") for name in ("files", "slices", "frames")])


def _parts(archive: Archive, files: DataFrame, every: bool) -> DataFrame:
    """(path_rel, in_file, bytes) of the slices of ``files`` (source); only frames that hold them are decoded."""
    wanted = files.select(F.col("source").alias("path_rel")).distinct()
    slices = archive.slices.join(wanted, "path_rel", "left_semi")
    frames = archive.frames if every else archive.frames.join(slices.select("frame_id").distinct(), "frame_id", "left_semi")
    cut = F.expr("substring(data, cast(in_frame + 1 as int), cast(length as int))")
    decoded = codecs.decode_frames(frames, archive.dictionary, archive.patterns)
    return slices.join(decoded, "frame_id").select("path_rel", "in_file", cut.alias("bytes"))


def _selected(archive: Archive, selection: DataFrame | None) -> DataFrame:
    files = archive.files if selection is None else archive.files.join(selection.select("path_rel").distinct(), "path_rel", "left_semi")
    return files.withColumn("source", F.coalesce("original_path", "path_rel"))


def restore(archive: Archive, selection: DataFrame | None = None) -> DataFrame:
    """(path_rel, size, content) of all files, or of the selected paths; only frames that hold them are decoded.

    Empty files and duplicates are restored too, wherever they stand.  A content is one value, so
    this is for files of up to 2 GB; :func:`restore_to` has no such limit.
    """
    files = _selected(archive, selection)
    part = F.struct(F.col("in_file").alias("at"), "bytes")
    whole = _parts(archive, files, selection is None).groupBy("path_rel").agg(F.collect_list(part).alias("parts"))
    whole = whole.select(F.col("path_rel").alias("source"), codecs.joined("parts", "at", "bytes").alias("content"))
    return files.join(whole, "source", "left").select("path_rel", "size", F.coalesce("content", F.lit(b"")).alias("content"))


def _on_rows(rows: DataFrame, do: Callable[[dict], str]) -> DataFrame:
    """``do`` with every row, staged: (path_rel, size, how) with what it says, or ``failed``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    how = do(row)
                except OSError:
                    how = "failed"
                out.append((row["path_rel"], row["size"], how))
            yield pd.DataFrame(out, columns=["path_rel", "size", "how"]).astype({"size": "int64"})

    return stage(rows.mapInPandas(run, "path_rel string, size long, how string"), "restored")


def restore_to(archive: Archive, target: str, selection: DataFrame | None = None, link: bool = True) -> DataFrame:
    """Restore all files, or the selected ones, below ``target``, a folder that all executors see; (path_rel, size, how) tells of each.

    Each content is written once, slice by slice at its place, whatever its size; files of equal
    content are hard links to it or, without ``link`` or where links fail, copies.  ``how`` is
    ``written``, ``linked``, ``copied`` or ``failed``.  Every step may be run again with the same end.
    A path that leads out of ``target`` raises.
    """
    files = stage(_selected(archive, selection), "selected")
    out = files.filter(F.col("path_rel").rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:")).select("path_rel").take(1)
    if out:
        raise ValueError(f"{out[0][0]} leads out of the target")
    # The content's own path, if that is wanted, else the first of those that have it.
    own = F.when(F.col("path_rel") == F.col("source"), F.lit("")).otherwise(F.col("path_rel"))
    first = files.groupBy("source").agg(F.min_by("path_rel", own).alias("first"))
    files = stage(files.join(first, "source").select("path_rel", "size", "source", "first"), "targets")
    heads = files.filter("path_rel = first")

    def make(row: dict) -> str:
        path = os.path.join(target, row["path_rel"])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        spare = f"{path}.{uuid.uuid4().hex}"
        with open(spare, "wb") as f:
            f.truncate(int(row["size"]))
        os.replace(spare, path)  # a file of its own, also where a link was
        return "written"

    def write(row: dict) -> str:
        with open(os.path.join(target, row["path_rel"]), "r+b") as f:
            f.seek(int(row["in_file"]))
            f.write(row["bytes"])
        return "written"

    def repeat(row: dict) -> str:
        path, source = (os.path.join(target, row[c]) for c in ("path_rel", "first"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        spare = f"{path}.{uuid.uuid4().hex}"
        try:
            if not link:
                raise OSError("links are not wanted")
            os.link(source, spare)
            how = "linked"
        except OSError:
            shutil.copyfile(source, spare)
            how = "copied"
        os.replace(spare, path)
        if os.path.exists(spare):  # two links to one file: there was nothing to replace
            os.remove(spare)
        return how

    made = _on_rows(heads.select("path_rel", "size"), make)
    parts = _parts(archive, heads, selection is None).withColumnRenamed("path_rel", "source").join(heads.select("source", "path_rel", "size"), "source")
    failed = _on_rows(parts.select("path_rel", "size", "in_file", "bytes"), write).filter("how = 'failed'").select("path_rel").distinct()
    done = made.join(failed.withColumn("bad", F.lit(True)), "path_rel", "left").select("path_rel", "size", F.when(F.col("bad"), "failed").otherwise(F.col("how")).alias("how"))
    return done.union(_on_rows(files.filter("path_rel <> first").select("path_rel", "size", "first"), repeat))


def write_volumes(archive: Archive, base: str, max_volume: int, params: dict, sddls: DataFrame | None = None) -> list[str]:
    """Numbered volume files ``base.001`` .. in a folder that all executors see, the index at the end of the last; their paths.

    A volume is one task's stream of payloads; it appears under its name when it is whole.  A last
    volume that is over 0.4 full gets the index in a volume of its own.
    """
    names, base = ["volume_no", "bytes"], os.path.abspath(base)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, spare, n = None, None, "", 0
        for batch in batches:
            for volume, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if volume != now:
                    if f:
                        f.close()
                        os.replace(spare, f"{base}.{now:03}")
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64())], names)
                    now, n, spare = volume, 0, f"{base}.{volume:03}.{uuid.uuid4().hex}"
                    f = open(spare, "wb")  # noqa: SIM115
                n += f.write(payload.as_buffer())
        if f:
            f.close()
            os.replace(spare, f"{base}.{now:03}")
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64())], names)

    frames = stage(archive.frames, "frames")
    dealt = frames.select("volume_no", "volume_offset", "payload").repartition("volume_no").sortWithinPartitions("volume_no", "volume_offset")
    sizes = dealt.select("volume_no", "payload").mapInArrow(write, "volume_no long, bytes long").collect()  # a row a volume
    last, used = max(((r["volume_no"], r["bytes"]) for r in sizes), default=(1, 0))
    number = last + 1 if used / max_volume > 0.4 else last
    name = paths.volume_name(os.path.basename(base), F.col("volume_no"))
    first = archive.slices.filter("in_file = 0").select("path_rel", F.col("frame_id").alias("sframe_id"))
    files = catalog.surrogate_ids(archive.files.join(first, "path_rel", "left").withColumn("parent_path", paths.parent_path(F.col("path_rel"))))
    index = frames.select(F.col("frame_id").alias("id"), name.alias("vol"), F.col("volume_offset").alias("offset"), "size", "original_size")
    modes = {str(r["frame_id"]): r["mode"] for r in frames.select("frame_id", "mode").toLocalIterator()}
    sddls = archive.files.sparkSession.createDataFrame([], index_io.SDDLS) if sddls is None else sddls
    index_io.write_index(f"{base}.{number:03}", files.orderBy("id"), index.orderBy("id"), sddls, params | {"max_volume_size": max_volume, "frame_modes": modes})
    return index_io.volumes(base)


def read_volumes(spark: SparkSession, base: str) -> Archive:
    """The archive in volume files ``base.NNN``; payloads are read by range, when they are wanted."""
    folder = os.path.dirname(os.path.abspath(base))
    index = index_io.read_index(spark, index_io.volumes(base)[-1])
    modes = index["params"]["frame_modes"]
    table = spark.createDataFrame([(int(k), v) for k, v in modes.items()], "frame_id long, mode string")
    rows = index["frames"].select(F.col("id").alias("frame_id"), "vol", F.col("offset").alias("volume_offset"), "size", "original_size")
    rows = rows.join(table, "frame_id", "left").withColumn("mode", F.coalesce("mode", F.lit("raw")))

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(len(frame)):  # a payload at a time
                row = frame.iloc[[i]]
                with open(os.path.join(folder, row["vol"].iat[0]), "rb") as f:
                    f.seek(int(row["volume_offset"].iat[0]))
                    yield row.assign(payload=[f.read(int(row["size"].iat[0]))])

    names = ["frame_id", "mode", "original_size", "size", "vol", "volume_offset"]
    got = rows.select(*names).mapInPandas(fetch, "frame_id long, mode string, original_size long, size long, vol string, volume_offset long, payload binary")
    frames = got.withColumn("volume_no", paths.volume_number(F.col("vol")).cast("long")).drop("vol")
    files = index["files"].select("path_rel", "size", "is_duplicate", "original_path")
    slices = layout.slices(layout.file_offsets(files), int(index["params"]["frame_size"]))
    known = (index["params"].get("dictionary") or {}).get("top_bytes")
    patterns = (index["params"].get("pattern_dictionary") or {}).get("patterns")
    return Archive(files, slices, frames, known, patterns and [bytes.fromhex(p) for p in patterns])
