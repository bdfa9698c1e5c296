"""Byte streams: fixed-size frames of ordered chunks, volumes that close by size, and packing of micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import codecs, layout
from ..staging import shared_dir, stage

VOLUMES = "stream string, frame_id long, size long, volume_no long, volume_offset long"


def cut_chunks(chunks: DataFrame, frame_size: int) -> DataFrame:
    """(stream, start, data) chunks at their byte offsets, cut at frame edges: (stream, frame_id, in_frame, data).  Works on streams: no state."""
    size = F.octet_length("data")
    ids = F.sequence(F.floor(F.col("start") / frame_size), F.floor((F.col("start") + size - 1) / frame_size))
    hit = chunks.filter(size > 0).withColumn("frame_id", F.explode(ids))
    first = F.greatest(F.col("start"), F.col("frame_id") * frame_size)
    n = F.least(F.col("start") + size, (F.col("frame_id") + 1) * frame_size) - first
    return hit.select("stream", "frame_id", (first - F.col("frame_id") * frame_size).alias("in_frame"), F.substring("data", (first - F.col("start") + 1).cast("int"), n.cast("int")).alias("data"))


def join_frames(parts: DataFrame) -> DataFrame:
    """Whole frames from their parts."""
    g = parts.groupBy("stream", "frame_id").agg(F.collect_list(F.struct("in_frame", "data")).alias("p"))
    return g.select("stream", "frame_id", codecs.joined("p", "in_frame", "data").alias("data"))


def batch_frames(conversations: DataFrame, frame_size: int) -> DataFrame:
    """The frames of one byte stream of all texts in order of (conv_id, turn)."""
    rows = conversations.select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data")).withColumn("n", F.octet_length("data").cast("long"))
    order = [F.col("conv_id"), F.col("turn"), F.md5("data")]
    chunks = layout.running_before(rows, "n", order, "start").select(F.lit("-").alias("stream"), "start", "data")
    return join_frames(cut_chunks(chunks, frame_size)).drop("stream")


def roll_volumes(frames: DataFrame, max_volume: int) -> DataFrame:
    """Volumes of a stream of (stream, frame_id, size): a volume closes when the next frame doesn't fit; state is (volume, used)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        volume, used = state.get if state.exists else (1, 0)
        rows = pd.concat(list(batches)).sort_values("frame_id")
        out = []
        for frame, size in zip(rows["frame_id"], rows["size"], strict=True):
            if used and used + size > max_volume:
                volume, used = volume + 1, 0
            out.append((key[0], frame, size, volume, used))
            used += size
        state.update((int(volume), int(used)))
        yield pd.DataFrame(out, columns=["stream", "frame_id", "size", "volume_no", "volume_offset"])

    return frames.groupBy("stream").applyInPandasWithState(fold, VOLUMES, "volume long, used long", "append", GroupStateTimeout.NoTimeout)


def read_chunks(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """A stream of (stream, start, data) chunks from Parquet files as they come, a bounded number of files at a time."""
    return spark.readStream.schema("stream string, start long, data binary").option("maxFilesPerTrigger", files_at_once).parquet(folder)


def spool(spark: SparkSession, source: BinaryIO, folder: str, frame_size: int, stream: str = "-", at_once: int = 64) -> int:
    """Bytes from a source such as standard input to chunks of a frame's size, appended below ``folder`` for :func:`read_chunks`; their number.

    The driver holds ``at_once`` chunks; the last may be short.
    """
    start, rows = 0, []
    schema = "stream string, start long, data binary"
    while data := source.read(frame_size):
        while len(data) < frame_size and (more := source.read(frame_size - len(data))):
            data += more  # a pipe may give less than was asked for
        rows.append((stream, start, data))
        start += len(data)
        if len(rows) == at_once:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
            rows = []
    if rows:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
    return start


def pack_stream(frames: DataFrame, path: str, checkpoint: str, max_volume: int | None = None) -> StreamingQuery:
    """Encode frames of (frame_id, data) as they come and append them below ``path``, a folder for each batch, so a repeated batch replaces its own.

    With ``max_volume`` frames are placed in volumes, too: a batch goes on where the batches before it
    ended, which their folders tell, so a repeated batch is placed as before.
    """

    def write(batch: DataFrame, number: int) -> None:
        encoded = codecs.encode_frames(batch.select("frame_id", "data"))
        if max_volume is not None:
            encoded = stage(encoded, "encoded")
            ends = (F.col("volume_offset") + F.col("size")).alias("used")
            last = None
            if number:
                before = batch.sparkSession.read.parquet(path).filter(F.col("batch") < number)
                last = before.agg(F.max(F.struct("volume_no", ends)).alias("m")).first()["m"]
            volume, used = (last["volume_no"], last["used"]) if last else (1, 0)
            placed = layout.next_fit(encoded.select("frame_id", "size"), max_volume, volume, used).drop("size")
            encoded = encoded.join(placed, "frame_id")
        encoded.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_ordered(frames: DataFrame, sink: BinaryIO, size: int | None = None) -> int:
    """The bytes of (frame_id, mode, original_size, payload) in order to a sink such as standard output; their number.

    Frames are decoded in parallel and taken one partition at a time; ``size``, if known, must be met.
    """
    decoded = codecs.decode_frames(frames).orderBy("frame_id")
    n = 0
    for row in decoded.toLocalIterator():
        n += sink.write(row["data"])
    if size is not None and n != size:
        raise ValueError(f"{n} bytes, not {size}")
    return n


def rolled(spark: SparkSession, frames: DataFrame, max_volume: int) -> DataFrame:
    """Volumes of (stream, frame_id, size) by a streaming query over a staged copy, run to its end; the result is a staged table."""
    source, out = stage(frames.select("stream", "frame_id", "size").coalesce(1).sortWithinPartitions("frame_id"), "stream"), f"{shared_dir(spark)}/rolled-{uuid.uuid4().hex}"
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    live = spark.readStream.schema(source.schema).parquet(folder)
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    query = roll_volumes(live, max_volume).writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}-check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def stream_catalog(frames: DataFrame) -> DataFrame:
    """One file row for the whole stream."""
    return frames.agg(F.lit("<stdin>").alias("path_rel"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("size"), F.count("*").alias("frames"))
