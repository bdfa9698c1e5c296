"""Best-fit packing of token sequences by hierarchical residual rounds.

1. Every document becomes one piece, or, when longer than a sequence, pieces of a full
   sequence each after a shorter first one.  Pieces are staged.
2. Each chunk of pieces is packed best-fit, longest first.  Bins that no open bin can join are final.
3. Underfull bins go on as items: groups of them are packed best-fit into larger bins, groups are
   merged into fewer ones, and rounds repeat until one bounded group is left or rounds gain nothing.

Texts are read once.  Rounds move only (bin, fill) rows; a piece's final place is its place in its
bin plus its bins' places, joined back at the end.  No task holds more than ``chunk`` items and a
batch at a time.  Rounds end when one removes less than a hundredth of the underfull bins that it was
given: that is what they may cost in sequences, besides what best-fit itself does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_bpe, free_name, named, slices, stage, table, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset there, and each bin's fill.

    Open bins are kept by room left; a bit for each room that occurs finds the least sufficient one.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if fit := rooms >> size:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int | None = 2, tokenizer: str | None = None, cache_words: int = 600_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs`` (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer, cache_words)
        for batch, texts in slices(batches):
            ids, sizes = with_end(*encoder.encode(texts), end_id)
            raw, rows, at = ids.astype("<u4").tobytes(), [], 0
            for doc, n in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                start, size = 0, n % capacity or min(n, capacity)
                piece = 0
                while start < n:
                    rows.append((doc, piece, start, size, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + size)])))
                    piece, start, size = piece + 1, start + size, capacity
                at += n
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _local(capacity: int, chunk: int, names: tuple[str, str, str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = pa.Table.from_batches(held)
            bins, offsets, fills = best_fit(rows["length"].to_numpy(), capacity)
            for name, values in zip(names, (offsets, (task << 40) + made + bins, fills[bins]), strict=True):
                rows = rows.append_column(name, pa.array(values))
            made += len(fills)
            yield from rows.to_batches(max_chunksize=10_000)

        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                held.append(batch.slice(i, chunk))
                n += held[-1].num_rows
                if n >= chunk:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return pack


def _merge(capacity: int, level: int, chunk: int):
    """Bins as items: (bin, fill) to (bin, to, at, fill)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            nonlocal made
            rows = pd.concat(held, ignore_index=True).sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
            bins, at, fills = best_fit(rows["fill"].to_numpy(), capacity)
            out = pd.DataFrame({"bin": rows["bin"], "to": -((level << 56) + (task << 40) + made + bins + 1), "at": at, "fill": fills[bins]})
            made += len(fills)
            return out

        for frame in frames:
            for i in range(0, len(frame), chunk):
                held.append(frame.iloc[i : i + chunk])
                n += len(held[-1])
                if n >= chunk:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return pack


def pack_best_fit(pieces_df: DataFrame, capacity: int = 1024, chunk: int = 200_000, fan_in: int = 8) -> DataFrame:
    """Pack rows with a ``length`` of 1..capacity; adds ``sequence_id`` and ``offset`` (gapless from 0 in each sequence), in place of columns so named.

    An empty input gives an empty result.  Rows of length 0 can't occur in :func:`pieces` with an
    end id; without one, empty texts have no piece.  Repeated rows are packed like any others.
    """
    names = [c for c in pieces_df.columns if c.lower() not in ("sequence_id", "offset")]
    kept = pieces_df.select(*[F.col(f"`{c}`") for c in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    own = offset, bin_, fill = tuple(free_name(kept, x) for x in ("own_offset", "own_bin", "own_fill"))
    placed = stage(kept.mapInArrow(_local(capacity, chunk, own), ", ".join([kinds, *(f"`{x}` long" for x in own)])), "bins")
    bins = placed.filter((F.col(offset) == 0) & (F.col(fill) < capacity)).select(F.col(bin_).alias("bin"), F.col(fill).alias("fill"))
    moves: list[DataFrame] = []
    groups = None
    while True:
        n, least = bins.agg(F.count("*"), F.min("fill")).first()
        if n < 2:
            break
        bins = bins.filter(F.col("fill") <= capacity - least)  # fuller ones can take no other: final
        last = groups == 1
        want = max(1, -(-n // chunk))
        groups = want if groups is None else max(1, min(want, groups // fan_in))
        groups = max(groups, -(-n // chunk))
        dealt = bins.repartition(groups, F.xxhash64("bin", F.lit(len(moves))))
        move = stage(dealt.mapInPandas(_merge(capacity, len(moves) + 1, chunk), "bin long, to long, at long, fill long"), "merge")
        moves.append(move)
        merged = move.filter(F.col("at") == 0).select(F.col("to").alias("bin"), "fill")
        left = merged.count()
        if groups == 1 or last or left > 0.99 * n:
            break
        bins = merged
    columns = [F.col(f"`{c}`") for c in names]
    if not moves:
        return placed.select(*columns, F.col(bin_).alias("sequence_id"), F.col(offset).alias("offset"))
    path = moves[-1].select("bin", "to", "at")
    for move in reversed(moves[:-1]):
        later = path.select(F.col("bin").alias("to"), F.col("to").alias("final"), F.col("at").alias("more"))
        path = move.join(later, "to", "left").select("bin", F.coalesce("final", "to").alias("to"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
    to, at = free_name(placed, "to_bin"), free_name(placed, "to_place")
    path = path.select(F.col("bin").alias(bin_), F.col("to").alias(to), F.col("at").alias(at))
    place = F.col(offset) + F.coalesce(F.col(at), F.lit(0))
    return placed.join(path, bin_, "left").select(*columns, F.coalesce(to, bin_).alias("sequence_id"), place.alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int | None = 2, tokenizer: str | None = None, chunk: int = 200_000, cache_words: int = 600_000) -> DataFrame:
    """Tokenize and pack ``docs`` (doc_id, text); null texts are empty, and an empty text is its end id.

    ``cache_words`` trades a worker's memory for time: the number of words whose ids it remembers.
    """
    cut = stage(pieces(named(docs, doc_id="doc_id", text="text"), capacity, end_id, tokenizer, cache_words), "pieces")
    return pack_best_fit(cut, capacity, chunk)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document of whole ``documents``, with its sequence and place."""
    return pack_documents(table(spark, sf_dir, "documents"))
