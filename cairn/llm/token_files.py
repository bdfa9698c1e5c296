"""Token-id files in directly addressable codes.

A segment holds the ids of consecutive documents.  Each id is split into chunks of ``bits`` bits;
level j holds the j-th chunk of every id that has one, and a bitmap tells which of them go on to
level j + 1.  A directory with the number of set bits before every 512 bits makes ranks, and so the
place of any id's next chunk, a matter of one lookup: any token is read without decoding others.

Segments are rows of a Parquet table, so any store that Spark writes can hold them.  Rows are
(part, segment, before, n_tokens, data): ``part`` numbers ranges of doc_id in ascending order,
``before`` counts the part's tokens ahead of the segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_bpe, named, slices, stage, table, with_end

MAGIC = b"CDAC"
SEGMENTS = "part int, segment int, before long, n_tokens long, data binary"
STRIDE = 512
_set_bits = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    """One segment; ``bits`` is 8 or 16."""
    kind = {8: "<u1", 16: "<u2"}[bits]
    out = [np.array([-1 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()]
    rest, levels = ids.astype(np.uint32), 0
    while True:
        more = rest >> np.uint32(bits)
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        rank = np.concatenate([[0], np.cumsum(np.add.reduceat(_set_bits[bitmap], np.arange(0, len(bitmap), STRIDE // 8), dtype=np.int64))]) if len(bitmap) else np.zeros(1)
        out += [struct.pack("<QQ", len(rest), len(rank)), (rest & np.uint32((1 << bits) - 1)).astype(kind).tobytes(), bitmap.tobytes(), rank.astype("<u4").tobytes()]
        levels += 1
        if not goes_on.any():
            return b"".join([MAGIC, struct.pack("<BBxxQQ", bits, levels, len(doc_ids), len(ids)), *out])
        rest = more[goes_on]


class Segment:
    """Reader of one segment."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.bits, n_levels, n_docs, self.n_tokens = struct.unpack_from("<BBxxQQ", data, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += a.nbytes
            return a

        ids, void = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if v else d for d, v in zip(ids.tolist(), void.tolist(), strict=True)]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n, n_rank = struct.unpack_from("<QQ", data, at)
            at += 16
            self.levels.append((take("<u1" if self.bits == 8 else "<u2", n), take("u1", -(-n // 8)), take("<u4", n_rank)))

    def token(self, i: int) -> int:
        """The i-th id of the segment, by one rank a level."""
        value = 0
        for j, (chunks, bitmap, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (self.bits * j)
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                return value
            block = i // STRIDE
            i = int(rank[block]) + int(_set_bits[bitmap[block * STRIDE // 8 : byte]].sum()) + bin(bitmap[byte] & ((1 << bit) - 1)).count("1")
        return value

    def tokens_at(self, at: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order, by one rank a level for each."""
        out, row, at = np.zeros(len(at), np.uint32), np.arange(len(at)), np.asarray(at, np.int64)
        for j, (chunks, bitmap, rank) in enumerate(self.levels):
            out[row] |= chunks[at].astype(np.uint32) << np.uint32(self.bits * j)
            on = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            row, at = row[on], at[on]
            if not len(at):
                break
            block, byte = at // STRIDE, at >> 3
            own = block[:, None] * (STRIDE // 8) + np.arange(STRIDE // 8)
            before = np.where(own < byte[:, None], _set_bits[bitmap[np.minimum(own, len(bitmap) - 1)]], 0).sum(1, dtype=np.int64)
            part = _set_bits[bitmap[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]
            at = rank[block].astype(np.int64) + before + part
        return out

    def tokens(self) -> np.ndarray:
        """All ids."""
        chunks, _, _ = self.levels[0]
        ids, at = chunks.astype(np.uint32), np.arange(len(chunks))
        for j in range(1, len(self.levels)):
            at = at[np.unpackbits(self.levels[j - 1][1], count=len(at), bitorder="little").astype(bool)]
            ids[at] |= self.levels[j][0].astype(np.uint32) << np.uint32(self.bits * j)
        return ids


def encode_documents(docs: DataFrame, end_id: int | None = 2, tokenizer: str | None = None, bits: int = 8, segment_tokens: int = 1 << 17) -> DataFrame:
    """Segments of every row of ``docs`` (doc_id, text), in ascending order of doc_id, nulls first; rows of one id by the text's hash and then the text.

    Null and empty texts have the end id alone (without one, no id at all).  A document is in one
    segment, however long: segments close at the first document's end at ``segment_tokens`` ids or more.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = byte_bpe(tokenizer, 900_000), TaskContext.get().partitionId()
        docs_held: list[int | None] = []
        sizes_held: list[np.ndarray] = []
        ids_held: list[np.ndarray] = []
        segment = before = n = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, n
            data = encode_segment(docs_held, np.concatenate(sizes_held), np.concatenate(ids_held), bits)
            row = [[part], [segment], [before], [n], [data]]
            segment, before, n = segment + 1, before + n, 0
            for held in (docs_held, sizes_held, ids_held):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "before", "n_tokens", "data"])

        for batch, texts in slices(batches, rows=1024):
            ids, sizes = with_end(*encoder.encode(texts), end_id)
            docs_held += batch.column(0).to_pylist()
            sizes_held.append(sizes)
            ids_held.append(ids)
            n += len(ids)
            if n >= segment_tokens:
                yield flush()
        if docs_held:
            yield flush()

    named_docs = named(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    by = ("doc_id", F.xxhash64("text"))
    return named_docs.repartitionByRange(*by).sortWithinPartitions(*by, "text").mapInArrow(encode, SEGMENTS)


def _placed(segments: DataFrame) -> DataFrame:
    """``segments`` with ``base``, the number of ids before the segment in the whole table."""
    # One row for each part, of which there are no more than a shuffle has partitions: small at any size.
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    return segments.join(F.broadcast(base), "part").withColumn("base", F.col("part_base") + F.col("before"))


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in a segment table; ``start`` counts the ids of all documents before.

    A row for each document written, in no order of rows; an empty table gives none.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(data.as_buffer().to_pybytes())
                raw, at = s.tokens().astype("<u4").tobytes(), s.starts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(segments).select("base", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(segments: DataFrame, positions: DataFrame, cell: int = 1 << 17, dealt: int = 1_000_000) -> DataFrame:
    """(position, token) of each row of ``positions`` (position): the id at that place in the whole table, without decoding others.

    Rows with a null position or one outside the table are left out; repeated ones each have a row.
    Positions meet segments on cells of ``cell`` ids; a segment goes once to every ``dealt`` positions in it.
    """
    placed = _placed(segments)
    ranges = placed.filter("n_tokens > 0").select("part", "segment", "base", (F.col("base") + F.col("n_tokens")).alias("end"))
    cells = F.sequence(F.floor(F.col("base") / cell), F.floor((F.col("end") - 1) / cell))
    wanted = named(positions, position="position").filter("position is not null").withColumn("cell", F.floor(F.col("position") / cell))
    found = wanted.join(ranges.withColumn("cell", F.explode(cells)), "cell").filter("position >= base and position < end")
    found = stage(found.select("part", "segment", "position", (F.col("position") - F.col("base")).alias("at")), "positions")
    salts = found.groupBy("part", "segment").agg(F.ceil(F.count("*") / dealt).alias("salts"))
    salted = found.join(salts, ["part", "segment"]).withColumn("salt", F.pmod(F.xxhash64("position"), F.col("salts")))
    heads = segments.join(salts, ["part", "segment"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    nothing = F.lit(None).cast("long")
    heads = heads.select("part", "segment", "salt", nothing.alias("position"), nothing.alias("at"), "data")
    rows = salted.select("part", "segment", "salt", "position", "at", F.lit(None).cast("binary").alias("data"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = np.flatnonzero(np.asarray(batch.column(2).is_valid()))
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                first = a
                if a < b and batch.column(2)[a].is_valid:
                    held, first = Segment(batch.column(2)[a].as_py()), a + 1
                if first < b:
                    part = batch.slice(first, b - first)
                    got = held.tokens_at(part.column(1).to_numpy())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.astype(np.int64))], ["position", "token"])

    by = ("part", "segment", "salt")
    ordered = heads.union(rows).repartition(*by).sortWithinPartitions(*by, F.col("at").asc_nulls_first())
    return ordered.select("position", "at", "data").mapInArrow(look_up, "position long, token long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` written as segments and read back: the place, length and checksum of each."""
    return read_documents(stage(encode_documents(table(spark, sf_dir, "documents")), "segments"))
