"""Byte codecs of frames, and hashes; applied to columns as Arrow-batched functions.

Malformed input and a wrong size raise: a damaged frame fails the job rather than restoring zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
MIN_MATCH = 4
MAX_OFFSET = (1 << 24) - 1
HASH_FACTOR = 0x9E3779B1
FNV_OFFSET, FNV_PRIME, FNV_BLOCK = 0xCBF29CE484222325, 0x100000001B3, 256 * 1024
MODES = ("lz_ext3_gpu", "lz_ext3_cpu", "lz4_gpu", "lz4", "raw", "rle1", "rle2", "pattern_rle", "delta_rle")


class CodecError(ValueError):
    pass


def lz_decode(data: bytes, size: int, offset_bytes: int = 3) -> bytes:
    """Token, literals, match: nibbles of 15 go on in bytes up to one below 255; offsets are little-endian."""
    out, i, end = bytearray(), 0, len(data)

    def more(n: int) -> int:
        nonlocal i
        while n >= 15:
            if i >= end:
                raise CodecError("length cut off")
            n, i = n + data[i], i + 1
            if data[i - 1] != 255:
                break
        return n

    while i < end:
        token, i = data[i], i + 1
        literals = more(token >> 4)
        if i + literals > end:
            raise CodecError("literals cut off")
        out += data[i : i + literals]
        i += literals
        if i == end:
            break
        if i + offset_bytes > end:
            raise CodecError("offset cut off")
        offset = int.from_bytes(data[i : i + offset_bytes], "little")
        i += offset_bytes
        if not 0 < offset <= len(out):
            raise CodecError(f"offset {offset} at {len(out)} bytes")
        length = more(token & 15) + MIN_MATCH
        start = len(out) - offset
        if offset >= length:
            out += out[start : start + length]
        else:
            out += (bytes(out[start:]) * (length // offset + 1))[:length]
        if len(out) > size:
            break
    if len(out) != size:
        raise CodecError(f"{len(out)} bytes, not {size}")
    return bytes(out)


def _length(n: int) -> bytes:
    return b"" if n < 15 else b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])


def lz_hash(data: bytes, bits: int = 20) -> np.ndarray:
    """The table place of the four bytes at each position: the top bits of their product with a fixed odd number."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = max(0, len(a) - 3)
    word = a[:n] | a[1 : n + 1] << np.uint32(8) | a[2 : n + 2] << np.uint32(16) | a[3 : n + 3] << np.uint32(24)
    return (word * np.uint32(HASH_FACTOR)) >> np.uint32(32 - bits)


def hash4(column: str) -> Column:
    """:func:`lz_hash` of a content's first four bytes as a column, null for shorter ones; products stay within a long."""
    h = F.hex(F.substring(column, 1, 4))
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("long")
    high, low = byte(3) * 256 + byte(2), byte(1) * 256 + byte(0)
    product = F.pmod(low * HASH_FACTOR + F.pmod(high * HASH_FACTOR, F.lit(1 << 16)) * (1 << 16), F.lit(1 << 32))
    return F.when(F.octet_length(column) >= 4, F.shiftright(product, 12))


def lz_encode(data: bytes, candidates: int = 4, good: int = 96) -> bytes:
    """The longest match among the last ``candidates`` places of the same four bytes; one of ``good`` bytes ends the search.

    Steps grow where nothing matches.
    """
    out, seen, i, done, misses = bytearray(), {}, 0, 0, 0
    last = len(data) - MIN_MATCH

    def matching(at: int, i: int) -> int:
        n, step = MIN_MATCH, 64
        while step:
            while data[at + n : at + n + step] == data[i + n : i + n + step] and i + n + step <= len(data):
                n += step
            step //= 2
        return n

    while i <= last:
        places = seen.setdefault(data[i : i + MIN_MATCH], [])
        best, at = 0, 0
        for place in reversed(places):
            if i - place > MAX_OFFSET:
                break
            n = matching(place, i)
            if n > best:
                best, at = n, place
            if n >= good:
                break
        places.append(i)
        if len(places) > candidates:
            del places[0]
        if not best:
            misses += 1
            i += 1 + (misses >> 6)
            continue
        misses, literals = 0, data[done:i]
        out.append(min(15, len(literals)) << 4 | min(15, best - MIN_MATCH))
        out += _length(len(literals)) + literals + (i - at).to_bytes(3, "little") + _length(best - MIN_MATCH)
        i += best
        done = i
    if done < len(data):
        literals = data[done:]
        out.append(min(15, len(literals)) << 4)
        out += _length(len(literals)) + literals
    return bytes(out)


def lz4_encode(data: bytes) -> bytes:
    """A standard block, by Arrow's compressor."""
    return pa.compress(data, "lz4_raw", asbytes=True)


def lz4_decode(data: bytes, size: int) -> bytes:
    """A standard block, by Arrow's decompressor.  That one doesn't tell how much it wrote, but fails where room is short: by a byte, it must."""
    if size < 2:
        return lz_decode(data, size, offset_bytes=2)
    try:
        out = pa.decompress(data, size, "lz4_raw", asbytes=True)
    except OSError as e:
        raise CodecError(f"not a block of {size} bytes") from e
    try:
        pa.decompress(data, size - 1, "lz4_raw", asbytes=True)
    except OSError:
        return out
    raise CodecError(f"fewer than {size} bytes")


def simple_lz_decode(data: bytes, size: int) -> bytes:
    """``00 n bytes`` or ``01 offset16 n``."""
    out, i = bytearray(), 0
    while len(out) < size:
        kind, rest = data[i : i + 1], data[i + 1 :]
        if kind == b"\0" and rest and len(rest) > rest[0]:
            out += rest[1 : 1 + rest[0]]
            i += 2 + rest[0]
        elif kind == b"\1" and len(rest) >= 3:
            offset, n = int.from_bytes(rest[:2], "little"), rest[2]
            if not 0 < offset <= len(out):
                raise CodecError("offset past the start")
            for _ in range(n):
                out.append(out[-offset])
            i += 4
        else:
            raise CodecError("bad token")
    if len(out) != size:
        raise CodecError("wrong size")
    return bytes(out)


def rle_decode(data: bytes) -> bytes:
    """Triples of a 16-bit count and a byte."""
    if len(data) % 3:
        raise CodecError("triple cut off")
    a = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return np.repeat(a[:, 2], a[:, 0].astype(np.int64) + 256 * a[:, 1].astype(np.int64)).tobytes()


def map_decode(data: bytes, dictionary: list[int]) -> bytes:
    """Codes number the dictionary's bytes and then all others in order."""
    table = [*dictionary, *(b for b in range(256) if b not in set(dictionary))]
    return data.translate(bytes(table))


def pattern_decode(data: bytes, patterns: list[bytes]) -> bytes:
    """A byte is a pattern's number; 0xFF gives the next byte as it is."""
    out, i = bytearray(), 0
    while i < len(data):
        if data[i] == 0xFF:
            if i + 1 >= len(data):
                raise CodecError("escape cut off")
            out.append(data[i + 1])
            i += 2
        elif data[i] < len(patterns):
            out += patterns[data[i]]
            i += 1
        else:
            raise CodecError("no such pattern")
    return bytes(out)


def delta_decode(data: bytes) -> bytes:
    """Running sums modulo 256."""
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).tobytes()


def decode_frame(mode: str, data: bytes, size: int, dictionary: list[int] | None = None, patterns: list[bytes] | None = None) -> bytes:
    """By recorded mode; an unknown one is raw."""
    if mode.startswith("lz_ext3"):
        return lz_decode(data, size)
    if mode in ("lz4", "lz4_gpu"):
        return lz4_decode(data, size)
    if mode in ("rle1", "rle2"):
        data = rle_decode(data)
        data = map_decode(data, dictionary) if mode == "rle2" and dictionary else data
    elif mode == "pattern_rle":
        data = pattern_decode(rle_decode(data), patterns or [])
    elif mode == "delta_rle":
        data = delta_decode(rle_decode(data))
    if len(data) != size:
        raise CodecError(f"{len(data)} bytes, not {size}")
    return bytes(data)


ENCODERS = {"lz4": lz4_encode, "lz_ext3_cpu": lz_encode, "raw": lambda data: b""}


def rle_encode(data: bytes) -> bytes:
    """Runs as triples of a 16-bit count and a byte; longer runs are several."""
    a = np.frombuffer(data, np.uint8)
    first = np.flatnonzero(np.diff(a, prepend=a[:1] ^ 1)) if len(a) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(a)))
    pieces = -(-length // 0xFFFF)
    count = np.full(int(pieces.sum()), 0xFFFF, np.int64)
    count[np.cumsum(pieces) - 1] = length - (pieces - 1) * 0xFFFF
    return np.stack([count & 255, count >> 8, np.repeat(a[first], pieces)], 1).astype(np.uint8).tobytes()


def map_encode(data: bytes, dictionary: list[int]) -> bytes:
    table = bytearray(256)
    for code, b in enumerate([*dictionary, *(b for b in range(256) if b not in set(dictionary))]):
        table[b] = code
    return data.translate(bytes(table))


def pattern_encode(data: bytes, patterns: list[bytes]) -> bytes:
    """Patterns by number where they stand, the first that fits; all other bytes are escaped."""
    out, i = bytearray(), 0
    while i < len(data):
        k = next((k for k, p in enumerate(patterns) if p and data.startswith(p, i)), None)
        out += bytes([0xFF, data[i]]) if k is None else bytes([k])
        i += 1 if k is None else len(patterns[k])
    return bytes(out)


def delta_encode(data: bytes) -> bytes:
    return np.diff(np.frombuffer(data, np.uint8), prepend=np.uint8(0)).astype(np.uint8).tobytes()


STORED = "frame_id long, mode string, original_size long, size long, payload binary"


def _stored(frame_id: pa.Array, mode: str, original_size: int, payload: bytes) -> pa.RecordBatch:
    """One frame as it is stored."""
    sizes = [pa.array([n], pa.int64()) for n in (original_size, len(payload))]
    return pa.RecordBatch.from_arrays([frame_id, pa.array([mode]), *sizes, pa.array([payload], pa.binary())], [c.split()[0] for c in STORED.split(", ")])


def encode_legacy(frames: DataFrame, mode: str, dictionary: list[int] | None = None, patterns: list[bytes] | None = None) -> DataFrame:
    """(frame_id, data) to (frame_id, mode, original_size, size, payload) in one of the older modes, for archives that older readers take."""
    before = {"rle1": lambda d: d, "rle2": lambda d: map_encode(d, dictionary or []), "pattern_rle": lambda d: pattern_encode(d, patterns or []), "delta_rle": delta_encode}[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                payload = rle_encode(before(data))
                yield _stored(batch.column(0).slice(i, 1), mode, len(data), payload)

    return frames.select("frame_id", "data").mapInArrow(run, STORED)


def encode_frames(frames: DataFrame, mode: str = "lz4") -> DataFrame:
    """(frame_id, data) to (frame_id, mode, original_size, size, payload); what doesn't shrink, or fails to, stays raw.

    ``lz4`` packs hundreds of megabytes a second in each task; ``lz_ext3_cpu`` finds matches up to 16 MB back, in Python.
    """
    encode = ENCODERS[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a frame at a time: memory is bounded by one frame
                data = batch.column(1)[i].as_py()
                try:
                    packed = encode(data)
                except (CodecError, MemoryError, OSError):  # what can't be packed is kept as it is
                    packed = b""
                good = 0 < len(packed) < len(data)
                payload = packed if good else data
                yield _stored(batch.column(0).slice(i, 1), mode if good else "raw", len(data), payload)

    return frames.select("frame_id", "data").mapInArrow(run, STORED)


def decode_frames(frames: DataFrame, dictionary: list[int] | None = None, patterns: list[bytes] | None = None) -> DataFrame:
    """(frame_id, mode, original_size, payload) to (frame_id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = decode_frame(batch.column(1)[i].as_py() or "raw", batch.column(3)[i].as_py(), batch.column(2)[i].as_py(), dictionary, patterns)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([data], pa.binary())], ["frame_id", "data"])

    return frames.select("frame_id", "mode", "original_size", "payload").mapInArrow(run, "frame_id long, data binary")


def fnv1a(data: bytes) -> int:
    return int(fnv1a_many([data])[0])


def fnv1a_many(values: list[bytes], rows: int = 512, room: int = 32 << 20) -> np.ndarray:
    """The hash of each value; the j-th bytes of many values at a time, values of like length together."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order, out, i = np.argsort(sizes, kind="stable"), np.full(len(values), FNV_OFFSET, np.uint64), 0
    while i < len(order):
        n = 1
        while i + n < len(order) and n < rows and (n + 1) * sizes[order[i + n]] <= room:
            n += 1
        part = order[i : i + n]
        longest = int(sizes[part[-1]])
        table = np.zeros((longest, n), np.uint8)
        for k, at in enumerate(part.tolist()):
            table[: sizes[at], k] = np.frombuffer(values[at], np.uint8)
        h = np.full(n, FNV_OFFSET, np.uint64)
        first = np.searchsorted(sizes[part], np.arange(1, longest + 1)).tolist()  # of those that have a j-th byte
        for j in range(longest):
            live = h[first[j] :]
            live ^= table[j, first[j] :]
            live *= np.uint64(FNV_PRIME)
        out[part] = h
        i += n
    return out


def fnv_blocks(data: bytes) -> int:
    """Over 8-byte little-endian words of each zero-padded block, all blocks at once, then over the blocks' hashes."""
    n = max(1, -(-len(data) // FNV_BLOCK))
    words = np.frombuffer(data.ljust(n * FNV_BLOCK, b"\0"), "<u8").reshape(n, -1)
    used = -(-min(len(data), FNV_BLOCK) // 8) if n == 1 else words.shape[1]
    h = np.full(n, FNV_OFFSET, np.uint64)
    for j in range(used):
        h = (h ^ words[:, j]) * np.uint64(FNV_PRIME)
    out = FNV_OFFSET
    for x in h.tolist():
        out = (out ^ x) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return out


def joined(parts: str, order: str, data: str) -> Column:
    """The bytes of an array of structs in order of a field: joined as hexadecimal text, so that the work is linear in the bytes."""
    return F.unhex(F.array_join(F.transform(F.array_sort(F.transform(parts, lambda p: F.struct(p[order], p[data]))), lambda p: F.hex(p[data])), ""))


def fnv1a_hex(column: str) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        some = values.notna()
        out = pd.Series([None] * len(values), dtype=object)
        out[some.to_numpy()] = [f"{h:016x}" for h in fnv1a_many([bytes(v) for v in values[some]]).tolist()]
        return out

    return run(column)


def fnv_blocks_hex(column: str) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f"{fnv_blocks(bytes(v)):016x}")

    return run(column)
