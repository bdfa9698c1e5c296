"""Token counts without ids: pieces are counted once for each distinct pre-token.

The vocabulary has no piece in which a character stands before a word mark, so no merge crosses
the space between two words, and a text's count is the sum over its pre-tokens.

* A pass over the texts gives, for each block of documents, its distinct pre-tokens and their
  posting lists of (document in block, frequency), packed by hash bucket of the pre-token.
* A bucket's pre-tokens meet in one task.  The library counts each distinct one once, and the
  counts are joined to the postings; products are added up by document within the task.
* The partial sums, one vector for each task and block, are added up by block.

Token ids are never made, and what is shuffled is packed bytes: a row for each block and bucket,
then one for each block and task.  A pre-token of very many documents would fill its bucket; in
blocks where it has over ``HEAVY`` postings it is dealt over the buckets by block, and counted once
in each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _Ids, named, slices, table

_cut = re.compile("(?<=[^ ▁]) ")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first space; an empty text has none."""
    if not text:
        return []
    if "  " in text or "▁" in text or text[0] == " ":
        return _cut.split(text)
    return text.split(" ")


_models: dict = {}


def _model(path: str | None):
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


PACKED = "bucket long, block long, data binary, ids array<long>, sizes array<long>"
_packed = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
HEAVY = 1000


def _blob(*arrays: np.ndarray) -> bytes:
    head = np.array([x.nbytes for x in arrays], "<u8").tobytes()
    return zstandard.compress(head + b"".join(x.tobytes() for x in arrays), 3)


def _unblob(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, "<u8", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _take_strings(tokens: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte lengths and bytes of the chosen strings."""
    part = tokens.take(pa.array(at))
    ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
    return np.diff(ends).astype("<u4"), np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _post(buckets: int):
    """(doc_id, text, n_bytes) to PACKED rows: postings by bucket, and the documents of each block."""

    def block_rows(block: int, words: list[str], got: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        counts = np.fromiter(map(len, got), np.int64, len(got))
        key = np.concatenate([*got, np.zeros(0, np.int64)]) * 65536 + np.repeat(np.arange(len(got)), counts)
        key, freq = np.unique(key, return_counts=True)
        if (freq > 65535).any():  # in several postings
            times = -(-freq // 65535)
            key, last, whole = np.repeat(key, times), np.cumsum(times) - 1, np.full(times.sum(), 65535)
            whole[last] = freq - 65535 * (times - 1)
            freq = whole
        n_post = np.bincount(key >> 16, minlength=len(words))
        first = np.cumsum(n_post) - n_post
        hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
        bucket = ((hashed + np.where(n_post > HEAVY, np.uint64(block % buckets), np.uint64(0)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        tokens = pa.array(words, pa.string())
        alphabetic = np.asarray(pc.array_sort_indices(tokens), np.int64)  # neighbours compress well
        order = alphabetic[np.argsort(bucket[alphabetic], kind="stable")]
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            at = order[bounds[b] : bounds[b + 1]]
            n = n_post[at]
            ends = np.cumsum(n)
            places = np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1])
            rows.append((b, _blob(*_take_strings(tokens, at), n.astype("<u4"), (key[places] & 65535).astype("<u2"), freq[places].astype("<u2"))))
        for i in range(0, len(rows), 256):
            bs, data = zip(*rows[i : i + 256], strict=True)
            none = pa.nulls(len(bs), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(bs, pa.int64()), pa.array([block] * len(bs), pa.int64()), pa.array(data, pa.binary()), none, none], schema=_packed)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        doc_ids, sizes, got, chars, words = [], [], [], 0, _Ids()

        def flush() -> Iterator[pa.RecordBatch]:
            block = (task << 24) + made
            yield from block_rows(block, list(words), got)
            yield pa.RecordBatch.from_arrays([pa.array([block % buckets], pa.int64()), pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))], schema=_packed)

        for batch, texts in slices(batches):
            doc_ids += batch.column(0).to_pylist()
            sizes += batch.column(2).to_pylist()
            for text in texts:
                units = pre_tokens(text)
                got.append(np.fromiter(map(words.__getitem__, units), np.int64, len(units)))
                chars += len(text)
            words.new.clear()
            if chars > 32_000_000 or len(got) > 60_000:
                yield from flush()
                made += 1
                doc_ids, sizes, got, chars, words = [], [], [], 0, _Ids()
        if got:
            yield from flush()

    return post


_sums = pa.schema([("block", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def _count(path: str | None):
    """PACKED rows of some buckets to the partial sums of each block's documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo, known, held = _model(path), _Ids(), np.zeros(0, np.int64), {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_blob(sums)], pa.binary()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], schema=_sums)

        for batch in batches:
            for i, (block, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if data is None:
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), batch.column(3).slice(i, 1), batch.column(4).slice(i, 1)], schema=_sums)
                    continue
                sizes, raw, n_post, doc, freq = _unblob(data, "<u4", "u1", "<u4", "<u2", "<u2")
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).to_pylist()
                at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                if memo.new:
                    # The library gives nothing for an empty text; the pre-token stands for a last single space.
                    n = [len(x) if w else 1 for w, x in zip(memo.new, model.encode(memo.new, num_threads=1), strict=True)]
                    known = np.concatenate([known[: len(memo) - len(n)], np.array(n, np.int64)])
                    memo.new.clear()
                sums = np.bincount(doc, np.repeat(known[at], n_post) * freq.astype(np.int64)).astype(np.int64)
                old = held.get(block)
                if old is not None and len(old) > len(sums):
                    sums, old = old, sums
                if old is not None:
                    sums[: len(old)] += old
                held[block] = sums
                if len(memo) > 1_500_000:
                    memo, known = _Ids(), known[:0]
            if len(held) > 500:
                yield from out()
                held = {}
        yield from out()

    return count


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks' partial sums and documents to (doc_id, n_bytes, n_tokens)."""
    held: dict[int, np.ndarray] = {}
    docs: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["data"] is None:
                docs[row["block"]] = row["ids"], row["sizes"]
                continue
            (sums,) = _unblob(row["data"], "<i8")
            old = held.get(row["block"], np.zeros(0, np.int64))
            total = np.zeros(max(len(sums), len(old)), np.int64)
            total[: len(sums)] += sums
            total[: len(old)] += old
            held[row["block"]] = total
    for block, (ids, sizes) in docs.items():
        total = np.zeros(len(ids), np.int64)
        sums = held.get(block, total)
        total[: len(sums)] = sums
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, limit: int = 4096, model: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    Null texts are empty; empty texts have no tokens.  Rows that share a doc_id are counted apart.
    The rows of ``docs`` must come in the same order when a lost task is run again, as from files.
    """
    docs = named(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(_post(buckets), PACKED)
    sums = posts.repartition("bucket").mapInArrow(_count(model), "block long, data binary, ids array<long>, sizes array<long>")
    return sums.repartition("block").mapInArrow(_add, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
