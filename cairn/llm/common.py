"""Helpers that the training-data operators share: reading, staging, worker-side tokenizer caches."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..staging import stage, unstage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed; whatever else the table holds can't clash with an operator's own names."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 2048, chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch in slices of bounded rows and characters (one row at least), with the texts; null texts are empty."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, size = [], 0
            column = batch.column(batch.schema.get_field_index(text))
            while at + len(texts) < batch.num_rows and len(texts) < rows and (size < chars or not texts):
                texts.append(column[at + len(texts)].as_py() or "")
                size += len(texts[-1])
            yield batch.slice(at, len(texts)), texts
            at += len(texts)


class _Ids(dict):
    """A number for every key, in order of appearance; ``new`` lists keys not yet processed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class ByteBpe:
    """Ids of the ``tokenizers`` library for whole texts, each distinct word encoded once for each worker.

    The vocabulary's split pattern always cuts before a space, and around a line break, that stands
    between two characters that are not white space; so the words between such cuts are encoded
    independently of each other, and the ids of a text are those of its words in order.  Special
    strings hold no white space and stay inside a word.  New words go to the library many at a time,
    a line each; what has white space inside goes alone.

    Keys: ``foo`` is the word after a space, ``\\nfoo`` the word after a line break, and a text that
    starts with a space is encoded as it stands after that space.  The cache holds about ``limit``
    words; beyond that, those seen once go.
    """

    _near = re.compile(r"\s\s")
    _cut = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str, limit: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._odd = re.compile("|".join([r"[^\S \n]", *specials]))
        (self.line_break,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.memo, self.n, self.used = _Ids(), 0, 0
        self.flat, self.size, self.first, self.hits = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _evict(self) -> None:
        keep = np.flatnonzero(self.hits[: self.n] > 1)
        keys, memo = list(self.memo), _Ids()
        memo.update({keys[i]: j for j, i in enumerate(keep.tolist())})
        sizes = self.size[keep]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        self.flat[:total] = self.flat[np.repeat(self.first[keep] - (ends - sizes), sizes) + np.arange(total)]
        self.size[: len(keep)], self.first[: len(keep)], self.hits[: len(keep)] = sizes, ends - sizes, 1
        self.memo, self.n, self.used = memo, len(keep), total

    def _put(self, places: list[int], ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        """Keep ``ids``; the word at each place has ``sizes`` of them from ``first``."""
        self.flat = self._room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[places], self.size[places] = first + self.used, sizes
        self.used += len(ids)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_new(self) -> None:
        keys, self.memo.new = self.memo.new, []
        self.size, self.first, self.hits = (self._room(a, self.n + len(keys)) for a in (self.size, self.first, self.hits))
        self.hits[self.n : self.n + len(keys)] = 0
        for i in range(0, len(keys), 8192):
            spaced, broken, alone = [], [], []
            for j, key in enumerate(keys[i : i + 8192], i):
                (alone if key[0] == " " else broken if key[0] == "\n" else spaced).append(j)
            for group, lead in ((spaced, " "), (broken, "")):
                words = [lead + keys[j] for j in group] if lead else [keys[j][1:] for j in group]
                text = "\n".join(words)
                if self._odd.search(text) or "" in words:
                    odd = [not w or bool(self._odd.search(w)) for w in words]
                    alone += [j for j, x in zip(group, odd, strict=True) if x]
                    group, words = [j for j, x in zip(group, odd, strict=True) if not x], [w for w, x in zip(words, odd, strict=True) if not x]
                    text = "\n".join(words)
                if group:
                    ids = self._ids("\n" + text)  # every word after a line break
                    at = np.flatnonzero(ids == self.line_break)
                    if len(at) != len(group):
                        raise ValueError("a word was not encoded on its own line")
                    first = at if group is broken or not lead else at + 1
                    self._put([self.n + j for j in group], ids, first, np.diff(np.concatenate([at, [len(ids)]])) - (first - at))
            if alone:
                words = [keys[j][1:] if keys[j][0] == " " else keys[j] if keys[j][0] == "\n" else " " + keys[j] for j in alone]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                self._put([self.n + j for j in alone], np.array([x for one in ids for x in one], np.uint32), np.cumsum(sizes) - sizes, sizes)
        self.n += len(keys)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self.memo) > self.limit:
            self._evict()
        got, counts = [], []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            if self._near.search(text) or text[0].isspace() or text[-1].isspace():
                words = [" " + w for w in self._cut.split(text)]
            else:
                words = text.replace("\n", " \n").split(" ")
                words[0] = " " + words[0]
            got.append(np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        self._encode_new()
        if not got:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        at = np.concatenate(got)
        self.hits[: self.n] += np.bincount(at, minlength=self.n).astype(np.int32)
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(np.concatenate([[0], ends])[bounds])


_encoders: dict[str, ByteBpe] = {}


def release() -> None:
    """Free this worker's encoders: a task of another kind has its own use for the memory."""
    if _encoders:
        _encoders.clear()
        gc.collect()


def byte_bpe(path: str | None, limit: int = 600_000) -> ByteBpe:
    """This worker's encoder, holding about ``limit`` words; it lives as long as the worker, so later tasks find their words known."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    _encoders[path].limit = limit
    return _encoders[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    if end_id is None:
        return ids, sizes
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _word.findall(text.lower())


_word = re.compile(r"\w+")
