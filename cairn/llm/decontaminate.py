"""Benchmark decontamination by SimHash of item-sized windows.

1. Shingle weights come from the document frequencies of all items, before any blocking, in a table
   of fixed size; so a window's similarity to an item depends on no other choice.
2. Every window of a document that is as long as an item, at any word, is weighed by running sums.
   A window in which the shingles of items weigh too little can't reach the threshold with any item,
   and ends there; that bound loses nothing.  All others get a 64-bit SimHash by running sums of
   signed bits, whole slices of texts at a time.
3. A multi-index over the items' fingerprints, four blocks of 16 bits, each probed within
   ``RADIUS // 4`` flips, holds every item of the window's size within ``RADIUS`` bits.
4. Those candidates are verified by the weighted Jaccard similarity of whole shingle multisets.

Items go to the tasks ``block`` at a time (or ``block_chars`` characters, if that is fewer), which
bounds what the driver holds and broadcasts; more items mean more passes.  Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, slices, stage, table, unstage
from .near_dups import WORDS, Shingler, _mixer, mix, weights

RADIUS, BLOCKS, BITS = 19, 4, 16
FOUND = "doc_id long, item_id long, start_word long, n_words int, distance int, similarity double"
_bits = np.array([bin(i).count("1") for i in range(1 << BITS)], np.uint8)
_flips = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS), k)], np.int64)
_SPAN = 1 << 14


def rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    n = max(0, len(hashes) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = out * _mixer + hashes[k : n + k]
    return mix(out)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ b).astype("<u8")
    return _bits[x.view("<u2").reshape(*x.shape, 4)].sum(-1)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, then the same of the next, and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def multiset(shingles: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, with their weights times frequencies."""
    h, n = np.unique(shingles, return_counts=True)
    return h, weight[(h >> np.uint64(46)).astype(np.int64)].astype(np.float64) * n


def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; of two without a shingle it is 0."""
    at = np.minimum(np.searchsorted(other[0], one[0]), max(0, len(other[0]) - 1))
    if not len(one[0]) or not len(other[0]):
        return 0.0
    both = np.minimum(one[1], np.where(other[0][at] == one[0], other[1][at], 0.0)).sum()
    return float(both / (one[1].sum() + other[1].sum() - both))


def fingerprints(shingles: np.ndarray, weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of the ``sizes`` shingles from each of ``starts`` (ascending), by running sums over spans of bounded length."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + _SPAN))
        a, b = starts[i:j], starts[i:j] + sizes[i:j]
        part = shingles[a[0] : b.max()]
        ones = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        heavy = np.rint(weight[(part >> np.uint64(46)).astype(np.int64)] * 1024).astype(np.int64)
        sums = np.zeros((len(part) + 1, 64), np.int64)
        np.cumsum((2 * ones - 1) * heavy[:, None], axis=0, out=sums[1:])
        out[i:j] = np.packbits(sums[b - a[0]] > sums[a - a[0]], axis=1, bitorder="little").view("<u8")[:, 0]
        i = j
    return out


class Items:
    """Shingles, fingerprints and index of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str], weight: np.ndarray, words: int = WORDS) -> None:
        hashes, counts = Shingler(words).word_hashes(texts)
        ends = np.cumsum(counts)
        self.words, self.ids, self.counts, self.weight = words, ids, counts.astype(np.int64), weight
        shingles = [rolled(hashes[e - n : e], min(words, n)) if n else np.zeros(0, np.uint64) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        self.sets = [multiset(s, weight) for s in shingles]
        self.totals = np.array([w.sum() for _, w in self.sets])
        one = np.zeros(1, np.int64)
        self.prints = np.array([fingerprints(s, weight, one, one + len(s))[0] for s in shingles] or [], np.uint64)
        self.index = []
        for j in range(BLOCKS):
            value = self._block(self.prints, j)
            order = np.argsort(value, kind="stable")
            self.index.append((order, np.searchsorted(value[order], np.arange((1 << BITS) + 1))))
        #: By number of words a shingle has: known shingles with a bitmap over their hashes, the sizes of items that hold
        #: each, and for every size the least weight of an item.
        self.groups = {}
        for m in {min(words, n) for n in self.counts.tolist() if n}:
            of = np.flatnonzero(np.minimum(self.counts, words) == m)
            sizes, place = np.unique(self.counts[of], return_inverse=True)
            h, at = np.concatenate([shingles[i] for i in of]), np.repeat(place, [len(shingles[i]) for i in of])
            order = np.lexsort((at, h))
            h, at = h[order], at[order]
            new = np.concatenate([[True], (np.diff(at) != 0) | (h[1:] != h[:-1])])
            h, at = h[new], at[new]
            known, first = np.unique(h, return_index=True)
            seen = np.zeros(1 << 20, bool)
            seen[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
            least = [(int(n), float(self.totals[of][self.counts[of] == n].min())) for n in sizes]
            self.groups[m] = seen, known, np.append(first, len(h)), at, least

    @staticmethod
    def _block(prints: np.ndarray, j: int) -> np.ndarray:
        return ((prints >> np.uint64(BITS * j)) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, item) of all that are within RADIUS bits: in one of the blocks they are then within RADIUS // BLOCKS."""
        pairs = [np.zeros(0, np.int64)]
        n_items = max(1, len(self.ids))
        for i in range(0, len(prints), 1024):
            part = prints[i : i + 1024]
            for j, (order, offsets) in enumerate(self.index):
                value, back = np.unique(self._block(part, j), return_inverse=True)
                probe = value[:, None] ^ _flips[None, :]
                n = offsets[probe + 1] - offsets[probe]
                items = order[_spread(offsets[probe].ravel(), n.ravel())]
                n = n.sum(1)
                at = _spread((np.cumsum(n) - n)[back], n[back])
                window, item = np.repeat(np.arange(len(part)), n[back]), items[at]
                near = hamming(part[window], self.prints[item]) <= RADIUS
                pairs.append((window[near] + i) * n_items + item[near])
        found = np.unique(np.concatenate(pairs))
        return found // n_items, found % n_items

    def matches(self, hashes: np.ndarray, counts: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, int, float]]:
        """(text, item, start, words, distance, similarity) of the best window of each item in each text, of equal ones the first.

        ``hashes`` are the words of texts one after another, ``counts`` the texts' numbers of words.
        """
        ends = np.cumsum(counts)
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for m, group in self.groups.items():
            for text, item, start, size, distance, similar in self._matches(hashes, ends, ends - counts, m, group, threshold):
                old = best.get((text, item))
                if old is None or (similar, -start) > (old[0], -old[1]):
                    best[text, item] = similar, start, size, distance
        return [(text, item, start, size, distance, similar) for (text, item), (similar, start, size, distance) in sorted(best.items())]

    def windows(self, hashes: np.ndarray, ends: np.ndarray, begins: np.ndarray, m: int, group: tuple, threshold: float):
        """Windows that may reach the threshold: (first word, words, shingles' place, whole text?), and the shingles they point into.

        What a window shares with an item of its size weighs no more than its shingles that are in
        any item of that size, and both together no less than the heavier one, so windows under the
        threshold by that are left out.
        """
        seen, known, first_of, sizes_of, sizes = group
        r = rolled(hashes, m)
        at = np.flatnonzero(seen[(r & np.uint64(0xFFFFF)).astype(np.int64)])
        which = np.minimum(np.searchsorted(known, r[at]), len(known) - 1)
        text = np.searchsorted(ends, at, "right")
        good = (known[which] == r[at]) & (at + m <= ends[np.minimum(text, len(ends) - 1)])
        at, which, text = at[good], which[good], text[good]
        if not len(at):
            return None
        longest = sizes[-1][0]
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, np.maximum(at - (longest - m), begins[text]), 1)
        np.add.at(cover, np.minimum(at + longest, ends[text]), -1)
        words = np.flatnonzero(np.cumsum(cover[:-1]) > 0)  # all windows with a known shingle lie in these
        owner = np.searchsorted(ends, words, "right")
        run = np.cumsum(np.concatenate([[0], (np.diff(words) != 1) | (np.diff(owner) != 0)]))
        r = rolled(hashes[words], m)
        w = self.weight[(r >> np.uint64(46)).astype(np.int64)].astype(np.float64)
        every = np.concatenate([[0.0], np.cumsum(w)])
        place = np.searchsorted(words, at)
        n_sizes = first_of[which + 1] - first_of[which]
        of_size = sizes_of[_spread(first_of[which], n_sizes)]
        order = np.argsort(of_size, kind="stable")
        by_size = np.repeat(place, n_sizes)[order]
        bounds = np.searchsorted(of_size[order], np.arange(len(sizes) + 1)).tolist()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]

        def keep(start: np.ndarray, size: np.ndarray | int, hit: np.ndarray, least: np.ndarray | float, whole: bool) -> None:
            own = np.zeros(len(w) + 1)
            own[hit + 1] = w[hit]
            np.cumsum(own, out=own)
            n = size - m + 1
            good = own[start + n] - own[start] >= threshold * np.maximum(every[start + n] - every[start], least) - 1e-6
            start, size = start[good], np.broadcast_to(size, start.shape)[good]
            out.append((start, size, np.full(len(start), whole)))

        for k, (size, least) in enumerate(sizes):
            if bounds[k] < bounds[k + 1]:
                start = np.arange(max(0, len(words) - size + 1))
                keep(start[run[start] == run[start + size - 1]], size, by_size[bounds[k] : bounds[k + 1]], least, False)
        short = np.unique(text[ends[text] - begins[text] < longest])  # shorter than some item: the whole text is a window
        if len(short):
            n = ends[short] - begins[short]
            least = np.array([min(x for s, x in sizes if s > k) for k in n.tolist()])
            keep(np.searchsorted(words, begins[short]), n, place, least, True)
        start, size, whole = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], size[order], whole[order], r, words, owner

    def _matches(self, hashes: np.ndarray, ends: np.ndarray, begins: np.ndarray, m: int, group: tuple, threshold: float):
        found = self.windows(hashes, ends, begins, m, group, threshold)
        if found is None:
            return
        start, size, whole, r, words, owner = found
        prints = fingerprints(r, self.weight, start, size - m + 1)
        window, item = self.candidates(prints)
        fits = (self.counts[item] == size[window]) | whole[window] & (self.counts[item] > size[window])
        fits &= np.minimum(self.counts[item], self.words) == m
        window, item = window[fits], item[fits]
        distance = hamming(prints[window], self.prints[item])
        last, held = -1, None
        for k, i, d in zip(window.tolist(), item.tolist(), distance.tolist(), strict=True):
            s, n = int(start[k]), int(size[k])
            if k != last:
                last, held = k, multiset(r[s : s + n - m + 1], self.weight)
            similar = similarity(held, self.sets[i])
            if similar >= threshold - 1e-9:
                text = int(owner[s])
                yield text, i, int(words[s] - begins[text]), n, d, similar


def _blocks(benchmark: DataFrame, words: int, block: int, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast blocks of items, each with whether it is the only one; the caller is done with one before the next is made."""
    spark = benchmark.sparkSession
    items = named(benchmark, item_id="item_id", text="text").filter("text is not null").select("item_id", "text")
    weight = weights(items, words, 1.0)  # over all items: of a fixed size
    numbered = stage(items.orderBy("item_id", "text"), "items")
    rows, chars, made = [], 0, 0
    for row in numbered.toLocalIterator():
        if rows and (len(rows) >= block or chars + len(row["text"]) > block_chars):
            yield spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], weight, words)), False
            rows, chars, made = [], 0, made + 1
        rows.append(row)
        chars += len(row["text"])
    yield spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], weight, words)), not made
    unstage(numbered)


def _hits(batches: Iterator[pa.RecordBatch], known: Items, threshold: float) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    shingler = Shingler(known.words)
    for batch, texts in slices(batches, rows=512, chars=2_000_000):
        yield batch, known.matches(*shingler.word_hashes(texts), threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, words: int = WORDS, block: int = 20_000, block_chars: int = 32_000_000) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity) of every row of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it holds.

    An item is held where a window of as many words (the whole text, if that has fewer) is similar by
    ``threshold`` or more; the row shows the most similar window, of equal ones the first.  Texts are
    compared as lower-case words.  Null and empty texts and items without a word match nothing.
    Items of under ``words`` words are one shingle.  Equal items are each reported, and rows that
    share a doc_id, or have none, each give their own result.  Very long texts are searched whole.
    """
    found = []
    for shared, alone in _blocks(benchmark, words, block, block_chars):

        def search(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64())
            for batch, hits in _hits(batches, known, threshold):
                columns = list(zip(*hits, strict=True)) if hits else [[]] * 6
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in columns[0]], pa.int64()), pa.array([known.ids[i] for i in columns[1]], pa.int64())]
                    + [pa.array(c, t) for c, t in zip(columns[2:], kinds, strict=True)],
                    ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"],
                )

        scan = named(docs, doc_id="doc_id", text="text").mapInArrow(search, FOUND)
        if not alone:
            scan = stage(scan, "leaks")
            shared.destroy()
        found.append(scan)
    return reduce(DataFrame.union, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, words: int = WORDS, block: int = 20_000, block_chars: int = 32_000_000) -> DataFrame:
    """``docs`` without the rows whose text holds an item, decided row by row: repeated and null ids are no matter.  All columns stay."""
    kept, schema = docs, docs.schema
    for shared, alone in _blocks(benchmark, words, block, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch, hits in _hits(batches, shared.value, threshold):
                bad = {h[0] for h in hits}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        rest = kept.mapInArrow(clean, schema)
        if not alone:
            rest = stage(rest, "clean")
            shared.destroy()
            if kept is not docs:
                unstage(kept)
        kept = rest
    return kept


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, over whole ``documents`` and ``benchmark``."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
