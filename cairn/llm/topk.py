"""Exact top-k by integer inner product, with a three-phase uniform threshold.

A vector's dimensions form ``m`` lists; a row's score is the sum of its m partial scores.  Rows lie in
blocks of near ones: each block is a score list, led by its centre and, for every list of dimensions,
its radius, which bound the partial scores of its rows for any query from above.

1. Gather: in each task every query takes the ``first`` blocks with the highest bounds and the whole
   scores of their rows; the k best of each task go on.  The k-th best of all of them is a safe
   cutoff: k rows reach it.
2. Collect: the cutoffs are broadcast.  A block in which no partial score can reach cutoff / m, or
   whose bounds don't sum up to the cutoff, holds no row of the result, and is not looked at; in the
   others, rows with a partial score of cutoff / m or more in some list are sufficient entries.
3. Resolve: the collected rows' whole scores are completed exactly; those that reach the cutoff
   compete, by score and then smaller id.

Queries are broadcast in groups of a bounded size, each with a pass over the rows where they lie: rows
are never copied, and what is sent on is bounded by k for each query, task and phase.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named, stage, table, unstage

FOUND = "query_id long, vec_id long, score long"
ROWS = "ids binary, data binary, width int, pivot int, centre binary, radius binary, top double"
_EXACT, _LEAST = 1 << 52, -(1 << 63)


def _quantised(column: pa.ListArray, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors take part, and their components as floor(scale * x); a null or non-finite component rules a vector out."""
    keep, rows = [], []
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64) if len(column) else np.zeros(0)
    nulls = np.asarray(column.flatten().is_null()) if len(column) else np.zeros(0, bool)
    sizes = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    good = np.isfinite(flat) & ~nulls
    valid = np.asarray(column.is_valid())
    bad = np.concatenate([[0], np.cumsum(~good)])
    whole = np.floor(np.where(good, flat, 0.0) * scale)
    for i in np.flatnonzero(valid).tolist():
        a, b = ends[i] - sizes[i], ends[i]
        if bad[a] == bad[b]:
            keep.append(i)
            rows.append(whole[a:b])
    return np.array(keep, np.int64), rows


def _lists(width: int, m: int) -> list[slice]:
    return [slice(j, width, min(m, max(1, width))) for j in range(min(m, max(1, width)))]


def _bytes(x: np.ndarray, top: float) -> bytes:
    """Whole numbers under 2**24 are exact in half the room."""
    return x.astype("<f4" if top < 1 << 24 else "<f8").tobytes()


def _matrix(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * n * width else "<f8").astype(np.float64).reshape(n, width)


def _packed(scale: int, size: int, m: int, pivots: Broadcast | None, buffer: int = 1 << 16):
    """Blocks of at most ``size`` vectors, near ones together: a task's rows are dealt by their nearest pivot, ``buffer`` rows at a time."""

    def blocks(ids: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        width = data.shape[1]
        own = None if pivots is None else pivots.value.get(width)
        near = np.zeros(len(ids), np.int64)
        if own is not None and width:
            half = (own * own).sum(1) / 2
            for i in range(0, len(data), 4096):
                near[i : i + 4096] = (data[i : i + 4096] @ own.T - half).argmax(1)
        for pivot in np.unique(near).tolist():
            of = np.flatnonzero(near == pivot)
            for i in range(0, len(of), size):
                x = data[of[i : i + size]]
                centre = x.mean(0)
                radius = np.array([np.sqrt(((x[:, s] - centre[s]) ** 2).sum(1).max()) for s in _lists(width, m)])
                top = float(np.abs(x).max(initial=0))
                values = [np.asarray(ids[of[i : i + size]], "<i8").tobytes(), _bytes(x, top), width, pivot, centre.tobytes(), radius.tobytes(), top]
                kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in ROWS.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        n = 0
        for batch in batches:
            keep, rows = _quantised(batch.column(1), scale)
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))[keep] if len(keep) else keep
            for i, row in zip(ids.tolist(), rows, strict=True):
                own = held.setdefault(len(row), ([], []))
                own[0].append(i)
                own[1].append(row)
            n += len(rows)
            if n >= buffer:
                for own in held.values():
                    yield from blocks(np.array(own[0], np.int64), np.stack(own[1]))
                held, n = {}, 0
        for own in held.values():
            yield from blocks(np.array(own[0], np.int64), np.stack(own[1]))

    return pack


def _whole(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products by Python's integers, for numbers that doubles don't hold."""
    whole = lambda a: np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape)
    out = whole(queries) @ whole(rows).T
    if any(abs(x) >= 1 << 63 for x in out.ravel()):
        raise OverflowError("a score does not fit a long")
    return out.astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and then smaller id."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


class Block:
    """A block of rows as staged."""

    def __init__(self, row: dict) -> None:
        self.ids, self.width, self.top = np.frombuffer(row["ids"], "<i8"), row["width"], row["top"]
        self.rows = _matrix(row["data"], len(self.ids), self.width)
        self.centre, self.radius = np.frombuffer(row["centre"], np.float64), np.frombuffer(row["radius"], np.float64)

    def bounds(self, queries: np.ndarray, m: int) -> np.ndarray:
        """(list, query): no partial score of a row here is higher; more is added than rounding can take."""
        out = []
        for s, r in zip(_lists(self.width, m), self.radius, strict=True):
            part, centre = queries[:, s], self.centre[s]
            norm = np.sqrt((part * part).sum(1))
            out.append(part @ centre + r * norm + 1e-9 * norm * (r + np.sqrt((centre * centre).sum())) + 1e-6)
        return np.stack(out)

    def scores(self, queries: np.ndarray, top: float) -> np.ndarray:
        if top * self.top * max(1, self.width) < _EXACT:
            return np.rint(queries @ self.rows.T).astype(np.int64)
        return _whole(queries, self.rows)


class Best:
    """The k best of every query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def add(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        if old := self.held.get(q):
            ids, score = np.concatenate([old[0], ids]), np.concatenate([old[1], score])
        at = _best(score, ids, self.k)
        self.held[q] = ids[at], score[at]

    def rows(self) -> pa.RecordBatch:
        none = [np.zeros(0, np.int64)]
        sizes = [len(x[0]) for x in self.held.values()]
        q = np.repeat(np.fromiter(self.held, np.int64, len(self.held)), sizes) if self.held else none[0]
        columns = [q, *(np.concatenate([*(x[i] for x in self.held.values()), *none]).astype(np.int64) for i in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _gather(k: int, m: int, first: int, shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, chosen = Best(k), {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                if block.width not in shared.value:
                    continue
                ids, queries, top = shared.value[block.width]
                bound = block.bounds(queries, m).sum(0)
                least = chosen.setdefault(block.width, np.full((first, len(ids)), -np.inf))
                at = np.flatnonzero(bound > least[0])  # among the highest bounds that this task has met so far
                if not len(at):
                    continue
                least[0, at] = bound[at]
                least.sort(axis=0)
                for i, score in zip(at.tolist(), block.scores(queries[at], top), strict=True):
                    other = block.ids != ids[i]
                    best.add(int(ids[i]), block.ids[other], score[other])
        yield best.rows()

    return run


def able(bound: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Queries whose cutoff a row under these bounds may reach: some list must reach its share, and all lists together the whole."""
    low = cut - 1e-9 * np.abs(cut)
    return np.flatnonzero((bound.sum(0) >= low) & (bound >= low / len(bound)).any(0))


def _collect(k: int, m: int, shared: Broadcast, cutoffs: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                if block.width not in shared.value:
                    continue
                ids, queries, top = shared.value[block.width]
                cut = cutoffs.value[block.width]
                lists = _lists(block.width, m)
                bound = block.bounds(queries, m)
                at = able(bound, cut)
                if not len(at):
                    continue
                exact = top * block.top * max(1, block.width) < _EXACT
                parts = [queries[at][:, s] @ block.rows[:, s].T for s in lists] if exact else None
                whole = None if exact else block.scores(queries[at], top)
                for j, i in enumerate(at.tolist()):
                    if exact:
                        enough = reduce(np.logical_or, (p[j] >= cut[i] / len(lists) for p in parts))
                        rows = np.flatnonzero(enough & (block.ids != ids[i]))
                        score = np.rint(sum(p[j, rows] for p in parts)).astype(np.int64)
                    else:
                        rows = np.flatnonzero(block.ids != ids[i])
                        score = whole[j, rows]
                    good = score >= cut[i]
                    if good.any():
                        best.add(int(ids[i]), block.ids[rows[good]], score[good])
        yield best.rows()

    return run


def _groups(rows: Iterator, size: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, float]]]:
    """Packed queries by width, at most ``size`` bytes at a time (one block at least)."""
    held: dict[int, list] = {}
    used = 0

    def made() -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        out = {}
        for width, parts in held.items():
            own = [np.frombuffer(p[0], "<i8") for p in parts]
            ids, data = np.concatenate(own), np.concatenate([_matrix(p[1], len(o), width) for o, p in zip(own, parts, strict=True)])
            out[width] = ids, data, float(np.abs(data).max(initial=0))
        return out

    for row in rows:
        if used and used + len(row["ids"]) * (1 + row["width"]) > size:
            yield made()
            held, used = {}, 0
        held.setdefault(row["width"], []).append((row["ids"], row["data"]))
        used += len(row["ids"]) * (1 + row["width"])
    if held:
        yield made()


def _pivots(vectors: DataFrame, scale: int, n: int) -> dict[int, np.ndarray]:
    """Up to ``n`` vectors of each of the few commonest widths, picked evenly by hash: they only say which rows lie in one block."""
    picked = vectors.filter("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()  # n rows
    out: dict[int, list] = {}
    for r in picked:
        x = np.array([np.nan if v is None else v for v in r["embedding"]], np.float64)
        if np.isfinite(x).all():
            out.setdefault(len(x), []).append(np.floor(x * scale))
    return {width: np.stack(rows) for width, rows in out.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, m: int = 4, scale: int = 1024, block: int = 256, first: int = 2, n_pivots: int = 64, group_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` highest scores among all other rows.

    ``vectors`` and ``queries`` are (vec_id, embedding).  Fewer rows than k give fewer ranks.  Vectors
    that are null, of null id, or hold null or non-finite components take no part; nor do pairs of
    different lengths.  Rows with a query's own id are not its candidates; rows that share an id are
    candidates each on their own.  Query rows that share an id are one query: of all pairs of theirs
    the k best, a pair for each row.  A score beyond a long raises.  ``group_bytes`` bounds the
    queries that the driver holds and broadcasts at a time.
    """
    spark = vectors.sparkSession
    pick = lambda df: named(df, vec_id="vec_id", embedding="embedding").filter(F.col("vec_id").isNotNull())
    asked = stage(pick(queries).mapInArrow(_packed(scale, 1024, m, None), ROWS).select("ids", "data", "width"), "queries")
    pivots = spark.sparkContext.broadcast(_pivots(pick(vectors), scale, n_pivots))
    rows = stage(pick(vectors).mapInArrow(_packed(scale, block, m, pivots), ROWS), "rows")
    found = spark.createDataFrame([], FOUND)
    for group in _groups(asked.orderBy("width", "ids").toLocalIterator(), group_bytes):
        shared = spark.sparkContext.broadcast(group)
        gathered = rows.mapInArrow(_gather(k, m, first, shared), FOUND)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        kth = gathered.withColumn("place", place).filter(F.col("place") == k).select("query_id", "score")
        cut = dict(kth.collect())  # a row for each query of the group at most
        cutoffs = spark.sparkContext.broadcast({w: np.array([cut.get(i, _LEAST) for i in ids.tolist()], np.int64) for w, (ids, _, _) in group.items()})
        found = found.union(stage(rows.mapInArrow(_collect(k, m, shared, cutoffs), FOUND), "found"))
        shared.destroy()
        cutoffs.destroy()
    # A query id that several rows share may come from several groups.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    unstage(asked, rows)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every row whose id is divisible by 100, among all other rows of whole ``embeddings``."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0))
