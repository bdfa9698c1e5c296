"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word, from characters and from the word: learned vectors of hashed word and hashed
character n-grams, and the log-odds of both among a sample of labelled documents.  Overlapping
windows of words run through a recurrent layer in each direction; attention pools a window's states
into one logit, and a document's score is its highest window's, calibrated to the labels' rates.

Labels belong to documents, not to windows, so training alternates: the window that now scores
highest, of the eight with the most evidence, stands for its document, the network learns from these,
and windows are chosen anew.  A document's log-odds come from other documents, and the score is
calibrated on documents that the network hasn't learned from.

The sample of labelled documents is bounded by rows and characters of each label, parameters of
:func:`train`; its texts are whole.  Scoring covers every window of every whole text, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _Ids, free_name, named, release, slices, table, words_of

T, STRIDE = 32, 16
TABLE, EMBED, DIM, HIDDEN = 1 << 18, 1 << 12, 4, 8
INPUTS = 2 * DIM + 3
STEPS, DECAY, LOOKED = 100, 0.03, 8  # least steps of learning in a round, decay of learned vectors, windows of a document to choose from


class Words:
    """Hashes and inputs of distinct words, computed once each."""

    def __init__(self, model: dict | None = None, limit: int = 300_000) -> None:
        self.model, self.limit = model, limit
        self.memo, self.n = _Ids(), 0
        self.x = np.zeros((1 << 12, INPUTS), np.float32)

    @staticmethod
    def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's hash; the hashes of its n-grams (4 and 5 characters with edge marks) one after another, and their number."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.cumsum(sizes)
        prime = np.uint64(0x9E3779B97F4A7C15)
        mixed = (code + np.uint64(1)) * prime
        mixed ^= mixed >> np.uint64(29)
        place = np.arange(len(code)) - np.repeat(ends - sizes, sizes)
        rolled = mixed * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1))
        word = np.add.reduceat(rolled, ends - sizes) if len(words) else np.zeros(0, np.uint64)
        owner, gram = np.repeat(np.arange(len(words)), sizes), []
        left = np.repeat(ends, sizes) - np.arange(len(code))
        for n in (4, 5):
            at = np.flatnonzero(left >= n) if n == 5 else np.flatnonzero((left >= n) | (place == 0) & (left >= 3))
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ mixed[np.minimum(at + k, len(mixed) - 1)] * (left[at] > k)
            gram.append((owner[at], h + np.uint64(n)))
        owners, grams = np.concatenate([g[0] for g in gram]), np.concatenate([g[1] for g in gram])
        order = np.argsort(owners, kind="stable")
        finish = lambda h: h ^ (h >> np.uint64(31))
        return finish(word * prime), finish(grams[order] * prime), np.bincount(owners, minlength=len(words))

    @staticmethod
    def inputs(words: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of words; with the places of their learned vectors, for training."""
        word, grams, n = Words.hashes(words)
        first = np.cumsum(n) - n
        spot = (grams >> np.uint64(40)).astype(np.int64) % TABLE
        odds = model["gram_odds"][spot]
        strongest = np.maximum.reduceat(odds, first) if len(words) else odds
        mean = np.add.reduceat(odds, first) / n if len(words) else odds
        # The n-gram with the strongest evidence gives the character vector.
        best = np.flatnonzero(odds == np.repeat(strongest, n))
        owner = np.repeat(np.arange(len(words)), n)[best]
        chosen = best[np.unique(owner, return_index=True)[1]]
        w_at, c_at = (word % np.uint64(EMBED)).astype(np.int64), (grams[chosen] % np.uint64(EMBED)).astype(np.int64)
        fixed = np.stack([model["word_odds"][(word >> np.uint64(40)).astype(np.int64) % TABLE], strongest, mean], 1).astype(np.float32)
        return np.concatenate([model["E_w"][w_at], model["E_c"][c_at], fixed], 1), w_at, c_at, fixed

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def compute(self) -> None:
        """Inputs of the words met since the last call; place 0 is padding."""
        new, self.memo.new = self.memo.new, []
        if self.n + len(new) > len(self.x):
            self.x = np.concatenate([self.x, np.zeros((max(len(new), len(self.x)), INPUTS), np.float32)])
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.x[self.n : self.n + len(part)] = self.inputs(part, self.model)[0]
            self.n += len(part)

    def trim(self) -> None:
        if len(self.memo) > self.limit:
            self.memo, self.n = _Ids(), 0


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; an empty text has one, empty."""
    last = max(0, n - T)
    starts = np.arange(0, last + 1, STRIDE)
    return starts if starts[-1] == last else np.append(starts, last)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _forward(x: np.ndarray, mask: np.ndarray, p: dict, keep: bool = False):
    """Logits of windows: x (T, B, INPUTS), mask (T, B)."""
    steps, b, _ = x.shape
    both = np.stack([x, x[::-1]])  # (2, T, B, INPUTS)
    gates = np.matmul(both.reshape(2, steps * b, -1), p["W"]).reshape(2, steps, b, 3 * HIDDEN) + p["b"][:, None, None, :]
    live = np.stack([mask, mask[::-1]]).astype(np.float32)[..., None]
    h = np.zeros((2, b, HIDDEN), np.float32)
    states, cache = np.empty((2, steps, b, HIDDEN), np.float32), []
    for t in range(steps):
        u = np.matmul(h, p["U"])
        zr = _sigmoid(gates[:, t, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        n = np.tanh(gates[:, t, :, 2 * HIDDEN :] + r * u[:, :, 2 * HIDDEN :])
        new = (n + z * (h - n)) * live[:, t] + h * (1 - live[:, t])
        if keep:
            cache.append((h, z, r, n, u[:, :, 2 * HIDDEN :]))
        h = new
        states[:, t] = h
    hidden = np.concatenate([states[0], states[1, ::-1]], -1)  # (T, B, 2 HIDDEN)
    e = hidden @ p["v"] + (mask - 1) * np.float32(1e4)
    a = np.exp(e - e.max(0))
    a = a / a.sum(0) * mask
    context = (a[..., None] * hidden).sum(0)
    logit = context @ p["u"] + p["c"]
    return (logit, (both, live, cache, hidden, a, context)) if keep else logit


def _backward(d_logit: np.ndarray, kept: tuple, p: dict) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of x."""
    both, live, cache, hidden, a, context = kept
    g = {"c": np.float32(d_logit.sum()), "u": context.T @ d_logit}
    d_context = d_logit[:, None] * p["u"]
    d_a = (hidden * d_context).sum(-1)
    d_e = a * (d_a - (a * d_a).sum(0))
    g["v"] = np.einsum("tb,tbh->h", d_e, hidden)
    d_hidden = a[..., None] * d_context + d_e[..., None] * p["v"]
    d_states = np.stack([d_hidden[..., :HIDDEN], d_hidden[::-1, :, HIDDEN:]])
    d_gates = np.zeros(both.shape[:3] + (3 * HIDDEN,), np.float32)
    g["U"] = np.zeros_like(p["U"])
    d_h = np.zeros_like(cache[0][0])
    for t in range(both.shape[1] - 1, -1, -1):
        h, z, r, n, un = cache[t]
        d_h = d_h + d_states[:, t]
        on = live[:, t]
        d_new = d_h * on
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (h - n) * z * (1 - z)
        d_r = d_n * un * r * (1 - r)
        d_u = np.concatenate([d_z, d_r, d_n * r], -1)
        d_gates[:, t] = np.concatenate([d_z, d_r, d_n], -1)
        g["U"] += np.matmul(h.transpose(0, 2, 1), d_u)
        d_h = d_h * (1 - on) + d_new * z + np.matmul(d_u, p["U"].transpose(0, 2, 1))
    flat = d_gates.reshape(2, -1, 3 * HIDDEN)
    g["W"] = np.matmul(both.reshape(2, flat.shape[1], -1).transpose(0, 2, 1), flat)
    g["b"] = flat.sum(1)
    d_x = np.matmul(flat, p["W"].transpose(0, 2, 1)).reshape(both.shape)
    return g, d_x[0] + d_x[1, ::-1]


def _window_inputs(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (T, B) in ``ids`` of windows that start at ``first`` with ``size`` words, and their mask."""
    t = np.arange(T)[:, None]
    mask = t < size
    return ids[np.minimum(first + t, len(ids) - 1)] if len(ids) else np.zeros(mask.shape, np.int64), mask.astype(np.float32)


class Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.n += 1
        for k, d in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.s[k] = 0.999 * self.s[k] + 0.001 * d * d
            self.p[k] -= np.float32(self.rate) * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.s[k] / (1 - 0.999**self.n)) + 1e-8)


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Shrunk towards 0 where there is little evidence."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return (odds * (pos + neg) / (pos + neg + 4)).astype(np.float32)


def _odds(words: list[str], counts: np.ndarray, n_docs: np.ndarray) -> list[dict]:
    """Log-odds tables of words and n-grams: of each fold from all others, and last of all folds.

    ``counts`` is (fold, label, word), the numbers of documents; ``n_docs`` is (fold, label).
    """
    tables = np.zeros((2, *counts.shape[:2], TABLE), np.float32)
    for i in range(0, len(words), 20_000):
        word, grams, n = Words.hashes(words[i : i + 20_000])
        part = counts[:, :, i : i + len(n)]
        for fold, y in np.ndindex(counts.shape[:2]):
            tables[0, fold, y] += np.bincount((word >> np.uint64(40)).astype(np.int64) % TABLE, part[fold, y], TABLE)
            tables[1, fold, y] += np.bincount((grams >> np.uint64(40)).astype(np.int64) % TABLE, np.repeat(part[fold, y], n), TABLE)
    whole, n_whole = tables.sum(1), n_docs.sum(0)
    out = []
    for fold in range(counts.shape[0] + 1):
        rest, n = (whole, n_whole) if fold == counts.shape[0] else (whole - tables[:, fold], n_whole - n_docs[fold])
        out.append({name: _log_odds(t[1], t[0], max(1, n[1]), max(1, n[0])) for name, t in zip(("word_odds", "gram_odds"), rest, strict=True)})
    return out


def fit(texts: list[str], labels: np.ndarray, prior: float = 0.5, rounds: int = 3, epochs: int = 4, folds: int = 10, seed: int = 7) -> dict:
    """Train on documents' texts and 0/1 labels; ``prior`` is the rate of label 1 to calibrate to.

    Documents are dealt over folds.  A document's log-odds come from the other folds, so that no input
    tells the network the document's own label.  The network learns from four fifths of the folds, and
    the score's curve is fitted to the others (to the same, if there are under two documents a fold).
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.int64)
    words, docs = Words(), []
    for text in texts:
        docs.append(words.ids(words_of(text)))
    vocabulary = list(words.memo)
    size_v = max(1, len(vocabulary))
    fold = np.zeros(len(docs), np.int64)
    for y in (0, 1):
        of = np.flatnonzero(labels == y)
        fold[of] = rng.permutation(len(of)) % folds
    counts = np.zeros((folds, 2, size_v), np.float32)
    for ids, f, y in zip(docs, fold.tolist(), labels.tolist(), strict=True):
        counts[f, y, np.unique(ids)] += 1
    n_docs = np.zeros((folds, 2))
    np.add.at(n_docs, (fold, labels), 1)
    tables = _odds(vocabulary, counts, n_docs)
    del counts
    w_at, c_at = (np.zeros(folds * size_v, np.int32) for _ in range(2))
    fixed = np.zeros((folds * size_v, 3), np.float32)
    blank = {"E_w": np.zeros((EMBED, 0), np.float32), "E_c": np.zeros((EMBED, 0), np.float32)}
    for f in range(folds):
        for i in range(0, len(vocabulary), 20_000):
            part = slice(f * size_v + i, f * size_v + min(i + 20_000, len(vocabulary)))
            _, w_at[part], c_at[part], fixed[part] = Words.inputs(vocabulary[i : i + 20_000], blank | tables[f])
    # Words are numbered anew in each fold; windows lie in documents one after another.
    ids = np.concatenate([*(d + f * size_v for d, f in zip(docs, fold.tolist(), strict=True)), np.zeros(0, np.int64)])
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = [windows(s) for s in sizes.tolist()]
    doc_of = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    first = np.concatenate([s + b for s, b in zip(starts, (np.cumsum(sizes) - sizes).tolist(), strict=True)])
    size = np.minimum(T, np.cumsum(sizes)[doc_of] - first)
    bounds = np.searchsorted(doc_of, np.arange(len(docs) + 1))
    evidence = (fixed[:, 0] + fixed[:, 1])[ids] if len(ids) else np.zeros(0)
    running = np.concatenate([[0], np.cumsum(np.maximum(evidence, 0) ** 2)])
    likely = (running[np.minimum(first + size, len(ids))] - running[np.minimum(first, len(ids))]).astype(np.float32)
    order = np.lexsort((np.arange(len(first)), -likely, doc_of))
    looked = np.sort(order[np.arange(len(first)) - bounds[doc_of[order]] < LOOKED])  # to learn from; scores are of all windows
    edges = np.searchsorted(doc_of[looked], np.arange(len(docs) + 1))
    del running, evidence, order

    def inputs(p: dict, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, mask = _window_inputs(ids, first[which], size[which])
        return np.concatenate([p["E_w"][w_at[at]], p["E_c"][c_at[at]], fixed[at]], -1) * mask[..., None], mask, at

    def logits(p: dict, which: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(which), 1024):
            out.append(_forward(*inputs(p, which[i : i + 1024])[:2], p))
        return np.concatenate(out)

    def network(known: np.ndarray) -> dict:
        """A network that learns from the documents in ``known``."""
        scale = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(np.float32)
        p = {"E_w": rng.normal(0, 0.1, (EMBED, DIM)).astype(np.float32), "E_c": rng.normal(0, 0.1, (EMBED, DIM)).astype(np.float32)}
        p |= {"W": scale(2, INPUTS, 3 * HIDDEN), "U": scale(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32)}
        p |= {"v": scale(2 * HIDDEN), "u": scale(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        adam, now = Adam(p, 0.01), likely[looked]
        clean = known[labels[known] == 0]
        y = np.concatenate([labels[known], np.zeros(len(clean), np.int64)]).astype(np.float32)
        for turn in range(rounds):
            if turn:
                now = logits(p, looked)
            best = np.array([looked[b + int(np.argmax(now[b:e]))] for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
            spare = bounds[:-1] + (rng.random(len(docs)) * np.diff(bounds)).astype(np.int64)
            chosen = np.concatenate([best[known], spare[clean]])
            batches = max(1, len(chosen) // 128)
            for _ in range(max(epochs, -(-STEPS // batches))):
                for part in np.array_split(rng.permutation(len(chosen)), batches):
                    x, mask, at = inputs(p, chosen[part])
                    logit, kept = _forward(x, mask, p, keep=True)
                    g, d_x = _backward(((_sigmoid(logit) - y[part]) / max(1, len(part))).astype(np.float32), kept, p)
                    d_x = d_x * mask[..., None]
                    g["E_w"], g["E_c"] = DECAY * p["E_w"], DECAY * p["E_c"]
                    np.add.at(g["E_w"], w_at[at], d_x[..., :DIM])
                    np.add.at(g["E_c"], c_at[at], d_x[..., DIM : 2 * DIM])
                    adam.step(g)
        return p

    apart = fold < folds // 5 if len(docs) >= 2 * folds else np.zeros(len(docs), bool)
    model = network(np.flatnonzero(~apart))
    shown = apart if apart.any() else ~apart
    of = np.flatnonzero(shown[doc_of])
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, doc_of[of], logits(model, of))
    model |= tables[-1]
    model["scale"] = _calibrate(top[shown], labels[shown], prior)
    return model


def _calibrate(top: np.ndarray, labels: np.ndarray, prior: float) -> np.ndarray:
    """Slope and shift of a logistic curve over documents' logits, classes weighted to ``prior``."""
    weight = np.where(labels == 1, prior / max(1, (labels == 1).sum()), (1 - prior) / max(1, (labels == 0).sum())) * len(labels)
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        d, s = weight * (q - labels), weight * q * (1 - q) + 1e-6
        h = np.array([[(s * top * top).sum() + 1, (s * top).sum()], [(s * top).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, [(d * top).sum() + (a - 1), d.sum() + 0.1 * b])
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
    return np.array([max(a, 0.05), b])


def score_texts(texts: list[str], words: Words) -> np.ndarray:
    """Scores in 0..1 of whole texts; a text without a word says nothing, and scores 0."""
    model = words.model
    words.trim()
    docs = [words.ids(words_of(text)) for text in texts]
    words.compute()
    ids = np.concatenate([*docs, np.zeros(0, np.int64)])
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = [windows(n) for n in sizes.tolist()]
    n_windows = np.fromiter(map(len, starts), np.int64, len(docs))
    ends = np.cumsum(sizes)
    first = np.concatenate(starts) + np.repeat(ends - sizes, n_windows)
    size = np.minimum(T, np.repeat(ends, n_windows) - first)
    logits = np.empty(len(first), np.float32)
    for i in range(0, len(first), 512):
        at, mask = _window_inputs(ids, first[i : i + 512], size[i : i + 512])
        logits[i : i + 512] = _forward(words.x[at] * mask[..., None], mask, model)
    top = np.maximum.reduceat(logits, np.cumsum(n_windows) - n_windows)
    a, b = model["scale"]
    return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(a * top.astype(np.float64) + b, -30, 30))), 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether an id's row is kept from training; a null id has no remainder, and no label either: it isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, class_chars: int = 6_000_000) -> dict:
    """Fit on a sample of labelled rows that aren't held out: of each label at most ``per_class`` rows, in order of a hash of their id, and
    at most ``class_chars`` characters.  A text that doesn't fit in what is left of the characters is passed over; those taken are whole.

    Rows held out (:func:`held_out`) and null labels and ids are not learned from.  Without a row of either label there is no evidence: scores are then those of
    an untrained network.  An id labelled twice counts by its highest label, and one with several texts by one of them.
    """
    known = named(labels, doc_id="doc_id", toxic="toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).filter(~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    first, second = (known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1))
    texts = named(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    picked = texts.join(F.broadcast(first.union(second)), "doc_id")  # per_class ids of each label at most
    one = picked.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n"))).alias("t"))
    left, chosen = {0: class_chars, 1: class_chars}, []
    for r in one.select("doc_id", "toxic", "t.h", "t.n").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["n"]
            chosen.append((r["doc_id"], r["h"], r["toxic"]))
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, toxic int")
    taken = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "h"]).groupBy("doc_id", "toxic").agg(F.first("text").alias("text"))
    rows = taken.orderBy("toxic", F.xxhash64("doc_id"), "doc_id").collect()
    n = sum(counts.values())
    return fit([r["text"] for r in rows] or [""], np.array([r["toxic"] for r in rows] or [0]), min(0.5, max(0.01, counts.get(1, 0) / n)) if n else 0.5)


def score(docs: DataFrame, model: dict, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` (with a text column) and ``score`` and ``predicted``, under ``names``, in place of columns so named; null texts are empty, and texts without a word score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words = Words(shared.value)
        for batch, texts in slices(batches, rows=1024, chars=2_000_000):
            scores = score_texts(texts, words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in names)
    return docs.drop(*names).mapInArrow(run, f"{kinds}, `{names[0]}` double, `{names[1]}` int")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; its columns stay as they are, also ones named like a score."""
    names = free_name(docs, "score"), free_name(docs, "predicted")
    return score(docs, model, threshold, names).filter(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document of whole ``documents``, by a network trained on the labelled rows that aren't held out."""
    docs = named(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
