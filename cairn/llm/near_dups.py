"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of hashed 5-word shingles over all documents: each task counts into a table
   of fixed size (the hashing trick), ranges of the table are added up, and the table is broadcast.
2. One pass over the texts gives each document's digest and its samples: for each of K hash
   functions the shingle with the least ICWS key (S. Ioffe, 2010).  Two documents share a sample
   with a probability equal to their weighted Jaccard similarity.  Samples are banded.
3. Equal texts are one node.  In a small bucket every pair is a candidate; in a large one each node
   is paired with the bucket's hub, the member with the largest buckets in all; a hub's partners are
   dealt over salts, and each salt is sent its text once.  Candidates are
   verified by the weighted Jaccard similarity of their whole shingle sets, and classes are the
   connected components of verified links.
4. Members of a large bucket outside its hub's class are compared with all of the bucket, block
   against block, as products of incidence matrices; only links between classes leave a block.  So
   no two members of a bucket go uncompared unless they are in one class already.

Weights are tf * (1 + strength * relative idf).  A plain idf falls to almost nothing for shingles of
a large group of copies, whose few differing shingles would then outweigh all they share, and
members that agree in nine of ten shingles would be missed; so the idf's strength is a small
parameter.  Texts of under five words have one shingle, of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, named, release, slices, stage, table, unstage

FEATURES, RANGE = 1 << 18, 1 << 12
WORDS = 5
_mixer = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


_word_byte = np.zeros(256, bool)
_word_byte[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_SPAN = 4 << 20
_powers = np.cumprod(np.full(1 << 16, 0x100000001B3, np.uint64), dtype=np.uint64)


class Shingler:
    """Hashes of the word shingles of texts.

    Words are runs of ASCII letters, digits, underscores and any other characters beyond ASCII, in
    lower case; they are found and hashed as bytes, whole slices of texts at a time.
    """

    def __init__(self, words: int = WORDS) -> None:
        release()
        self.words = words

    def word_hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes one after another, and each text's number of words."""
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
        inside = _word_byte[data]
        edge = np.diff(inside.view(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
        if not len(starts):
            return np.zeros(0, np.uint64), counts
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):  # some megabytes of a very long text at a time
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SPAN)))
            part = slice(starts[i], ends[j - 1])
            sizes = ends[i:j] - starts[i:j]
            letters = data[part][inside[part]].astype(np.uint64) + np.uint64(1)
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(letters)) - np.repeat(first, sizes)
            letters *= _powers[place & 0xFFFF]
            out[i:j] = mix(np.add.reduceat(letters, first) * _mixer + sizes.astype(np.uint64))
            i = j
        return out, counts

    def shingles(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's distinct shingle hashes, ascending, and their frequencies."""
        hashes, sizes = self.word_hashes(texts)
        n = max(0, len(hashes) - self.words + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(self.words):
            rolled = rolled * _mixer + hashes[k : n + k]
        rolled = mix(rolled)
        out, at = [], 0
        for size in sizes.tolist():
            if size >= self.words:
                out.append(np.unique(rolled[at : at + size - self.words + 1], return_counts=True))
            elif size:
                whole = np.zeros(1, np.uint64)
                for h in hashes[at : at + size]:
                    whole = whole * _mixer + h
                out.append((mix(whole), np.ones(1, np.int64)))
            else:
                out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            at += size
        return out


def _frequencies(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table_, n = Shingler(words), np.zeros(FEATURES, np.int64), 0
        for _, texts in slices(batches, rows=512, chars=2_000_000):
            for h, _freq in shingler.shingles(texts):
                table_[np.unique((h >> np.uint64(46)).astype(np.int64))] += 1
            n += len(texts)
        if n:
            kinds = table_.reshape(-1, RANGE)
            full = np.flatnonzero(kinds.any(1)).tolist()
            small = "<u2" if kinds.max(initial=0) < 65536 else "<i8"
            yield pa.RecordBatch.from_arrays([pa.array([-1, *full], pa.int32()), pa.array([np.array([n], "<i8").tobytes(), *(kinds[r].astype(small).tobytes() for r in full)], pa.binary())], ["part", "counts"])

    return count


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(data, "<u2" if len(data) == 2 * RANGE else "<i8").astype(np.int64)
            held[part] = held[part] + counts if part in held else counts
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "counts"])


def weights(docs: DataFrame, words: int = WORDS, strength: float = 0.25) -> np.ndarray:
    """The weight of each hashed shingle, from the document frequencies of all rows of ``docs`` (text)."""
    rows = named(docs, text="text").mapInArrow(_frequencies(words), "part int, counts binary").repartition("part").mapInArrow(_added, "part int, counts binary").collect()  # FEATURES / RANGE rows
    df, n = np.zeros(FEATURES, np.int64), 0
    for part, counts in rows:
        values = np.frombuffer(counts, "<i8")
        if part < 0:
            n = int(values[0])
        else:
            df[part * RANGE : (part + 1) * RANGE] = values
    return (1 + strength * np.log((n + 1) / (df + 1)) / np.log(n + 2)).astype(np.float32)


class Sampler:
    """K improved consistent weighted samples of sets of weighted shingles.

    The draws of a shingle under a hash function come from a table of Gamma(2, 1), Gamma(2, 1) and
    uniform variates at a place hashed from both.
    """

    def __init__(self, k: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        r, c, beta = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
        self.r, self.inverse, self.beta, self.top = (x.astype(np.float32) for x in (r, 1 / r, beta, np.log(c) - r))
        self.factors = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, hashes: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(sets, k) samples; ``counts`` > 0 are the sizes of the sets, one after another."""
        starts = np.cumsum(counts) - counts
        log_w = np.log(weight)
        out = np.empty((len(counts), len(self.factors)), np.uint64)
        for i, factor in enumerate(self.factors):
            at = ((hashes * factor) >> np.uint64(48)).astype(np.int32)
            r, beta = self.r[at], self.beta[at]
            t = np.floor(log_w * self.inverse[at] + beta)
            key = self.top[at] - r * (t - beta)
            least = np.repeat(np.minimum.reduceat(key, starts), counts)
            places = np.flatnonzero(key == least)
            first = places[np.searchsorted(places, starts)]
            out[:, i] = mix(hashes[first] + t[first].astype(np.int64).astype(np.uint64) * _mixer + np.uint64(i))
        return out


def _signatures(words: int, bands: int, rows: int, shared):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler, weight = Shingler(words), Sampler(bands * rows), shared.value
        for batch, texts in slices(batches, rows=256, chars=1_000_000):
            sets = shingler.shingles(texts)
            counts = np.fromiter((len(h) for h, _ in sets), np.int64, len(sets))
            full = np.flatnonzero(counts)
            keys: list = [None] * len(sets)
            if len(full):
                hashes, freq = np.concatenate([sets[i][0] for i in full]), np.concatenate([sets[i][1] for i in full])
                w = weight[(hashes >> np.uint64(46)).astype(np.int64)] * freq.astype(np.float32)
                got = sampler.samples(hashes, w, counts[full]).reshape(len(full), bands, rows)
                key = np.zeros((len(full), bands), np.uint64)
                for j in range(rows):
                    key = mix(key * _mixer + got[:, :, j])
                key += np.arange(bands, dtype=np.uint64)
                for i, row in zip(full.tolist(), key.view(np.int64), strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "keys"])

    return sign


def _similar(words: int, threshold: float, shared):
    """Rows (a, salt, b, text), one node ``a`` and salt after another and first the row of a itself, with a null b; to verified (a, b)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, weight, held = Shingler(words), shared.value, None
        for batch, texts in slices(batches, rows=256, chars=1_000_000):
            good = []
            for b, (h, n) in zip(batch.column(2).to_pylist(), shingler.shingles(texts), strict=True):
                w = weight[(h >> np.uint64(46)).astype(np.int64)].astype(np.float64) * n
                if b is None:
                    held = h, w
                    good.append(False)
                    continue
                _, ia, ib = np.intersect1d(held[0], h, assume_unique=True, return_indices=True)
                both = np.minimum(held[1][ia], w[ib]).sum()
                good.append(both >= (threshold - 1e-9) * (held[1].sum() + w.sum() - both) and both > 0)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask)], ["a", "b"])

    return verify


def _elements(words: int):
    """(node, text) to (node, elements): the shingle hashes, ascending, each as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch, texts in slices(batches, rows=256, chars=1_000_000):
            data = [np.repeat(h, n).astype("<u8").tobytes() for h, n in shingler.shingles(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["node", "elements"])

    return run


def _occurrences(data: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of (shingle, occurrence) with set numbers and weights, and each set's whole weight; sums of weights of common keys are those of minima."""
    sets = [np.frombuffer(d, "<u8") for d in data]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    h, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64), np.repeat(np.arange(len(sets)), sizes)
    w = weight[(h >> np.uint64(46)).astype(np.int64)].astype(np.float64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mix(h + nth.astype(np.uint64) * _mixer), owner, w, np.bincount(owner, w, len(sets))


def similarity_matrix(one: list[bytes], other: list[bytes], weight: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Weighted Jaccard similarity of every set of ``one`` with every set of ``other``: products of incidence matrices, some columns at a time."""
    (ka, oa, wa, ta), (kb, ob, _, tb) = _occurrences(one, weight), _occurrences(other, weight)
    common = np.intersect1d(ka, kb)
    both = np.zeros((len(one), len(other)))
    ia, ib = np.searchsorted(common, ka), np.searchsorted(common, kb)
    for i in range(0, len(common), columns):
        n = min(columns, len(common) - i)
        m = []
        for k, at, o, v, rows in ((ka, ia, oa, wa, len(one)), (kb, ib, ob, None, len(other))):
            part = np.flatnonzero((at >= i) & (at < i + n))
            part = part[common[at[part]] == k[part]]
            x = np.zeros((rows, n), np.float64)
            x[o[part], at[part] - i] = 1 if v is None else v[part]
            m.append(x)
        both += m[0] @ m[1].T
    union = ta[:, None] + tb[None, :] - both
    return np.where(both > 0, both / np.maximum(union, 1e-30), 0)


def _blocks(threshold: float, shared):
    """Cogrouped blocks of (node, label, elements) to links, one for each left node and class on the right."""

    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            similar = similarity_matrix(left["elements"].tolist(), right["elements"].tolist(), shared.value) >= threshold - 1e-9
            for i, j in zip(*np.nonzero(similar), strict=True):
                out.append((left["node"].iat[i], right["node"].iat[j], left["label"].iat[i], right["label"].iat[j]))
        found = pd.DataFrame(out, columns=["a", "b", "la", "lb"])
        found = found[found["la"] != found["lb"]].drop_duplicates(["a", "lb"])
        return found[["a", "b"]]

    return link


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the component's least node.  Large-star and small-star rounds until nothing changes."""
    edges = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now_edges = stage(small, "edges")
        now = now_edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(edges)
        edges = now_edges
        if now == before:
            break
        before = now
    pairs = edges.groupBy("a").agg(F.min("b").alias("label"))
    return pairs.select(F.col("a").alias("node"), "label").union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _node() -> Column:
    """Equal texts, and only those, are one node; null texts are empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _classes(docs: DataFrame, threshold: float, words: int, bands: int, rows: int, strength: float, small: int, salted: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of all rows, and (node, rep, n, label) of all nodes: least doc_id, number of rows and class."""
    spark = docs.sparkSession
    with_node = named(docs, doc_id="doc_id", text="text").select("doc_id", _node().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(weights(with_node, words, strength))  # of a fixed size, 1 MB
    signed = stage(with_node.mapInArrow(_signatures(words, bands, rows, shared), "doc_id long, node binary, keys array<long>"), "signatures")
    nodes = stage(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys")), "nodes")
    entries = nodes.select("node", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    sized = stage(entries.join(sizes, "key"), "entries")
    popular = sized.groupBy("node").agg(F.sum("size").alias("pop"))
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / salted)).alias("salt")  # deals a large bucket's members over tasks
    held = stage(sized.join(popular, "node").select("key", salt, "node", "size", "pop"), "members")
    unstage(sized)

    def salts(by_key: DataFrame) -> DataFrame:
        """Rows of one a key (with ``size``), once for each of the key's salts."""
        return by_key.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / salted) - 1))).drop("size")

    few, many = held.filter(F.col("size") <= small), held.filter(F.col("size") > small)
    x, y = few.select("key", F.col("node").alias("x")), few.select("key", F.col("node").alias("y"))
    pairs = x.join(y, "key").filter("x < y").select(F.col("y").alias("a"), F.col("x").alias("b"), F.lit(0).cast("long").alias("size"))
    hubs = many.groupBy("key").agg(F.max_by("node", F.struct("pop", "node")).alias("hub"), F.max("size").alias("size"))
    star = many.join(salts(hubs), ["key", "salt"]).filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "size")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, text) of the wanted nodes, each from a row of its least doc_id."""
        reps = nodes.select("node", "rep").join(wanted.distinct(), "node", "left_semi").select(F.col("node").alias("of"), "rep")
        same = (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep"))
        return with_node.join(reps, same, "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def verified(found: DataFrame) -> DataFrame:
        """Those of the found pairs that are similar.  A hub's partners are dealt over salts, and its text goes to each salt once."""
        found = stage(found.groupBy("a", "b").agg(F.max("size").alias("size")), "pairs")
        salt = F.pmod(F.xxhash64("b"), F.greatest(F.ceil(F.col("size") / salted), F.lit(1)))
        dealt = found.select("a", salt.alias("salt"), "b")
        texts = stage(texts_of(found.select(F.explode(F.array("a", "b")).alias("node"))), "texts")
        heads = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
        rest = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
        ordered = heads.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        links = stage(ordered.mapInArrow(_similar(words, threshold, shared), "a binary, b binary"), "links")
        unstage(texts, found)
        return links

    links = verified(pairs.union(star))
    labels = stage(components(links), "labels")
    labelled = lambda m: m.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    # Members of large buckets outside the class of the bucket's hub meet all of the bucket, in blocks.
    m = labelled(many)
    home = m.groupBy("key").agg(F.max_by("label", F.struct("pop", "node")).alias("home"), F.max("size").alias("size"))
    apart = stage(m.join(salts(home), ["key", "salt"]).filter("label <> home").select("key", "salt", "node", "label", "size"), "apart")
    if apart.take(1):
        blocks = [F.ceil(F.count("*") / 128).alias("n_left"), F.ceil(F.max("size") / 256).alias("n_right"), F.max("size").alias("size")]
        counts = salts(apart.groupBy("key").agg(*blocks))
        members = m.join(counts, ["key", "salt"]).select("key", "node", "label", "n_left", "n_right")
        lone = apart.join(counts, ["key", "salt"]).select("key", "node", "label", "n_left", "n_right")
        elements = stage(texts_of(members.select("node")).mapInArrow(_elements(words), "node binary, elements binary"), "elements")

        def deal(x: DataFrame, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
            """Each row in its own block, once for every block of the other side."""
            dealt = x.withColumn(own, F.pmod(F.xxhash64("node"), F.col(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1)))
            names = ("key", "i", "j", "node", "label", "elements")
            return dealt.join(elements, "node").select(*[F.col(c).alias(c) for c in names])  # new columns: both sides hold the same tables

        left, right = deal(lone, "i", "j", "n_left", "n_right"), deal(members, "j", "i", "n_right", "n_left")
        more = stage(left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInPandas(_blocks(threshold, shared), "a binary, b binary"), "links")
        first = labels
        labels = stage(components(links.union(more)), "labels")
        unstage(elements, more, first)
    unstage(apart, links, held)
    return signed.select("doc_id", "node"), labelled(nodes.select("node", "rep", "n"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = WORDS, bands: int = 16, rows: int = 4, strength: float = 0.25, small: int = 8, salted: int = 128) -> DataFrame:
    """(doc_id, class_id, n_class) for every row of ``docs`` (doc_id, text); ``class_id`` is the class's least doc_id.

    Null texts are empty.  Equal texts are in one class whatever their length, all empty texts in
    one too.  Rows of null doc_id are in classes like others; a class of nothing but those has a null
    class_id.  Rows of one doc_id and different texts are each in the class of their own text.
    """
    signed, node_label = _classes(docs, threshold, words, bands, rows, strength, small, salted)
    classes = node_label.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n").alias("n_class"))
    by_node = node_label.join(classes, "label").select("node", "class_id", "n_class")
    return signed.join(by_node, "node").select("doc_id", "class_id", "n_class")


def keep_one(docs: DataFrame, threshold: float = 0.8, words: int = WORDS, bands: int = 16, rows: int = 4, strength: float = 0.25, small: int = 8, salted: int = 128) -> DataFrame:
    """``docs`` with one row of each class, whatever its ids: a row of the class's least doc_id (nulls last), and there of the least node.

    Of rows that agree in doc_id and text one stays, by a hash of its columns.
    """
    signed, node_label = _classes(docs, threshold, words, bands, rows, strength, small, salted)
    least = node_label.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("m")).select(F.col("m.rep").alias("rep"), F.col("m.node").alias("of"))
    own, of, rep, n = (free_name(docs, x) for x in ("own_node", "of_node", "of_id", "n_rows"))
    same = (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    chosen = stage(signed.join(least, same).groupBy("of", "rep").agg(F.count("*").alias("n")), "chosen").select(F.col("of").alias(of), F.col("rep").alias(rep), F.col("n").alias(n))
    keyed = docs.withColumn(own, _node())
    same = (F.col(own) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(rep))
    names = [F.col(f"`{c}`") for c in docs.columns]
    single = keyed.join(chosen.filter(F.col(n) == 1), same, "left_semi").select(*names)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    again = keyed.join(chosen.filter(F.col(n) > 1), same, "left_semi").groupBy(own).agg(F.min_by(F.struct(*names), F.xxhash64(*hashed)).alias(n))
    return single.union(again.select(f"{n}.*"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document of whole ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
