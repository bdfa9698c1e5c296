"""Secret scans with multipart credential linking.

Strong kinds are reported wherever they stand.  Weak candidates (a user or client name in an
assignment, an endpoint, a random-looking token) say little alone: they are reported only when
complementary parts stand within the same scope of ``scope`` code points; one that a strong span holds
whole has been reported with it, one that only overlaps or holds a strong span has not.  A document's spans are
joined by interval in one sweep over sorted starts, so no pair of spans is ever enumerated:

* a weak identifier counts when a secret (strong or weak) is in scope;
* a weak secret counts when an identifier (an access key or a weak one) is in scope;
* an endpoint counts when both an identifier and a secret are in scope.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, slices, table

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")  # a maximal run, so the length may stand in the pattern
_ident = re.compile(r"""(?:user|username|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+_.-]{3,}""", re.IGNORECASE | re.ASCII)
_key = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_endpoint = re.compile(r"(?:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong kinds, leftmost and non-overlapping for each kind, in order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int = 200) -> list[tuple[int, int, int]]:
    """Weak candidates whose complementary parts are in scope: at most ``scope`` code points lie between the two spans."""
    weak = [(m.start(), 5, m.end()) for m in _endpoint.finditer(text)] if "://" in text else []
    if "=" in text or ":" in text:
        weak += [(m.start(), 3, m.end()) for m in _ident.finditer(text)]
    if base or weak:
        weak += [(m.start(), 4, m.end()) for m in _key.finditer(text) if _mixed(m[0])]
    if not weak:
        return []
    starts, furthest = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))

    def inside(a: int, b: int) -> bool:  # whole in a strong span, which has been reported
        i = bisect_right(starts, a) - 1
        return i >= 0 and furthest[i] >= b

    weak = [w for w in weak if not inside(w[0], w[2])]

    def near(kinds: tuple[int, ...]):
        """Of these kinds' spans, whether one is in scope of (a, b); spans of one kind don't overlap, so their ends are in order too."""
        by_kind = [sorted((a, b) for a, k, b in (*base, *weak) if k == kind) for kind in kinds]
        ends, begins = [[b for _, b in x] for x in by_kind], [[a for a, _ in x] for x in by_kind]
        return lambda a, b: any(bisect_left(e, a - scope) < bisect_right(s, b + scope) for e, s in zip(ends, begins, strict=True))

    ident, secret = near((1, 3)), near((0, 2, 4))
    return sorted(w for w in weak if (w[1] == 3 or ident(w[0], w[2])) and (w[1] == 4 or secret(w[0], w[2])))


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, spans) with spans array<struct<kind, start, end>> in order, for every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans; rows that share a doc_id are scanned apart.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch, texts in slices(batches):
            rows = []
            for text in texts:
                base = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + linked_spans(text, base, scope))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return named(docs, doc_id="doc_id", text="text").mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]`` and ``n_chars``, if there as a whole number, counted anew; all rows and columns stay.

    Overlapping spans are replaced as one, under the first one's kind.  A null text stays null, and its ``n_chars`` is null.
    """
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out = []
            for text, given in zip(texts, batch.column(names.index("text")).is_valid().to_pylist(), strict=True):
                base = base_spans(text)
                parts, at = [], 0
                for a, k, b in sorted(base + linked_spans(text, base, scope)):
                    if a >= at:
                        parts += [text[at:a], f"[{KINDS[k]}]"]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]) if given else None)
            columns = list(batch.columns)
            for i, (name, kind) in enumerate(zip(names, batch.schema.types, strict=True)):
                if name == "text":
                    columns[i] = pa.array(out, pa.string())
                elif name == "n_chars" and pa.types.is_integer(kind):
                    columns[i] = pa.array([None if x is None else len(x) for x in out], kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(cut, docs.schema)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of :func:`find_secrets` over ``documents``."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), *[count(k).alias(f"n_{k}") for k in KINDS[3:]])
