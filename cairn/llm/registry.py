"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP1_SQL, op1_chat_formatting
from .decontaminate import op9_benchmark_decontamination
from .near_dups import op8_near_duplicates
from .packing import op2_best_fit_packing
from .pii import op3_pii_pseudonyms
from .secrets import op5_secret_scans
from .token_counts import op4_token_counts
from .token_files import op7_token_files
from .topk import op6_exact_top_k
from .toxicity import op10_toxicity

QUERIES = (
    op1_chat_formatting,
    op2_best_fit_packing,
    op3_pii_pseudonyms,
    op4_token_counts,
    op5_secret_scans,
    op6_exact_top_k,
    op7_token_files,
    op8_near_duplicates,
    op9_benchmark_decontamination,
    op10_toxicity,
)

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op6_exact_top_k": OP6_SQL}
