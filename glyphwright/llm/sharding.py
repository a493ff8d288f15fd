"""Contiguous shards of equal size in bytes.

Documents are range-sorted by doc_id; each partition reports its bytes, the totals give every
partition its first byte, and a second narrow pass adds up within it. A document goes to the shard in
which its first byte falls, the cuts being at equal parts of the whole. So every shard is a range of
doc_ids, and its size differs from the target by less than its two documents at the cuts. Texts are
read for their length only.

Defined cases: null and empty texts have no bytes and go with what follows them; null doc_ids come
first; rows that repeat a doc_id are ordered by size; an empty table gives no rows, and one without
any bytes a single shard 0. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import _scale

SHARDS = 64


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, n_bytes, start_byte, shard), in order."""
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    ordered = _scale.range_sorted(sized, "doc_id", "n_bytes")
    total = ordered.agg(F.sum("n_bytes")).first()[0] or 0
    cuts = np.array([-(-i * total // shards) for i in range(1, shards)] if total else [], dtype=np.int64)

    def cut(batches):
        for b in batches:
            start = b.column(2).to_numpy(zero_copy_only=False) - b.column(1).to_numpy(zero_copy_only=False)
            shard = np.searchsorted(cuts, start, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start), pa.array(shard)], names=["doc_id", "n_bytes", "start_byte", "shard"])

    return map_arrow(_scale.running_sums(ordered, "n_bytes", "end"), cut, "doc_id bigint, n_bytes bigint, start_byte bigint, shard int")


SQL = f"""
WITH t AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS pos FROM t)
SELECT doc_id, n AS n_bytes, pos AS start_byte,
       CAST(least(pos * {SHARDS} // greatest((SELECT CAST(sum(n) AS BIGINT) FROM t), 1), {SHARDS - 1}) AS INTEGER) AS shard
FROM s
"""
