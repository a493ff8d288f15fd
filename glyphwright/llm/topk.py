"""Exact top-k search: stated queries against all vectors, in tiles.

Vectors and queries are packed into blocks where they are and dealt to a grid: vectors to columns and
queries to rows of it, each side of a cell being at most ``side`` bytes. So a vector travels once for
each row of the grid and a query once for each column, however many blocks there are, and all that is
shuffled besides are the lists. A task multiplies its cell tile by tile; a partial selection keeps, of a
tile, what may be among the k best of a query: the products are in single precision, so all that come
within its error of the k-th best are worked out anew in double precision. The lists of a query's cells
are merged in a tree, ``FAN`` at a time. Lists travel packed, one row for a block of queries.

Scores are cosines in double precision, rounded to six digits; equal ones go by the smaller id. So the
result is exact and the same for every tiling. Work is queries times vectors by definition; what is held
at once is a cell, whatever the size of the tables. Without ``queries`` every vector is one.

Defined cases: a vector that is null, empty, of another length than the most common one (of those the
longest), or that has a null, a nan, an infinity or no direction takes no part, as query or otherwise.
Of rows that repeat an id the smallest vector counts. A vector isn't the neighbour of a query of the
same id. With fewer than k others all are given. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import _scale

K, BLOCK, SIDE, FAN, DIGITS = 10, 4096, 32 << 20, 8, 6
#: Vectors and queries whose products are held at once.
TILE, QUERIES = 8192, 512
#: The search that is registered asks for every vector whose id this divides.
EVERY = 50
_LISTS = "qblock bigint, part int, queries binary, ids binary, scores binary"
_NOTHING = -(1 << 40)


def _usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): v in the precision that it had."""
    single = rows.select(_scale.column(rows, vector)).schema.fields[0].dataType.simpleString() == "array<float>"
    v = F.col("v")
    rows = rows.select(_scale.column(rows, vec_id).cast("bigint").alias("id"), _scale.column(rows, vector).cast("array<double>").alias("v")).where("id is not null")
    rows = rows.where((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v")).select("id", v.cast("array<float>") if single else v)


def _packer(groups: int, block: int, dtype):
    """Blocks of at most ``block`` rows of each group: (grp, block, ids, m)."""

    def run(batches):
        held: dict[int, list] = {}
        made = 0

        def pack(k):
            nonlocal made
            ids, m = (np.concatenate(x) for x in zip(*held.pop(k), strict=True))
            number = TaskContext.get().partitionId() << 32 | made
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([number], pa.int64()), pa.array([ids.tobytes()]), pa.array([m.astype(dtype).tobytes()])], names=["grp", "block", "ids", "m"])

        for b in batches:
            if not b.num_rows:
                continue
            group, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            values = b.column(2).flatten().to_numpy().reshape(len(ids), -1)
            for k in np.unique(group).tolist():
                own = np.flatnonzero(group == k)
                for at in range(0, len(own), block):
                    part = own[at : at + block]
                    if k in held and sum(len(x) for x, _ in held[k]) + len(part) > block:
                        yield pack(k)
                    held.setdefault(k, []).append((ids[part], values[part]))
        for k in sorted(held):
            yield pack(k)

    return run


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(float)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of lists that stand side by side."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _enter(best_ids, best, row, ids, scores, k):
    """Put candidates (row of the lists, id, score) into the lists."""
    touched, own = np.unique(row, return_inverse=True)
    r = np.r_[np.repeat(np.arange(len(touched)), k), own]
    i, s = np.r_[best_ids[touched].ravel(), ids], np.r_[best[touched].ravel(), scores]
    order = np.lexsort((i, -s, r))
    r, i, s = r[order], i[order], s[order]
    first = np.searchsorted(r, np.arange(len(touched)))
    keep = np.arange(len(r)) - first[r] < k
    best_ids[touched], best[touched] = i[keep].reshape(-1, k), s[keep].reshape(-1, k)


def tile(query_ids, queries, ids, vectors, k: int, single=None) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and scores (in units of the last digit) of each query, best first. queries and
    vectors are unit rows; single: the vectors in single precision. Places that are left over have id -1
    and a score below all."""
    best_ids, best = np.full((len(query_ids), k), -1, np.int64), np.full((len(query_ids), k), _NOTHING, np.int64)
    single = vectors.astype(np.float32) if single is None else single
    unit_, error = 10.0**-DIGITS, (queries.shape[1] + 8) * 2.0**-23 if len(queries) else 0.0
    for a in range(0, len(query_ids), QUERIES):
        q = queries[a : a + QUERIES]
        q32, qids = q.astype(np.float32), query_ids[a : a + QUERIES]
        mine, scores = best_ids[a : a + QUERIES], best[a : a + QUERIES]
        for b in range(0, len(ids), TILE):
            near = q32 @ single[b : b + TILE].T
            least = scores[:, -1] * unit_ - unit_ - error
            empty = scores[:, -1] == _NOTHING
            if empty.any() and near.shape[1] > k + 1:
                # A vector of the query's own id may be among them, so one more.
                least[empty] = np.partition(near[empty], -(k + 1), axis=1)[:, -(k + 1)] - 2 * error - 2 * unit_
            row, col = np.nonzero(near >= least[:, None].astype(np.float32) - np.float32(error))
            other = ids[b + col] != qids[row]
            row, col = row[other], col[other]
            for c in range(0, len(row), 200_000):
                r, v = row[c : c + 200_000], b + col[c : c + 200_000]
                exact = np.rint(np.einsum("ij,ij->i", q[r], vectors[v]) * 10**DIGITS).astype(np.int64)
                _enter(mine, scores, r, ids[v], exact, k)
    return best_ids, best


def _cells(k, dtype, columns):
    """Rows of a task come cell by cell, a cell's vectors before its queries."""

    def run(batches):
        cell, parts, ready = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["cell"] != cell:
                    cell, parts, ready = r["cell"], [], None
                ids = np.frombuffer(r["ids"], np.int64)
                m = np.frombuffer(r["m"], dtype).reshape(len(ids), -1)
                if not r["asks"]:
                    parts.append((ids, m))
                    continue
                if ready is None and parts:
                    all_ids, all_m = np.concatenate([p[0] for p in parts]), unit(np.concatenate([p[1] for p in parts]))
                    ready, parts = (all_ids, all_m, all_m.astype(np.float32)), []
                if ready is not None:
                    yield _row(r["block"], cell % columns, ids, *tile(ids, unit(m), ready[0], ready[1], k, ready[2]))

    return run


def _row(qblock, part, queries, ids, scores):
    return pa.RecordBatch.from_arrays([pa.array([qblock], pa.int64()), pa.array([part], pa.int32()), *[pa.array([x.tobytes()]) for x in (queries, ids, scores)]], names=["qblock", "part", "queries", "ids", "scores"])


def _merger(k):
    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        q = np.frombuffer(rows[0]["queries"], np.int64)
        ids, scores = (np.concatenate([np.frombuffer(r[c], np.int64).reshape(len(q), -1) for r in rows], 1) for c in ("ids", "scores"))
        return pa.Table.from_batches([_row(rows[0]["qblock"], rows[0]["part"] // FAN, q, *merge(ids, scores, k))])

    return run


def _unpack(batches):
    for b in batches:
        for r in b.to_pylist():
            q = np.frombuffer(r["queries"], np.int64)
            ids, scores = (np.frombuffer(r[c], np.int64).reshape(len(q), -1) for c in ("ids", "scores"))
            there = scores > _NOTHING
            rank = np.broadcast_to(np.arange(1, ids.shape[1] + 1, dtype=np.int32), ids.shape)
            query = np.broadcast_to(q[:, None], ids.shape)
            score = scores[there] / 10**DIGITS
            yield pa.RecordBatch.from_arrays([pa.array(query[there]), pa.array(rank[there]), pa.array(ids[there]), pa.array(score + 0.0)], names=["query_id", "rank", "neighbour_id", "score"])


def search(rows: DataFrame, queries: DataFrame | None = None, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """(query_id, rank, neighbour_id, score) of the k nearest among ``rows`` of every one of ``queries``
    (of every vector, if there are none), rank from 1."""
    spark = rows.sparkSession
    vectors = _scale.stored(_usable(rows, vec_id, vector), "vectors")
    asks = vectors if queries is None else _scale.stored(_usable(queries, vec_id, vector), "queries")
    size = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    size = size.n if size else 0
    vectors, asks = (x.where(F.size("v") == size) for x in (vectors, asks))
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}["v"]
    dtype = np.float32 if kind == "array<float>" and asks.schema["v"].dataType.simpleString() == kind else np.float64
    bytes_ = size * np.dtype(dtype).itemsize + 8
    n, n_asks = vectors.count(), asks.count()
    grid_rows = max(1, -(-n_asks * bytes_ // side))
    # Columns as the size asks for, or as many as there are tasks to be had.
    columns = max(1, -(-n * bytes_ // side), min(-(-n // block), -(-2 * _scale.partitions(spark) // grid_rows)))
    spread = lambda df, groups, seed: df.select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)).cast("int").alias("grp"), "id", "v")
    packed = [
        _scale.stored(map_arrow(spread(df, groups, seed), _packer(groups, block, dtype), "grp int, block bigint, ids binary, m binary"), "packed")
        for df, groups, seed in ((vectors, columns, 1), (asks, grid_rows, 2))
    ]
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    dealt = [
        packed[0].select(F.explode(F.transform(upto(grid_rows), lambda r: r * columns + F.col("grp"))).alias("cell"), F.lit(False).alias("asks"), "block", "ids", "m"),
        packed[1].select(F.explode(F.transform(upto(columns), lambda c: F.col("grp") * columns + c)).alias("cell"), F.lit(True).alias("asks"), "block", "ids", "m"),
    ]
    cells = dealt[0].unionByName(dealt[1]).repartition(min(grid_rows * columns, 64 * _scale.partitions(spark)), "cell").sortWithinPartitions("cell", "asks")
    lists = map_arrow(cells, _cells(k, dtype, columns), _LISTS)
    parts = columns
    while parts > 1:
        lists = lists.groupBy("qblock", F.floor(F.col("part") / FAN).alias("to")).applyInArrow(_merger(k), _LISTS)
        parts = -(-parts // FAN)
    return map_arrow(lists, _unpack, "query_id bigint, rank int, neighbour_id bigint, score double")


SQL = f"""
WITH e AS (SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM embeddings GROUP BY vec_id),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS len FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_dot_product(a.v, b.v) / (a.len * b.len), {DIGITS}) + 0.0 AS score
      FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0 AND a.len > 0 AND b.len > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= {K}
"""
