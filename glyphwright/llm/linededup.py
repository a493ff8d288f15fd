"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is a 128-bit hash of the line without spaces, tabs and carriage returns at its ends; keys
are spread over shards. A store holds, by shard, one cuckoo filter of the keys, an exact table of how
often each key occurs, and where (postings). Inserting documents asks the filters first: keys they
don't know are new without any look at the exact table; only those they may know are joined with it.
New keys enter the filters. A line is removed if its key was in the store, or occurs earlier in the
same batch, by doc_id and line number. Deleting documents takes their postings out, counts the
references down, and removes from the filters the keys that nobody has any more, so the store is as if
they had never come; a removed line whose keeper has gone comes back in the next document that had it.
A filter that can't take its new keys is built anew from the exact table, which is read for such shards
alone. As keys grow in number so do the shards.

Deduplicating a table is a sequence of insertions, ``EPOCHS`` by ranges of doc_id, each of which asks
the filters that those before have left; the result is that of a single pass in order of doc_id.

Each task folds the repeats it sees in one Arrow batch before anything is shuffled, so a line that
every document shares costs one row a batch. Texts aren't shuffled while the lists of removed lines
are few enough to broadcast (counted first); otherwise they are joined by document.

Defined cases: null and empty texts have no lines and stay as they are. Blank lines are never
removed. Null doc_ids come last in order. Rows that repeat doc_id and text are one document and are
cut alike; other texts under the same doc_id are other documents, ordered by the texts' hash. A
document of which nothing but blank lines is left is dropped. Line ends are line feeds; a carriage
return stays with its line. Very long texts and lines are hashed whole. An empty table gives an empty
one. Other columns are passed on untouched, but for one of the name asked for the count, which is
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shipping import map_arrow
from . import _scale
from .cuckoo import CuckooFilter

KEYS_PER_SHARD, EPOCHS = 1_000_000, 2
BLANK = " \t\r"
_NO_ID = (1 << 63) - 1
_LINES = "hi bigint, lo bigint, d bigint, h bigint, line int, first boolean"
_FILTERS = "shard int, filter binary"
_KEYS = "hi bigint, lo bigint"


def _lines(batches):
    for b in batches:
        d, h = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        keys, row, line = [], [], []
        for r, text in enumerate(b.column(2).to_pylist()):
            for i, x in enumerate(text.split("\n")):
                x = x.strip(BLANK)
                if x:
                    keys.append(xxhash.xxh3_128_digest(x))
                    row.append(r)
                    line.append(i)
        if not keys:
            continue
        key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        row, line = np.array(row), np.array(line, np.int32)
        d, h = d[row], h[row]
        order = np.lexsort((line, h, d, key[:, 1], key[:, 0]))
        key, d, h, line = key[order], d[order], h[order], line[order]
        first = np.r_[True, (key[1:] != key[:-1]).any(1)]
        once = first | np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (line[1:] != line[:-1])]
        key, d, h, line, first = key[once], d[once], h[once], line[once], first[once]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[:, 0].copy(), key[:, 1].copy(), d, h, line, first)], names=["hi", "lo", "d", "h", "line", "first"])


def _identity(docs: DataFrame):
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(_NO_ID)), F.xxhash64(docs["text"])


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank: (hi, lo, d, h, line, first); first: the first of its key in
    its batch. Rows of one document may come more than once."""
    d, h = _identity(docs)
    return map_arrow(docs.where("text <> ''").select(d.alias("d"), h.alias("h"), "text"), _lines, _LINES)


def _shards(keys: int) -> int:
    return 1 << max(4, math.ceil(math.log2(max(1, keys) / KEYS_PER_SHARD)))


def _shard(n: int):
    return F.col("hi").bitwiseAND(F.lit(n - 1)).cast("int")


@dataclass
class Store:
    """postings: (shard, hi, lo, epoch, d, h, line); refs: (shard, hi, lo, refs); filters; keys: their number."""

    shards: int
    epoch: int
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    keys: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> Store:
        e = spark.createDataFrame
        return Store(_shards(0), 0, e([], "shard int, hi bigint, lo bigint, epoch int, d bigint, h bigint, line int"), e([], "shard int, hi bigint, lo bigint, refs bigint"), e([], _FILTERS))

    def grown(self, keys: int) -> Store:
        """With as many shards as so many keys need. Shards double, so all that is done for it over the
        life of a store is in proportion to its keys."""
        n = _shards(keys)
        if n <= self.shards:
            return self
        postings, refs = (x.withColumn("shard", _shard(n)) for x in (self.postings, self.refs))
        if not self.keys:
            return replace(self, shards=n, postings=postings, refs=refs)
        filters = _by_shard(refs.select("shard", "hi", "lo"), self.filters.limit(0), ["hi", "lo"], _build, _FILTERS)
        return replace(self, shards=n, postings=postings, refs=refs, filters=_scale.stored(filters, "filters"))


def _by_shard(rows: DataFrame, filters: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
    """function(filter or None, rows of the shard as arrays) for each shard; it yields batches."""
    kinds = dict(rows.dtypes)
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in columns]
    both = rows.select("shard", F.lit(None).cast("binary").alias("filter"), *columns).unionByName(filters.select("shard", "filter", *blank))
    both = both.repartition(_scale.partitions(rows.sparkSession), "shard").sortWithinPartitions("shard", F.col("filter").isNull())

    def run(batches):
        shard, kept, parts = None, None, []
        for b in batches:
            s = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else []
            for i, a in enumerate(cuts):
                piece = b.slice(int(a), int(cuts[i + 1] if i + 1 < len(cuts) else len(s)) - int(a))
                if shard is not None and s[a] != shard:
                    yield from function(shard, kept, _columns(parts))
                    kept, parts = None, []
                shard = int(s[a])
                while piece.num_rows and piece.column(1)[0].is_valid:
                    kept = CuckooFilter.from_bytes(piece.column(1)[0].as_py())
                    piece = piece.slice(1)
                parts.append(piece)
        if shard is not None:
            yield from function(shard, kept, _columns(parts))

    def _columns(parts):
        return [np.concatenate([p.column(k + 2).to_numpy(zero_copy_only=False) for p in parts]) for k in range(len(columns))]

    return map_arrow(both, run, schema)


def _keys(hi, lo):
    return np.stack([hi, lo], 1).astype(np.int64).view(np.uint64)


def _probe(shard, kept, columns):
    hi, lo = columns
    if kept is not None and len(hi):
        known = kept.contains(_keys(hi, lo))
        yield pa.RecordBatch.from_arrays([pa.array(hi[known].astype(np.int64)), pa.array(lo[known].astype(np.int64))], names=["hi", "lo"])


def _grow(shard, kept, columns):
    """With new keys; without a filter if they don't all go in."""
    keys = _keys(*columns)
    if kept is None:
        kept = CuckooFilter.of(keys)
    elif len(keys) and not kept.insert(keys):
        kept = None
    yield _filter_row(shard, kept)


def _build(shard, kept, columns):
    yield _filter_row(shard, CuckooFilter.of(_keys(*columns)))


def _shrink(shard, kept, columns):
    if kept is None:
        return
    if len(columns[0]):
        kept.delete(_keys(*columns))
    yield _filter_row(shard, kept)


def _filter_row(shard, kept):
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([None if kept is None else kept.to_bytes()], pa.binary())], names=["shard", "filter"])


def insert(docs: DataFrame, store: Store | None = None) -> tuple[Store, DataFrame]:
    """(the store with these documents, the removed lines: (d, h, lines array<int>))."""
    return insert_lines(_scale.stored(occurrences(docs), "lines"), store)


def insert_lines(found: DataFrame, store: Store | None = None) -> tuple[Store, DataFrame]:
    """:func:`insert` of documents whose :func:`occurrences` these are, as a table."""
    spark = found.sparkSession
    store = store or Store.empty(spark)
    store = store.grown(store.keys + found.where("first").count())
    found = found.withColumn("shard", _shard(store.shards))
    n = _scale.partitions(spark)
    order = W.partitionBy("shard", "hi", "lo").orderBy("d", "h", "line")
    ranked = found.where("first").repartition(n, "shard").withColumn("rank", F.dense_rank().over(order)).withColumn("once", F.row_number().over(order) == 1)
    ranked = _scale.stored(ranked.drop("first"), "ranked")
    keys = ranked.where("once").select("shard", "hi", "lo")
    if store.keys:
        maybe = _by_shard(keys, store.filters, ["hi", "lo"], _probe, _KEYS)
        known = _scale.stored(maybe.join(store.refs.select("hi", "lo"), ["hi", "lo"], "left_semi").withColumn("known", F.lit(True)), "known")
        if _scale.small_enough(known.count(), 60):
            known = F.broadcast(known)
        ranked = ranked.join(known, ["hi", "lo"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        keys = keys.join(known, ["hi", "lo"], "left_anti")
    else:
        ranked = ranked.withColumn("known", F.lit(False))
    filters = _scale.stored(_by_shard(keys, store.filters, ["hi", "lo"], _grow, _FILTERS), "filters")
    full = [r.shard for r in filters.where("filter is null").select("shard").collect()]  # numbers of shards, as many as there are at most
    mine = found.select("shard", "hi", "lo", F.lit(store.epoch).alias("epoch"), "d", "h", "line").distinct()
    refs = mine.groupBy("shard", "hi", "lo").agg(F.count("*").alias("refs"))
    if store.keys:
        refs = refs.unionByName(store.refs).groupBy("shard", "hi", "lo").agg(F.sum("refs").alias("refs"))
    refs = _scale.stored(refs, "refs")
    if full:
        again = refs.join(F.broadcast(spark.createDataFrame([(x,) for x in full], "shard int")), "shard", "left_semi")
        again = _by_shard(again.select("shard", "hi", "lo"), store.filters.limit(0), ["hi", "lo"], _build, _FILTERS)
        filters = _scale.stored(filters.where("filter is not null").unionByName(again), "filters")
    gone = ranked.where("rank > 1 or known").select("d", "h", "line").unionByName(found.where("not first").select("d", "h", "line"))
    removed = gone.groupBy("d", "h").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    after = Store(store.shards, store.epoch + 1, store.postings.unionByName(mine), refs, filters, refs.count())
    return after, _scale.stored(removed, "removed")


def delete(store: Store, doc_ids: DataFrame) -> tuple[Store, DataFrame]:
    """(the store without the documents of these ids, the lines that come back elsewhere, as
    (d, h, line))."""
    ids = doc_ids.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("d")).distinct()
    out = _scale.stored(store.postings.join(ids, "d", "left_semi").select(*store.postings.columns), "out")
    postings = store.postings.join(ids, "d", "left_anti").select(*store.postings.columns)
    fewer = out.groupBy("shard", "hi", "lo").agg((-F.count("*")).alias("refs"))
    counted = _scale.stored(store.refs.unionByName(fewer).groupBy("shard", "hi", "lo").agg(F.sum("refs").alias("refs")), "refs")
    nobody = counted.where("refs <= 0").select("shard", "hi", "lo")
    filters = _by_shard(nobody, store.filters, ["hi", "lo"], _shrink, _FILTERS)
    place = F.struct("epoch", "d", "h", "line")
    touched = store.postings.join(out.select("hi", "lo").distinct(), ["hi", "lo"], "left_semi")
    before = touched.groupBy("hi", "lo").agg(F.min(place).alias("keeper"))
    now = touched.join(ids, "d", "left_anti").groupBy("hi", "lo").agg(F.min(place).alias("next"))
    back = now.join(before, ["hi", "lo"]).where("next <> keeper").select("next.d", "next.h", "next.line")
    left = counted.where("refs > 0")
    after = Store(store.shards, store.epoch, postings, left, _scale.stored(filters, "filters"), left.count())
    return after, _scale.stored(back, "back")


def apply(docs: DataFrame, removed: DataFrame, count: str | None = None) -> DataFrame:
    """``docs`` without the removed lines and without the documents that lose all they had;
    columns as they were, and ``count``, if named, the number of lines removed."""
    d, h = _identity(docs)
    few = removed.select(F.col("d").alias("__gw_d"), F.col("h").alias("__gw_h"), F.col("lines").alias("__gw_lines"))
    if (removed.agg(F.sum(F.lit(64) + 4 * F.size("lines").cast("bigint"))).first()[0] or 0) <= _scale.BROADCAST_BYTES:
        few = F.broadcast(few)
    joined = docs.join(few, (d == F.col("__gw_d")) & (h == F.col("__gw_h")), "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains("__gw_lines", i.cast("int"))), "\n")
    text = F.when(F.col("__gw_lines").isNull(), docs["text"]).otherwise(left)
    columns = [text.alias(c) if c.lower() == "text" else _scale.column(docs, c) for c in docs.columns if c.lower() != (count or "").lower()]
    extra = [F.coalesce(F.size("__gw_lines"), F.lit(0)).alias(count)] if count else []
    return joined.where(F.col("__gw_lines").isNull() | (F.translate(left, BLANK + "\n", "") != "")).select(*columns, *extra)


def dedup(docs: DataFrame, count: str | None = None, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` inserted into an empty store in ``epochs`` batches by doc_id, and what they removed
    applied."""
    found = _scale.stored(occurrences(docs), "lines")
    cuts = found.agg(F.percentile_approx("d", F.array(*[F.lit(i / epochs) for i in range(1, epochs)])).alias("c")).first().c if epochs > 1 else None
    store, removed = None, None
    bounds = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        batch = found if low is None else found.where(F.col("d") > low)
        batch = batch if high is None else batch.where(F.col("d") <= high)
        store, gone = insert_lines(batch, store)
        removed = gone if removed is None else removed.unionByName(gone)
    return apply(docs, removed, count)


def reversible(docs: DataFrame, later, deleted) -> DataFrame:
    """(event, doc_id, line) of a life of the store: documents come, those for which ``later`` holds in
    a second insertion, and those for which ``deleted`` holds go again. event: removed by an insertion
    (if its lines aren't the first of their kind), or back after the deletion. For doc_ids that aren't
    null."""
    docs = docs.where("doc_id is not null")
    store, first = insert(docs.where(~later))
    store, second = insert(docs.where(later), store)
    store, back = delete(store, docs.where(deleted).select("doc_id"))
    removed = first.unionByName(second).select(F.lit("removed").alias("event"), F.col("d").alias("doc_id"), F.explode("lines").alias("line"))
    return removed.unionByName(back.select(F.lit("back").alias("event"), F.col("d").alias("doc_id"), "line"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
r AS (SELECT *, k <> '' AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS dup FROM k)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dup) AS text,
       CAST(count(*) FILTER (WHERE dup) AS INTEGER) AS n_removed
FROM r GROUP BY doc_id
HAVING count(*) FILTER (WHERE dup) = 0 OR count(*) FILTER (WHERE NOT dup AND k <> '') > 0
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL
"""

#: Of documents by odd and even doc_id, those that 5 divides deleted.
REVERSIBLE_SQL = r"""
WITH l AS (
  SELECT doc_id, doc_id % 2 AS epoch, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY epoch, doc_id, i) AS place FROM k WHERE k <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) AS again FROM p WHERE doc_id % 5 <> 0)
SELECT 'removed' AS event, doc_id, CAST(i AS INTEGER) AS line FROM p WHERE place > 1
UNION ALL SELECT 'back', doc_id, CAST(i AS INTEGER) FROM b WHERE again = 1 AND place > 1
"""
