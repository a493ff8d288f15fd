"""Near duplicates by SimHash, found with a Gray-order hierarchical index.

A document's features are its distinct words; each of 256 fingerprint bits is the majority of that
bit over the features' hashes. Fingerprints within 40 of 256 bits have, in one of their four codes of 64
bits, at most 10 (the first) or 9 (the others) that differ, else there were 11 + 10 + 10 + 10. Such
a code has at most 5 in its first part or 4 in its second, by the same count, and a part has two blocks
more than that, so it agrees on two of them. Every code goes to the buckets of the pairs of blocks of
each of its parts, 126 for the four codes, and the search is exact. Within a bucket the fingerprints are sorted by Gray rank, runs of
them become leaves, runs of leaves become upper nodes, and a node holds the bits on which all below
it agree (mask and pattern; a child keeps only the bits that its parent doesn't have). A search
walks down, adds up the differences on each node's own bits, and drops the whole group once they
exceed ``max_bits``. What is found is checked on all 256 bits, and pairs are joined to groups.

Defined cases: a text without words (null, empty, only signs) has no fingerprint and is nobody's
duplicate. A document is a doc_id with a text: equal rows are one, other texts under the same doc_id
are others, and rows without doc_id take part (after all that have one) but can't be named in the
report. Of a group the document with the smallest doc_id stays, ties by the text's hash. Of equal
fingerprints one stands for all, so copies by the thousand cost one search. Dropping leaves one row of
equal rows that stay, the one whose columns have the smallest hash; the search reads no other columns.
Very long texts are fingerprinted whole, one at a time; shorter ones some at a time, never as many as
the 2**20 rows that the upper 20 bits of a feature can tell apart.
"""

from __future__ import annotations

import json
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import _scale, _text

MAX_BITS = 10  # of the 64 of a code that is searched
SEARCHED = 4  # codes
MAX_ALL = 40  # of all 256
LEAF, FAN = 16, 8
SLAB = 1 << 18  # bytes fingerprinted at a time, which take some thirty times that
WORDS = ("f0", "f1", "f2", "f3")


def _layout(max_bits: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """For codes within ``max_bits``: where each block starts and how many bits it has; the pairs of
    blocks of each of the two parts, on one of which such codes agree."""
    count = max(10, max_bits + 3)  # more blocks than that do no harm, and none has over 7 bits
    cuts = [64 * i // count for i in range(count + 1)]
    first = count - count // 2
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], [*combinations(range(first), 2), *combinations(range(first, count), 2)]


def _limits(max_bits: int, max_all: int) -> list[int]:
    """Bits within which each code is searched; fingerprints that differ in more than that in each
    differ in more than ``max_all``."""
    return [min(max_bits, (max_all + SEARCHED - k) // SEARCHED - 1) for k in range(SEARCHED)]


SPANS, PAIRS = _layout(MAX_BITS)
#: The eight bits of a byte as the eight bytes of a word.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def fingerprint(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their fingerprints as n x 4 uint64)."""
    rows, prints = [], []
    for first, _, data, offsets in _text.slabs(column, SLAB):
        start, end, row = _text.words(data, offsets)
        if not len(start):
            continue
        feature = np.unique((row.astype(np.uint64) << np.uint64(44)) | (_text.hashes(data, start, end) >> np.uint64(20)))
        own = (feature >> np.uint64(44)).astype(np.int64)
        word = feature & np.uint64((1 << 44) - 1)
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = np.r_[cuts[1:], len(own)]
        got = np.empty((len(cuts), 4), np.uint64)
        # Votes are counted in byte lanes of uint64, so at most 255 features at a time.
        place = np.arange(len(own)) - np.repeat(cuts, ends - cuts)
        parts = np.flatnonzero(place % 255 == 0)
        heads = np.searchsorted(parts, cuts)
        for k in range(4):
            hashed = _text.mix(word + np.uint64((k + 1) << 50)).view(np.uint8).reshape(-1, 8)
            lanes = np.add.reduceat(SPREAD[hashed], parts, axis=0)
            votes = np.add.reduceat(lanes.view(np.uint8).astype(np.int32), heads, axis=0)
            got[:, k] = np.packbits(2 * votes > (ends - cuts)[:, None], axis=1).view(np.uint64)[:, 0]
        rows.append(own[cuts] + first)
        prints.append(got)
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
    return np.concatenate(rows), np.concatenate(prints)


def _fingerprints(batches):
    for b in batches:
        rows, prints = fingerprint(b.column(2))
        columns = [b.column(k).take(pa.array(rows)) for k in (0, 1)] + [pa.array(prints[:, k].view(np.int64)) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", *WORDS])


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, f0..f3) of every row that has words."""
    some = docs.where("text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return map_arrow(some, _fingerprints, "doc_id bigint, hash bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0..f3) of every document that has words and a doc_id."""
    return _prints(docs).where("doc_id is not null").select("doc_id", *WORDS)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _first_pair(diff: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """The number of the first pair of blocks on which two codes agree."""
    spans, pairs = _layout(max_bits)
    same = [(diff & np.uint64(((1 << n) - 1) << s)) == 0 for s, n in spans]
    first = np.full(len(diff), len(pairs))
    for t in reversed(range(len(pairs))):
        i, j = pairs[t]
        first[same[i] & same[j]] = t
    return first


def search(bucket: np.ndarray, codes: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of one bucket whose codes differ in at most ``max_bits`` bits.

    bucket: numbers of the buckets, all rows of a bucket together; several buckets at once.
    """
    n = len(codes)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((gray_rank(codes), bucket))
    b, c = bucket[order], codes[order]
    new = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    size = np.diff(np.r_[new, n])
    group = np.repeat(np.arange(len(new)), size)

    # Nodes level by level; each level's nodes are runs of the one below, within a bucket.
    place = np.arange(n) - new[group]
    starts = np.flatnonzero(place % LEAF == 0)
    low, high = np.bitwise_and.reduceat(c, starts), np.bitwise_or.reduceat(c, starts)
    levels = [(starts, np.r_[starts[1:], n], low, high, group[starts])]
    while len(levels[-1][0]) > len(new):
        s, e, low, high, g = levels[-1]
        heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        k = np.arange(len(s)) - np.repeat(heads, np.diff(np.r_[heads, len(s)]))
        up = np.flatnonzero(k % FAN == 0)
        levels.append((up, np.r_[up[1:], len(s)], np.bitwise_and.reduceat(low, up), np.bitwise_or.reduceat(high, up), g[up]))
    levels.reverse()
    nodes, above = [], None
    for s, e, low, high, _ in levels:
        mask = ~(low ^ high)
        own = mask if above is None else mask & ~np.repeat(above[0], above[1])
        nodes.append((s, e, own, low & own))
        above = (mask, e - s)
    ends = [levels[-1][1]]  # past the last code of each node
    for s, e, *_ in reversed(levels[:-1]):
        ends.append(ends[-1][e - 1])
    ends.reverse()

    leaf, leaf_end, *_ = levels[-1]
    rows = c[np.minimum(leaf[:, None] + np.arange(LEAF), n - 1)]  # what is past a leaf's end is left out below
    found_i, found_j = [], []
    weight = np.cumsum(np.repeat(size, size))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + 1_000_000, "right")))
        q = np.arange(at, to)
        node, gone = group[at:to], np.zeros(to - at, np.int64)
        for depth, (s, e, mask, pattern) in enumerate(nodes):
            gone = gone + np.bitwise_count((c[q] ^ pattern[node]) & mask[node])
            keep = (gone <= max_bits) & (ends[depth][node] > q + 1)
            q, node, gone = q[keep], node[keep], gone[keep]
            if depth == len(nodes) - 1:
                break
            count = e[node] - s[node]
            base = np.repeat(s[node] - (np.cumsum(count) - count), count)
            node = base + np.arange(len(base))
            q, gone = np.repeat(q, count), np.repeat(gone, count)
        hit, lane = np.nonzero(np.bitwise_count(rows[node] ^ c[q][:, None]) <= max_bits)
        q, node, other = q[hit], node[hit], leaf[node[hit]] + lane
        hit = (other > q) & (other < leaf_end[node])
        found_i.append(order[q[hit]])
        found_j.append(order[other[hit]])
        at = to
    return np.concatenate(found_i), np.concatenate(found_j)


def _searcher(limits: list[int]):
    def whole(parts):
        bucket, code, doc = (np.concatenate([p[k] for p in parts]) for k in range(3))
        i, j = search(bucket, code, max(limits))
        word, pair = bucket[i] >> 24, bucket[i] >> 14 & 1023
        once = np.zeros(len(i), bool)
        for most in set(limits):
            own = np.flatnonzero(np.array(limits)[word] == most)
            once[own] = _first_pair(code[i[own]] ^ code[j[own]], most) == pair[own]  # they meet in other buckets too
        i, j = i[once], j[once]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j]))], names=["a", "b"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            bucket, code, doc = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            code = code.view(np.uint64)
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))  # sorted: the last bucket may go on
            if held + cut >= 200_000 and (cut or parts[-1][0][-1] != bucket[-1]):
                yield whole([*parts, (bucket[:cut], code[:cut], doc[:cut])])
                parts, held = [], 0
                bucket, code, doc = bucket[cut:], code[cut:], doc[cut:]
            parts.append((bucket, code, doc))
            held += len(bucket)
        if parts:
            yield whole(parts)

    return run


def near_pairs(unique: DataFrame, max_bits: int = MAX_BITS, max_all: int = MAX_ALL) -> DataFrame:
    """(a, b, bits): pairs of representatives that differ in at most ``max_bits`` bits of one of the
    codes, and ``max_all`` of all 256; with ``max_bits`` of a quarter of ``max_all`` that is every pair
    within ``max_all``. unique: (rep, f0..f3), no fingerprint twice. A pair comes once for each code by
    which it is found."""
    limits = _limits(max_bits, max_all)

    # Places are data, not 126 expressions: the code that Spark makes and the JVM compiles stays small.
    places = [(k, k << 24 | t << 14, *(x for s, n in (spans[i], spans[j]) for x in (s, (1 << n) - 1))) for k in range(SEARCHED) for spans, pairs in [_layout(limits[k])] for t, (i, j) in enumerate(pairs)]
    places = F.from_json(F.lit(json.dumps([dict(zip(("k", "base", "s", "m", "s2", "m2"), p, strict=True)) for p in places])), "array<struct<k:int,base:int,s:int,m:int,s2:int,m2:int>>")
    n = _scale.partitions(unique.sparkSession)
    rows = unique.select("rep", F.array(*WORDS[:SEARCHED]).alias("w"), F.explode(places).alias("p")).select("rep", F.expr("w[p.k]").alias("code"), "p.*")
    bucket = "base + shiftleft(cast(shiftrightunsigned(code, s) & m as int), 7) + cast(shiftrightunsigned(code, s2) & m2 as int)"
    rows = rows.select(F.expr(bucket).alias("bucket"), "code", "rep")
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket")
    pairs = map_arrow(rows, _searcher(limits), "a bigint, b bigint")
    left = unique.select(F.col("rep").alias("a"), *[F.col(w).alias(f"a{w}") for w in WORDS])
    right = unique.select(F.col("rep").alias("b"), *[F.col(w).alias(f"b{w}") for w in WORDS])
    bits = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in WORDS[1:]), F.bit_count(F.col("af0").bitwiseXOR(F.col("bf0"))))
    return pairs.join(left, "a").join(right, "b").select("a", "b", bits.alias("bits")).where(F.col("bits") <= max_all)


def _kept(docs: DataFrame, max_bits: int, max_all: int) -> DataFrame:
    """(doc_id, hash, times, kept_id, kept_hash) of every document that has words: the rows that it
    has, and the document kept of its group, which may be itself."""
    prints = _scale.stored(_prints(docs).groupBy("doc_id", "hash", *WORDS).agg(F.count("*").alias("times")), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")).alias("first")
    unique = _scale.range_sorted(prints.groupBy(*WORDS).agg(first).select(*WORDS, "first.*"), "unnamed", "doc_id", "hash")
    # Partitions are in order, so the smallest number of a group is its first document's.
    unique = _scale.stored(unique.select(F.monotonically_increasing_id().alias("rep"), *WORDS, F.col("doc_id").alias("kept_id"), F.col("hash").alias("kept_hash")), "unique")
    roots = _scale.stored(_scale.connected(near_pairs(unique.select("rep", *WORDS), max_bits, max_all)), "roots")
    named = unique.select(F.col("rep").alias("root"), "kept_id", "kept_hash")
    joined = unique.select("rep", *WORDS).join(roots, F.col("rep") == roots["node"], "left").select(*WORDS, F.coalesce("root", "rep").alias("root")).join(named, "root").drop("root")
    return prints.join(joined, list(WORDS)).select("doc_id", "hash", "times", "kept_id", "kept_hash")


_ITSELF = "doc_id <=> kept_id and hash = kept_hash"


def duplicates(docs: DataFrame, max_bits: int = MAX_BITS, max_all: int = MAX_ALL) -> DataFrame:
    """(doc_id, kept_id) of every document that isn't the one kept of its group, if it has a doc_id
    and another than that; kept_id is the smallest doc_id of the group."""
    return _kept(docs, max_bits, max_all).where("doc_id <> kept_id").select("doc_id", "kept_id").distinct()


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, max_all: int = MAX_ALL) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; columns as they were."""
    found = _kept(docs, max_bits, max_all).where(f"not ({_ITSELF}) or times > 1")
    found = _scale.stored(found.select("doc_id", "hash", F.expr(_ITSELF).alias("stays")), "found")
    count = found.agg(F.count("*"), F.count_if("stays")).first()
    some = _scale.small_enough(count[0], 24)

    def meet(keys, how):
        keys = keys.select(F.col("doc_id").alias("__gw_id"), F.col("hash").alias("__gw_hash"))
        keys = F.broadcast(keys) if some else keys
        return docs.join(keys, keys["__gw_id"].eqNullSafe(docs["doc_id"].cast("bigint")) & (keys["__gw_hash"] == F.xxhash64(docs["text"])), how)

    rest = meet(found, "left_anti")
    if not count[1]:
        return rest
    again = meet(found.where("stays"), "inner")
    columns = [_scale.column(again, c) for c in docs.columns]
    plain = [_scale.column(again, f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = again.groupBy("__gw_id", "__gw_hash").agg(F.min_by(F.struct(*columns), F.xxhash64(*plain)).alias("__gw_row"))
    return rest.unionAll(one.select("__gw_row.*"))
