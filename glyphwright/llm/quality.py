"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole documents are computed for a batch at once from its bytes. Trees are fitted on
labelled documents by histograms of gradients (logistic loss), with monotonic constraints: for some
statistics (signs, capitals, digits, repeats, ...) more of them can never raise the score. All trees are
flattened into numpy arrays of nodes; scoring walks all documents down a tree level by level.

Fitting uses at most ``max_rows`` labelled documents, in order of a seeded hash of doc_id; that is the
only bound. Labels with several values for a doc_id count as the mean of them (0.5 counts as good). Of
rows that share a doc_id the one whose text has the smallest hash is fitted on, so no more than
``max_rows`` rows come to the driver, whatever is repeated.

Defined cases: null and empty texts have all statistics 0 and get the score that belongs to that. Null
labels and labels of documents that aren't there don't count; with no labels at all, or all of one
kind, the score is the share of good ones (1.0 without any). Null or repeated doc_ids give a row each.
Of splits with the same gain the first statistic in order stands, and of its thresholds the smallest;
a score of just ``keep_from`` is kept. Very long texts are measured whole, one at a time. Other columns
are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import _scale, _text

#: Statistics, with the direction in which each may move the score: -1 never up, 1 never down, 0 free.
FEATURES = {
    "words": 0, "word_bytes": 0, "signs": -1, "capitals": -1, "digits": -1, "distinct_words": 0, "top_word": -1, "distinct_pairs": 1,
    "lines": 0, "line_bytes": 0, "distinct_lines": 1, "exclamations": -1, "bars": -1, "stops": 0, "foreign_bytes": 0,
}
MAX_ROWS, TREES, DEPTH, RATE, BINS, LEAST, SEED = 20_000, 80, 4, 0.15, 64, 20, 20240229
KEEP_FROM = 0.5


def _count(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(hit, dtype=np.int64)]
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _distinct(row: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent one's count, by row."""
    key, count = np.unique((row.astype(np.uint64) << np.uint64(44)) | (hashed >> np.uint64(20)), return_counts=True)
    own = (key >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, own, count)
    return np.bincount(own, minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """Documents x FEATURES."""
    out = [np.zeros((0, len(FEATURES)))]
    for _, _, data, offsets in _text.slabs(column):
        n, size = len(offsets) - 1, np.diff(offsets).astype(float)
        start, end, row = _text.words(data, offsets)
        hashed = _text.hashes(data, start, end)
        words = np.bincount(row, minlength=n).astype(float)
        word_bytes = np.bincount(row, end - start, n)
        distinct, most = _distinct(row, hashed, n)
        pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, int)
        pairs, _ = _distinct(row[pair], _text.mix(hashed[pair] * np.uint64(3) + hashed[pair + 1]), n)
        feed = data == 10
        cut = np.flatnonzero(feed)
        edges = np.unique(np.r_[offsets, cut, cut + 1])
        a, b = edges[:-1], edges[1:]
        line = (b > a) & ~feed[a] if len(a) else np.zeros(0, bool)
        a, b = a[line], b[line]
        line_row = np.searchsorted(offsets, a, "right") - 1
        lines = np.bincount(line_row, minlength=n).astype(float)
        distinct_lines, _ = _distinct(line_row, _text.hashes(data, a, b), n)
        upper = _count((data >= 65) & (data <= 90), offsets)
        letters = upper + _count((data >= 97) & (data <= 122), offsets)
        space = _count((data == 32) | feed | (data == 9) | (data == 13), offsets)
        per = lambda x, y: x / np.maximum(y, 1)
        out.append(np.stack([
            np.log1p(words), per(word_bytes, words), per(size - word_bytes - space, size), per(upper, letters), per(_count((data >= 48) & (data <= 57), offsets), size),
            per(distinct, np.sqrt(words)), per(most, words), per(pairs, np.maximum(words - 1, 1)), np.log1p(lines), np.log1p(per(size, lines)),
            per(distinct_lines, lines), per(_count(data == 33, offsets), words), per(_count(data == 124, offsets), words), per(_count(data == 46, offsets), words), per(_count(data >= 128, offsets), size),
        ], 1))
    return np.concatenate(out)


@dataclass
class Trees:
    """Nodes of all trees in one array: statistic, threshold (<= goes left), children; leaves are
    their own children. value: of leaves, in log odds."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone=tuple(FEATURES.values()), trees=TREES, depth=DEPTH, rate=RATE, bins=BINS, least=LEAST) -> Trees:
    """Boosting with logistic loss; y: 0 or 1. ``least``: rows in a leaf."""
    n, m = x.shape
    if not n or y.min() == y.max():
        share = float(y.mean()) if n else 1.0
        base = np.log((share + 1e-9) / (1 - share + 1e-9))
        empty = np.zeros(0, int)
        return Trees(empty, np.zeros(0), empty, empty, np.zeros(0), empty, base, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1)  # bin b: cuts[b-1] < x <= cuts[b]
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    sign = np.array(monotone)
    node = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def leaf(value):
        k = len(node["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", value)):
            node[name].append(v)
        return k

    flat = binned + np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        root = leaf(rate * g.sum() / (h.sum() + 1))
        roots.append(root)
        open_ = [(root, np.arange(n), -np.inf, np.inf)]
        for _ in range(depth):
            after = []
            for k, rows, low, high in open_:
                cells = flat[rows].ravel()
                sums = [np.bincount(cells, np.repeat(w, m), m * bins).reshape(m, bins).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = (s[:, :-1] for s in sums)
                gt, ht, nt = (s[:, -1:] for s in sums)
                vl = np.clip(gl / (hl + 1), low, high)
                vr = np.clip((gt - gl) / (ht - hl + 1), low, high)
                gain = 2 * gl * vl - (hl + 1) * vl**2 + 2 * (gt - gl) * vr - (ht - hl + 1) * vr**2
                v = np.clip(gt / (ht + 1), low, high)
                gain = gain - (2 * gt * v - (ht + 1) * v**2)
                good = (nl >= least) & (nt - nl >= least) & (sign[:, None] * (vr - vl) >= 0)
                good &= np.arange(bins - 1)[None, :] < np.array([len(c) for c in cuts])[:, None]
                gain = np.where(good, gain, -np.inf)
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] <= 1e-6:
                    continue
                goes = binned[rows, j] <= b
                middle = (vl[j, b] + vr[j, b]) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(sign[j])]
                a, c = leaf(rate * vl[j, b]), leaf(rate * vr[j, b])
                node["feature"][k], node["threshold"][k], node["left"][k], node["right"][k] = int(j), float(cuts[j][b]), a, c
                after += [(a, rows[goes], *bounds[0]), (c, rows[~goes], *bounds[1])]
            open_ = after
        at = np.full(n, root)
        feature, threshold, left, right, value = (np.array(node[k]) for k in ("feature", "threshold", "left", "right", "value"))
        for _ in range(depth):
            at = np.where(x[np.arange(n), feature[at]] <= threshold[at], left[at], right[at])
        margin += value[at]
    return Trees(*(np.array(node[k]) for k in ("feature", "threshold", "left", "right", "value")), np.array(roots), base, depth)


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    at = len(keep)

    def run(batches):
        for b in batches:
            x = statistics(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=[*keep, "x"])

    kept = docs.select(*keep, "text")
    return map_arrow(kept, run, ", ".join(f"{c} {t}" for c, t in kept.dtypes[:at]) + ", x array<double>")


def sample(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, statistics, labels) of at most ``max_rows`` labelled documents, one row for each."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg((F.avg(target) >= 0.5).cast("int").alias("y"))
    known = _scale.stored(known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_rows), "labels")
    few = F.broadcast(known)  # max_rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"), "text")
    # Of rows that share an id one is measured; which is settled on hashes, folded by each task.
    chosen = texts.join(few, texts["doc_id"] == few["id"]).groupBy("id").agg(F.min("hash").alias("hash"), F.first("y").alias("y"))
    chosen = F.broadcast(_scale.stored(chosen, "chosen"))
    rows = texts.join(chosen, (texts["doc_id"] == chosen["id"]) & (texts["hash"] == chosen["hash"])).select("id", "y", "text")
    rows = map_arrow(rows, _first_of_each, "id bigint, y int, text string")
    rows = _measured(rows, ["id", "y"]).groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.id)
    return np.array([r.id for r in rows]), np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], float)


def _first_of_each(batches):
    """A task's first row of each id; the rows of an id are equal."""
    seen: set[int] = set()
    for b in batches:
        ids = b.column(0).to_numpy()
        fresh = [int(i) for i in np.sort(np.unique(ids, return_index=True)[1]) if int(ids[i]) not in seen]
        seen.update(ids[fresh].tolist())
        yield b.take(pa.array(fresh, pa.int64()))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS, seed: int = SEED) -> Trees:
    _, x, y = sample(docs, labels, target, max_rows, seed)
    return fit(x, y)


def score(docs: DataFrame, trees: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, score, keep): score is the estimated chance of being good."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            s = shared.value.score(statistics(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= keep_from)], names=["doc_id", "score", "keep"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, score double, keep boolean")
