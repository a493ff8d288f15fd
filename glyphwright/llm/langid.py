"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a sample of labelled text. A document is parsed
against it from left to right into the longest phrases that occur in the sample; a language's score
is phrases * log2(length of sample) / length, an estimate of the bits a letter takes if one knows that
language. The language with the lowest score wins (ties: the first by name); if even that score is
above the limit, or there is no letter, the document is of no known language ("und") and rejected. The
limit falls with the length: ``long_bits`` and 100 bits besides, dealt to all classes of the text, and
``max_bits`` at most, as a few words say little and any long text repeats some of a sample.

Text is read as classes of bytes: ASCII letters without case, other bytes each by itself, and all other
ASCII as one separator, runs of which count once. Whole documents are parsed. The blocks of a batch go
through the dense transition table in lockstep with numpy, each as if a phrase began with it; then
every block is entered anew in the state in which the one before it was left, and walked beside the
first walk until the two are in the same state, from where they agree. So the phrases are those of the
document as a whole, wherever blocks and batches end.

The sample is the only bounded thing: of each language at most ``sample_docs`` different documents, in
order of a seeded hash, each taken whole while all of them have no more than ``sample_bytes`` bytes. If
no document of a language is that short, its shortest one stands alone. The tables' size follows from
that bound and the number of languages; they are broadcast. Rows are chosen, not ids, and rows that
repeat one count once, so neither null nor repeated doc_ids can add to what the driver gets.

Defined cases: null and empty texts are "und". A null label is no label; without any labelled text
every document is "und". Null or repeated doc_ids give a row each, as they come. Ties of score go to
the language that is first by name, ties in the sample's order to the smaller hash of the text. Other
columns are never read, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..shipping import map_arrow
from . import _scale, _text
from .automaton import build

SAMPLE_DOCS, SAMPLE_BYTES, SEED = 64, 24_000, 20240229
MAX_BITS = 9.0  # letters drawn at random need over 11, the shortest documents in a known language up to 7
LONG_BITS, SLACK = 4.5, 100.0  # long documents in a known language mostly need under 4.3, other languages and code mostly over 5
BLOCK, SLAB = 1024, 2 << 20  # classes that are walked side by side; bytes taken at a time
NONE = "und"


class Model:
    """languages: names; classes: of each byte; table: next states of all languages in one array,
    a state being the place of its row; the lowest bit of an entry says that a phrase begins."""

    def __init__(self, samples: dict[str, list[np.ndarray]]):
        """samples: per language the bytes of some documents."""
        self.languages = sorted(samples)
        used = np.zeros(256, bool)
        for docs in samples.values():
            for d in docs:
                used[np.unique(d)] = True
        self.classes = np.zeros(256, np.uint8)
        self.classes[97:123] = self.classes[65:91] = np.arange(1, 27)
        high = np.flatnonzero(used[128:]) + 128
        self.width = 27 + len(high) + 1
        self.classes[128:] = self.width - 1  # bytes that no sample has
        self.classes[high] = 27 + np.arange(len(high))
        tables, self.roots, self.bits, at = [], [], [], 0
        for name in self.languages:
            texts = [self.read(d, np.array([0, len(d)]))[0].tolist() for d in samples[name]]
            move = build(texts)[0]
            t = np.full((len(move), self.width), -1, np.int64)
            for s, out in enumerate(move):
                t[s, list(out)] = list(out.values())
            root = t[0].copy()
            begin = (np.maximum(root, 0) * self.width + at) << 1 | 1
            t = np.where(t < 0, begin[None, :], (t * self.width + at) << 1)
            t[0] = begin
            tables.append(t.ravel())
            self.roots.append(at)
            self.bits.append(np.log2(max(2, sum(map(len, texts)))))
            at += t.size
        if at >= 1 << 30:
            raise ValueError("the samples are too large for one table")
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32)
        self.roots, self.bits = np.array(self.roots, np.int32), np.array(self.bits)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes with runs of separators folded and leading ones left out; new offsets."""
        c = self.classes[data]
        before = np.r_[np.uint8(0), c[:-1]] if len(c) else c
        before[offsets[:-1][offsets[:-1] < len(c)]] = 0
        keep = (c != 0) | (before != 0)
        ends = np.zeros(len(c) + 1, np.int32)
        np.cumsum(keep, dtype=np.int32, out=ends[1:])
        return c[keep], ends[offsets].astype(np.int64)

    def phrases(self, classes: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Phrases of each document against each language."""
        size = np.diff(offsets)
        count = -(-size // block)
        own = np.repeat(np.arange(len(size)), count)
        k = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[:-1][own] + k * block
        length = np.minimum(size[own] - k * block, block)
        order = np.argsort(-length, kind="stable")
        at, longest = start[order], length[order]
        state = np.repeat(self.roots[:, None], len(start), 1)
        begun = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-longest, -np.arange(1, (longest[0] if len(longest) else 0) + 1), "right")
        for step, n in enumerate(active.tolist()):
            to = self.table.take(state[:, :n] + classes[at[:n] + step])
            begun[:, :n] += to & 1
            state[:, :n] = to >> 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        begun, state = begun[:, back], state[:, back]
        if (k > 0).any():
            begun = self._carried(classes, start, length, k, begun, state)
        found = np.zeros((len(self.languages), len(size)), np.int64)
        for i in range(len(self.languages)):
            found[i] = np.bincount(own, begun[i], len(size))
        return found.T

    def _carried(self, classes, start, length, k, begun, left):
        """``begun`` with every block entered in the state in which the one before is left, not at a
        root. left: the states at the ends of blocks that were entered at a root."""
        total, end = begun.copy(), left.copy()
        lang, block = np.nonzero(np.broadcast_to(k > 0, begun.shape))
        while len(block):
            lone, ours = self.roots[lang], end[lang, block - 1]
            more = np.zeros(len(block), np.int32)
            open_, step = np.flatnonzero(lone != ours), 0
            final = left[lang, block]
            while len(open_):
                c = classes[start[block[open_]] + step]
                a, b = self.table.take(lone[open_] + c), self.table.take(ours[open_] + c)
                more[open_] += (b & 1) - (a & 1)
                lone[open_], ours[open_] = a >> 1, b >> 1
                step += 1
                apart = lone[open_] != ours[open_]
                over = apart & (length[block[open_]] <= step)
                final[open_[over]] = ours[open_[over]]
                open_ = open_[apart & ~over]
            total[lang, block] = begun[lang, block] + more
            changed = (end[lang, block] != final) & (block + 1 < len(k))
            end[lang, block] = final
            again = changed & (k[np.minimum(block + 1, len(k) - 1)] > 0)
            lang, block = lang[again], block[again] + 1
        return total

    def scores(self, column: pa.Array) -> np.ndarray:
        """Bits a letter, documents x languages; nan without letters."""
        return self.measured(column)[0]

    def measured(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`scores`, and the classes of each document."""
        out, sizes = [np.zeros((0, len(self.languages)))], [np.zeros(0, np.int64)]
        for _, _, data, offsets in _text.slabs(column, SLAB):
            classes, new = self.read(data, offsets)
            size = np.diff(new)
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(self.phrases(classes, new) * self.bits / size[:, None])
            sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes)


def limits(size: np.ndarray, max_bits: float = MAX_BITS, long_bits: float = LONG_BITS) -> np.ndarray:
    """The most bits a letter at which a document of so many classes is accepted."""
    return np.minimum(max_bits, long_bits + SLACK / np.maximum(size, 1))


def _once(batches):
    """One row for each (label, n) that a task has; columns: label, n, ..."""
    seen = set()
    for b in batches:
        fresh = []
        for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                fresh.append(i)
        yield b.take(pa.array(fresh, pa.int64()))


def _front(most: int):
    """Of each label the first ``most`` different (long, order, hash) that a task has."""

    def first(table: pa.Table) -> pa.Table:
        table = table.group_by(table.column_names).aggregate([]).sort_by([(c, "ascending") for c in table.column_names])
        codes = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
        return table.filter(pa.array(place < most))

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows:
                new = pa.Table.from_batches([b])
                held = first(new if held is None else pa.concat_tables([held, new]))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def sample(docs: DataFrame, label: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, seed: int = SEED) -> DataFrame:
    """(label, n, bytes): the chosen documents of each label, numbered from 1 in their order; each once,
    and no more than ``sample_docs`` or ``sample_bytes`` of a label unless its shortest is longer."""
    size = F.octet_length("text")
    rows = docs.where(F.col(label).isNotNull() & (size > 0)).select(
        F.col(label).alias("label"), F.when(size > sample_bytes, size).otherwise(0).alias("long"), size.alias("size"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), F.lit(seed)).alias("order"), F.xxhash64("text").alias("hash"),
    )
    # Each task sends sample_docs small rows of a label at most, however often a row is repeated.
    front = map_arrow(rows.select("label", "long", "order", "hash", "size"), _front(sample_docs), "label string, long int, order bigint, hash bigint, size int").distinct()
    first = W.partitionBy("label").orderBy("long", "order", "hash")
    upto = F.sum("size").over(first.rowsBetween(W.unboundedPreceding, 0))
    chosen = front.withColumns({"n": F.row_number().over(first), "upto": upto}).where((F.col("n") <= sample_docs) & ((F.col("upto") <= sample_bytes) | (F.col("n") == 1))).select("label", "order", "hash", "n")
    chosen = _scale.stored(chosen, "sample")
    text = docs.where(size > 0).select(F.col(label).alias("__label"), F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), F.lit(seed)).alias("__order"), F.xxhash64("text").alias("__hash"), "text")
    # At most sample_docs small rows for each label; without a hint Spark decides by size.
    got = text.join(chosen, (F.col("__label") == chosen["label"]) & (F.col("__order") == chosen["order"]) & (F.col("__hash") == chosen["hash"]))
    few = map_arrow(got.select("label", "n", F.encode("text", "utf-8").alias("bytes")), _once, "label string, n int, bytes binary")
    return few.groupBy("label", "n").agg(F.min("bytes").alias("bytes"))


def train(docs: DataFrame, label: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, seed: int = SEED) -> Model:
    """Fit on the :func:`sample` of each language."""
    samples: dict[str, list[np.ndarray]] = {}
    for r in sorted(sample(docs, label, sample_docs, sample_bytes, seed).collect(), key=lambda r: (r.label, r.n)):
        samples.setdefault(r.label, []).append(np.frombuffer(bytes(r.bytes), np.uint8))
    return Model(samples)


def identify(docs: DataFrame, model: Model | None = None, max_bits: float = MAX_BITS, keep: list[str] | None = None, long_bits: float = LONG_BITS) -> DataFrame:
    """The columns ``keep`` (default: doc_id) with language, bits (its score) and accepted."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id"] if keep is None else keep
    at = len(keep)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, NONE], dtype=object)
        for b in batches:
            bits, size = m.measured(b.column(at))
            if len(m.languages):
                best = np.nan_to_num(bits, nan=np.inf).argmin(1)
                score = bits[np.arange(len(best)), best] if len(best) else np.zeros(0)
            else:
                best, score = np.zeros(b.num_rows, int), np.full(b.num_rows, np.nan)
            ok = score <= limits(size, max_bits, long_bits)  # nan isn't
            best = np.where(ok, best, len(m.languages))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(names[best], pa.string()), pa.array(score, pa.float64(), mask=np.isnan(score)), pa.array(ok)], names=[*b.schema.names[:at], "language", "bits", "accepted"])

    kept = docs.select(*keep, F.col("text").alias("__text"))
    schema = StructType([*kept.schema.fields[:at], StructField("language", StringType()), StructField("bits", DoubleType()), StructField("accepted", BooleanType())])
    return map_arrow(kept, run, schema)


def keep_known(docs: DataFrame, model: Model | None = None, max_bits: float = MAX_BITS, long_bits: float = LONG_BITS) -> DataFrame:
    """``docs`` without what is of no known language; columns as they were. The verdict is a
    narrow pass on the rows themselves."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for b in batches:
            bits, size = shared.value.measured(b.column(at))
            ok = np.nan_to_num(bits, nan=np.inf).min(1, initial=np.inf) <= limits(size, max_bits, long_bits)
            yield b.filter(pa.array(ok))

    return map_arrow(docs, run, docs.schema)
