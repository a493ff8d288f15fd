"""Identifiers and findings of whole Arrow columns.

The grammar of :mod:`tokens` never looks across white space, quotes, angle or square brackets, so a text
falls into fields that can be read by themselves. Most fields are a plain word with punctuation;
numpy finds those for a whole batch at once, looks their words up by hash, and only what a lexicon may
know is looked at one by one. Other fields, and words of mixed case or letters beyond Latin-1, are read
once for each different one and remembered for the batches that follow.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import tokens as T

#: Bytes of text that are taken at a time (a longer row is taken whole).
SLAB = 1 << 20
#: Different tokens remembered, each of so many bytes and parts at most.
REMEMBERED, REMEMBERED_BYTES, REMEMBERED_PARTS = 1 << 15, 128, 8
_HARD, _LETTER, _WORD, _BAD_BEFORE, _BAD_AFTER, _UPPER, _FEED = 1, 2, 4, 8, 16, 32, 64
_FLAGS = np.zeros(256, np.uint8)
for _flag, _bytes in (
    (_HARD, b' \t\n\r\x0b\x0c"<>[]'), (_LETTER | _WORD, bytes([*range(65, 91), *range(97, 123)])), (_WORD, b"0123456789_" + bytes(range(128, 256))),
    (_BAD_BEFORE, b"\\%#"), (_BAD_AFTER, b"@/=+"), (_UPPER, bytes(range(65, 91))), (_FEED, b"\n"),
):
    _FLAGS[list(_bytes)] |= _flag
#: Bytes of a plain word, which is of letters of ASCII or Latin-1; longer ones may be keys or hashes.
PLAIN = 31
_PLAIN_KEY = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The first byte of a letter of Latin-1; the second ones that are no letters' (× and ÷).
_LEAD, _NO_LETTERS = 0xC3, (0x97, 0xB7)


def _python(pattern: str) -> str:
    return pattern.replace(r"\G", "").replace(r"\z", r"\Z").replace(r"\p{Is", r"\p{")


IDENTIFIER, UPPER_HASHES = (regex.compile(_python(T.pattern(r"\p{XID_Continue}", x))) for x in (T.LITERALS, T.UPPER_HASHES))
WORD = regex.compile(_python(T.WORD_PATTERN))
_ALL_UPPER, _STARTS_UPPER = regex.compile(r"\p{Uppercase}+"), regex.compile(r"\p{Uppercase}")
_UP = {ord(a): ord(b) for a, b in zip(T._LOWER, T._UPPER, strict=True)}
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SMALL = np.uint64(0x2020202020202020)
_none = np.zeros(0, np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) > 1 else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slabs(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about ``size`` bytes."""
    data, offsets = raw(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (size or SLAB), "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _distinct(data, start, end) -> tuple[list[bytes], np.ndarray]:
    coded = _slices(data, start, end).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _spread(codes: np.ndarray, lists: Sequence[Sequence]) -> tuple[np.ndarray, list]:
    """What the lists at ``codes`` hold, one after the other, and to which of the codes each belongs."""
    count = np.array([len(x) for x in lists], np.int64)
    first = np.cumsum(count) - count
    flat = [x for part in lists for x in part]
    n = count[codes]
    owner = np.repeat(np.arange(len(codes)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[codes][owner]
    return owner, [flat, at]


_fields: dict[tuple[bytes, bool, bool], tuple] = {}


def parse(field_: bytes, first: bool = True, upper_hashes: bool = False) -> tuple[tuple[int, int], ...]:
    """(start, end) in bytes of the identifiers of a text; ``first``: nothing stands before it;
    ``upper_hashes``: hashes in upper case are identifiers."""
    key = (field_, first, upper_hashes)
    if key in _fields:
        return _fields[key]
    text, out, pos = field_.decode(), [], 0
    if not first:
        text = " " + text
    grammar = UPPER_HASHES if upper_hashes else IDENTIFIER
    while found := grammar.match(text, pos):
        out.append(found.span(2))
        pos = found.end()
    skip = 0 if first else 1
    if len(text) - skip == len(field_):
        spans = tuple((a - skip, b - skip) for a, b in out)
    else:
        spans, at, size = [], skip, 0
        for a, b in out:
            size += len(text[at:a].encode())
            n = len(text[a:b].encode())
            spans.append((size, size + n))
            at, size = b, size + n
        spans = tuple(spans)
    if len(field_) <= REMEMBERED_BYTES and len(spans) <= REMEMBERED_PARTS:
        if len(_fields) >= REMEMBERED:
            _fields.clear()
        _fields[key] = spans
    return spans


def identifiers(data: np.ndarray, cuts: np.ndarray, holes: np.ndarray | None = None, upper_hashes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, plain) of the identifiers in order. cuts: where a text begins; holes: bytes that
    belong to no text; plain: whether it's a plain word."""
    n = len(data)
    if not n:
        return _none, _none, np.zeros(0, bool)
    flags = _FLAGS[data]
    lead = data == _LEAD
    if lead.any():
        letter = np.zeros(n + 1, bool)
        letter[1:n] = lead[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != _NO_LETTERS[0]) & (data[1:] != _NO_LETTERS[1])
        flags[letter[:-1] | letter[1:]] |= _LETTER
    hard = (flags & _HARD) != 0
    if holes is not None:
        hard[holes] = True
        flags[holes] = _HARD
    cuts = cuts[cuts < n]
    begin, stop = ~hard, ~hard
    begin[1:] &= hard[:-1]
    begin[cuts] = ~hard[cuts]
    stop[:-1] &= hard[1:]
    before = cuts[cuts > 0] - 1
    stop[before] = ~hard[before]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    word = (flags & _WORD) != 0
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    starts[a] = word[a]
    ends[:-1] &= ~word[1:]
    ends[b - 1] = word[b - 1]
    p, q = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(p):
        return _none, _none, np.zeros(0, bool)
    own = np.cumsum(begin, dtype=np.int32)[p] - 1  # the field of each run of word characters
    opening = np.zeros(n, bool)
    opening[cuts] = True
    counts = []
    for flag, hit in ((_LETTER, word & ((flags & _LETTER) == 0)), (_BAD_BEFORE, (flags & _BAD_BEFORE) != 0), (_BAD_AFTER, (flags & _BAD_AFTER) != 0)):
        c = np.zeros(n + 1, np.int32)
        np.cumsum(hit, out=c[1:])
        counts.append(c)
    other, bad_before, bad_after = counts
    fa, fb = a[own], b[own]
    again = own[1:] == own[:-1]
    ok = (q - p <= PLAIN) & (other[q] == other[p]) & (bad_before[p] == bad_before[fa]) & (bad_after[fb] == bad_after[q]) & (~opening[fa] | (p == fa))
    ok[1:] &= ~again
    ok[:-1] &= ~again
    rest = np.unique(own[~ok])
    found = [(p[ok], q[ok])]
    plain = [np.ones(len(found[0][0]), bool)]
    for first in (True, False):
        fields_ = rest[opening[a[rest]] == first]
        if len(fields_):
            values, codes = _distinct(data, a[fields_], b[fields_])
            owner, (flat, at) = _spread(codes, [parse(v, first, upper_hashes) for v in values])
            spans = np.array(flat, np.int64).reshape(-1, 2)[at]
            base = a[fields_][owner]
            s, e = base + spans[:, 0], base + spans[:, 1]
            found.append((s, e))
            plain.append((e - s <= PLAIN) & (other[e] == other[s]))
    start, end, plain = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate(plain)
    order = np.argsort(start, kind="stable")
    return start[order], end[order], plain[order]


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Where texts begin, and the bytes between them, if rows needn't be UTF-8: each valid piece
    between invalid sequences is a text."""
    cuts, holes = [offsets[:-1]], []
    high = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data >= 128, out=high[1:])
    for r in np.flatnonzero(high[offsets[1:]] > high[offsets[:-1]]):
        row, at = bytes(data[offsets[r] : offsets[r + 1]]), 0
        while at < len(row):
            try:
                row[at:].decode()
                break
            except UnicodeDecodeError as e:
                end = len(row) if e.reason == "unexpected end of data" else at + e.end
                holes.append(np.arange(offsets[r] + at + e.start, offsets[r] + end))
                cuts.append(np.array([offsets[r] + end]))
                at = end
    if not holes:
        return offsets[:-1], None
    return np.unique(np.concatenate(cuts)), np.concatenate(holes)


def _bytewise(data, offsets, upper_hashes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of rows beyond ASCII when bytes are read one by one; what follows the first that
    isn't UTF-8 isn't read."""
    found, grammar = [], UPPER_HASHES if upper_hashes else IDENTIFIER
    for r in range(len(offsets) - 1):
        text, pos = bytes(data[offsets[r] : offsets[r + 1]]).decode("latin-1"), 0
        if text.isascii():
            continue
        while hit := grammar.match(text, pos):
            try:
                hit[2].encode("latin-1").decode()
            except UnicodeDecodeError:
                break
            found.append((offsets[r] + hit.start(2), offsets[r] + hit.end(2)))
            pos = hit.end()
    spans = np.array(found, np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


def of_rows(data: np.ndarray, offsets: np.ndarray, unicode: bool = True, valid: bool = True, upper_hashes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, plain) of the identifiers of rows; ``valid``: all rows are UTF-8; ``upper_hashes`` as in :func:`parse`."""
    if unicode:
        cuts, holes = (offsets[:-1], None) if valid else _chunks(data, offsets)
        return identifiers(data, cuts, holes, upper_hashes)
    high = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data >= 128, out=high[1:])
    odd = high[offsets[1:]] > high[offsets[:-1]]
    holes = np.flatnonzero(np.repeat(odd, np.diff(offsets)))
    start, end, plain = identifiers(data, offsets[:-1], holes if len(holes) else None, upper_hashes)
    if not len(holes):
        return start, end, plain
    more = _bytewise(data, offsets, upper_hashes)
    start, end, plain = np.r_[start, more[0]], np.r_[end, more[1]], np.r_[plain, np.zeros(len(more[0]), bool)]
    order = np.argsort(start, kind="stable")
    return start[order], end[order], plain[order]


def _lists(texts: pa.Array, unicode: bool, upper_hashes: bool, values) -> pa.Array:
    """A list for each text: ``values(data, start, end, first)`` of its identifiers."""
    counts, parts = [np.zeros(1, np.int32)], []
    for _, _, data, offsets in slabs(texts):
        start, end, _ = of_rows(data, offsets, unicode, upper_hashes=upper_hashes)
        at = np.searchsorted(start, offsets)
        counts.append(np.diff(at).astype(np.int32))
        parts.append(values(data, start, end, np.repeat(offsets[:-1], np.diff(at))))
    ends = pa.array(np.cumsum(np.concatenate(counts), dtype=np.int32))
    if texts.null_count:  # a list begins with a null offset where the row is null
        ends = pa.array(ends.to_numpy(), pa.int32(), mask=np.r_[texts.is_null().to_numpy(zero_copy_only=False), False])
    return pa.ListArray.from_arrays(ends, pa.concat_arrays(parts) if parts else values(np.zeros(0, np.uint8), _none, _none, _none))


def identifiers_column(text: Column, unicode: bool = True, upper_hashes: bool = False) -> Column:
    """The identifiers of a text in order, as :func:`tokens.identifiers` gives them; ``upper_hashes`` as in :func:`parse`."""
    ship(SparkSession.active())

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return _lists(texts, unicode, upper_hashes, lambda data, start, end, first: _slices(data, start, end).cast(pa.string()))

    return found(text)


def offsets_column(text: Column, unicode: bool = True, upper_hashes: bool = False) -> Column:
    """Where in bytes the identifiers of a text begin; aligned with :func:`identifiers_column`."""
    ship(SparkSession.active())

    @F.arrow_udf("array<bigint>")
    def found(texts: pa.Array) -> pa.Array:
        return _lists(texts, unicode, upper_hashes, lambda data, start, end, first: pa.array(start - first, pa.int64()))

    return found(text)


def _packed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of plain words, the same for upper and lower case, and now and then for other letters."""
    padded = np.concatenate([data, np.zeros(40, np.uint8)])
    words = np.ndarray((len(padded) - 7,), np.uint64, padded, strides=(1,))
    size = end - start
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, PLAIN, 8):
        some = slice(None) if not k else np.flatnonzero(size > k)
        if k and not len(some):
            break
        mask = _MASK[np.minimum(size[some] - k, 8)]
        x = (words[start[some] + k] | _SMALL) & mask
        x = (out[some] ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        out[some] = x ^ (x >> np.uint64(29))
    return out


def _single(data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Which identifiers are surely one word: in lower case but for the first letter, or all in upper case."""
    high, lead = (data >= 65) & (data <= 90), data == _LEAD
    if lead.any():
        high[1:] |= lead[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = np.zeros(len(data) + 1, np.int32)
    np.cumsum(high, out=upper[1:])
    capitals = upper[end] - upper[start]
    return plain & ((capitals == upper[start + 1 + lead[start]] - upper[start]) | (capitals == end - start))


def _word_spans(token: bytes) -> list[tuple[int, int, int]]:
    text = token.decode()
    size: Callable[[int], int] = (lambda n: n) if len(text) == len(token) else (lambda n: len(text[:n].encode()))
    return [(size(m.start()), size(m.end()), i) for i, m in enumerate(WORD.finditer(text))]


def words(data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, which from 0 in its identifier) of the words of identifiers; not in order."""
    if not len(start):
        return _none, _none, _none
    single = _single(data, start, end, plain)
    rest = np.flatnonzero(~single)
    first, last = start[single], end[single]
    if not len(rest):
        return first, last, np.zeros(len(first), np.int64)
    values, codes = _distinct(data, start[rest], end[rest])
    owner, (flat, at) = _spread(codes, [_word_spans(v) for v in values])
    spans, base = np.array(flat, np.int64).reshape(-1, 3)[at], start[rest][owner]
    return np.r_[first, base + spans[:, 0]], np.r_[last, base + spans[:, 1]], np.r_[np.zeros(len(first), np.int64), spans[:, 2]]


def case_of(word: str) -> str:
    """Of a word that isn't a number."""
    return "Upper" if _ALL_UPPER.fullmatch(word) else "Title" if _STARTS_UPPER.match(word) else "Lower"


def in_case(correction: str, case: str) -> str:
    return correction[:1].translate(_UP) + correction[1:] if case == "Title" else correction.translate(_UP) if case == "Upper" else correction


Verdict = tuple[str, tuple[str, ...]]


@dataclass
class Matcher:
    """What a task needs to find misspellings. words: by key in lower case; names: by exact spelling;
    both (status, corrections). Findings of names are left to another matcher if not ``own_names``."""

    words: Mapping[str, Verdict]
    names: Mapping[str, Verdict]
    ignore_names: Sequence[str] = ()
    ignore_words: Sequence[str] = ()
    own_names: bool = True
    keys: np.ndarray = field(init=False)

    def __post_init__(self):
        plain = sorted({k.lower().encode() for k in (*self.words, *self.names) if _PLAIN_KEY.fullmatch(k)})
        plain = [k for k in plain if len(k) <= PLAIN]
        data = np.frombuffer(b"".join(plain), np.uint8)
        ends = np.cumsum([len(k) for k in plain], dtype=np.int64)
        self.keys = np.unique(_packed(data, np.r_[0, ends[:-1]].astype(np.int64), ends)) if plain else np.zeros(0, np.uint64)

    def ready(self) -> Matcher:
        if not hasattr(self, "maybe"):
            self.maybe = np.zeros(1 << 20, bool)
            self.maybe[self.keys >> np.uint64(44)] = True
            self.skip_names, self.skip_words = ([regex.compile(_python(p)) for p in x] for x in (self.ignore_names, self.ignore_words))
            self.known: dict[bytes, tuple] = {}
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("maybe", "skip_names", "skip_words", "known")}

    def evaluate(self, token: bytes) -> tuple:
        """Findings of one identifier: (kind, offset, typo, status, corrections)."""
        if token in self.known:
            return self.known[token]
        text, out = token.decode(), []
        name = self.names.get(text)
        if name or any(p.search(text) for p in self.skip_names):
            if name and name[0] != "Valid" and self.own_names and not any(p.search(text) for p in self.skip_names):
                out.append(("identifier", 0, text, *name))
        else:
            for hit in WORD.finditer(text):
                word = hit[0]
                if word[0] in "0123456789":
                    continue
                verdict = self.words.get(word.lower())
                if verdict is None or verdict[0] == "Valid" or any(p.search(word) for p in self.skip_words):
                    continue
                case = case_of(word)
                out.append(("word", len(text[: hit.start()].encode()), word, verdict[0], tuple(in_case(c, case) for c in verdict[1])))
        found = tuple(out)
        if len(token) <= REMEMBERED_BYTES and len(found) <= REMEMBERED_PARTS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = found
        return found

    def find(self, data: np.ndarray, offsets: np.ndarray, unicode: bool = True, valid: bool = True) -> tuple[np.ndarray, list[tuple]]:
        """Places of the findings of rows in order, and the findings."""
        start, end, plain = of_rows(data, offsets, unicode, valid)
        if not len(start):
            return _none, []
        single = _single(data, start, end, plain)
        one = np.flatnonzero(single)
        hashed = _packed(data, start[one], end[one])
        hit = self.maybe[hashed >> np.uint64(44)]
        one, hashed = one[hit], hashed[hit]
        if len(self.keys):
            one = one[self.keys[np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)] == hashed]
        ask = np.sort(np.concatenate([one, np.flatnonzero(~single)]))
        if not len(ask):
            return _none, []
        values, codes = _distinct(data, start[ask], end[ask])
        owner, (flat, at) = _spread(codes, [self.evaluate(v) for v in values])
        found = [flat[i] for i in at.tolist()]
        return start[ask][owner] + np.array([f[1] for f in found], np.int64), found


def lines(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers from 1, and where the lines begin, of places in rows."""
    feeds = np.flatnonzero(data == 10)
    before, first = np.searchsorted(feeds, place), np.searchsorted(feeds, offsets[:-1])[row]
    begin = np.where(before > first, feeds[np.maximum(before - 1, 0)] + 1 if len(feeds) else 0, offsets[:-1][row])
    return before - first + 1, begin


def blocks(text: bytes, patterns: Sequence[re.Pattern]) -> list[tuple[int, int]]:
    """The places that any of the expressions matches, in bytes; none in what isn't UTF-8."""
    try:
        t = text.decode()
    except UnicodeDecodeError:
        return []
    size: Callable[[int], int] = (lambda n: n) if len(t) == len(text) else (lambda n: len(t[:n].encode()))
    return [(size(m.start()), size(m.end())) for p in patterns for m in p.finditer(t)]
