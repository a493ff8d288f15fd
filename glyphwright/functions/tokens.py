"""Identifiers and words of text, as native column expressions.

The grammar is an ordered choice without backtracking, which a Java regular expression can state
exactly: every alternative is an atomic group and every repetition possessive. What isn't language
(addresses, keys, hashes, numbers, colours, escapes, ...) is skipped, provided that a separator follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_WORD = "[A-Za-z0-9_]"
UNICODE_WORD = r"(?:[A-Za-z0-9_]|(?![\x00-\x7F])[\p{javaUnicodeIdentifierPart}&&[^\p{javaIdentifierIgnorable}]])"
_LOCAL = r"[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~().]"
_DOMAIN = r"[A-Za-z0-9\-().]"
_B64 = "[A-Za-z0-9+/]"
CAP = 1023

#: What is skipped, in order; {W} is one character of an identifier.
LITERALS = {
    "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}",
    "email": rf"{_LOCAL}{{1,{CAP}}}+@{_DOMAIN}++",
    "url": rf"(?>[a-z0-9+.\-]{{1,{CAP}}}+://)?+(?>{_LOCAL}{{1,{CAP}}}+(?::{_LOCAL}{{0,{CAP}}}+)?+@)?+{_DOMAIN}{{1,{CAP}}}+(?::[0-9]{{1,{CAP}}}+)?+/[A-Za-z0-9\-._~!$&'()*+,;=%:@/?#]*+",
    "jwt": r"ey[A-Za-z0-9_\-]{20,}+\.ey[A-Za-z0-9_\-]{20,}+\.[A-Za-z0-9_\-]{20,}+",
    "ssh_key": r"AAAAC3NzaC1lZDI1NTE5AAAAI[A-Za-z0-9+/]{43}",
    "base64": rf"(?:{_B64}{{4}})*+(?:{_B64}{{3}}(?!{_B64})=|{_B64}{{2}}(?!{_B64})==|{_B64}(?!{_B64})===)|(?=[A-Za-z0-9]*+[+/])(?:{_B64}{{4}})++(?!{_B64})|(?:{_B64}{{4}}){{23,}}+(?!{_B64})",
    "hash": "[0-9a-f]{32,}+|[0-9A-F]{32,}+",
    "ordinal": "_*+[0-9]++(?:st|nd|rd|th)_*+",
    "hex": "0[xX][0-9a-fA-F_']++{W}*+",
    "decimal": "[0-9_']++",
    "colour": "#(?>[0-9a-f]{3,8}+(?!{W})|[0-9A-F]{3,8}+(?!{W}))",
    "escape": rf"\\{{1,{CAP}}}+{{W}}*+",
    "printf": "%{W}++",
}

#: The same, but hashes in upper case are identifiers.
UPPER_HASHES = LITERALS | {"base64": rf"(?![0-9A-F]{{32,}}+(?!{{W}}))(?:{LITERALS['base64']})", "hash": "[0-9a-f]{32,}+"}


#: A short word of letters alone, and what may follow it if it begins no literal; tried first, as nearly
#: all words are such. (Of letters alone a hash has 32 or more.)
_PLAIN = r"""\p{L}{1,31}+[.!?]*+(?:[\s,;"<>\[\]]|\z)"""


def _alternatives(word: str, literals: dict[str, str]) -> str:
    other = rf"(?!{word})(?s:.)"
    ignorable = rf"(?!{word})[^\\%#]"
    if word == ASCII_WORD:
        other, ignorable = "[^A-Za-z0-9_]", r"[^A-Za-z0-9_\\%#]"
    separator = rf"(?>(?:{ignorable})++|(?!{word}))"
    skipped = "|".join(f"(?>{p.replace('{W}', word)}){separator}" for p in literals.values())
    return f"(?!{_PLAIN})(?>{skipped})|{other}(?:{ignorable})*+"


def pattern(word: str, literals: dict[str, str] = LITERALS) -> str:
    """Group 1: all that is skipped before an identifier; group 2: the identifier."""
    return rf"\G((?>{_alternatives(word, literals)})*+)({word}++)"


ASCII_PATTERN, UNICODE_PATTERN = pattern(ASCII_WORD), pattern(UNICODE_WORD)
WORD_PATTERN = r"\p{IsUppercase}+(?!\p{IsLowercase})|\p{IsUppercase}?\p{IsLowercase}+|[0-9]+"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _extract(text: Column, group: int) -> Column:
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(group))
    return F.when(is_ascii(text), every(ASCII_PATTERN)).otherwise(every(UNICODE_PATTERN))


def gaps(text: Column) -> Column:
    """What stands before each identifier; aligned with :func:`identifiers`."""
    return _extract(text, 1)


def identifiers(text: Column, unicode: bool = True) -> Column:
    """The identifiers of a text in order. Without ``unicode`` the bytes of a text that isn't ASCII
    are read one by one, and what follows the first identifier that cuts a character isn't read."""
    if unicode:
        return _extract(text, 2)
    single = F.decode(text.cast("binary"), "ISO-8859-1")
    tokens = F.regexp_extract_all(single, F.lit(UNICODE_PATTERN), F.lit(2))
    back = F.transform(tokens, lambda t: F.encode(t, "ISO-8859-1").cast("string"))
    end = F.array_position(F.transform(back, F.is_valid_utf8), F.lit(False))
    kept = F.when(end > 0, F.slice(back, F.lit(1), (end - 1).cast("int"))).otherwise(back)
    return F.when(is_ascii(text), F.regexp_extract_all(text, F.lit(ASCII_PATTERN), F.lit(2))).otherwise(kept)


def words(identifier: Column) -> Column:
    """The words of an identifier: parts by change of case and digits. Letters without case give none."""
    return F.regexp_extract_all(identifier, F.lit(WORD_PATTERN), F.lit(0))


def word_gaps(identifier: Column) -> Column:
    """What stands before each word; aligned with :func:`words`."""
    return F.regexp_extract_all(identifier, F.lit(f"(?s)(.*?)({WORD_PATTERN})"), F.lit(1))


def word_error(token: Column) -> Column:
    """Why a token isn't just one word: it has none, something before the first, or several; else null.
    What follows a word isn't looked at."""
    found, gaps_ = words(token), word_gaps(token)
    return F.when(F.size(found) == 0, "is nothing").when(gaps_[0] != "", "has padding").when(F.size(found) > 1, "is multiple words")


def word_case(word: Column) -> Column:
    """Lower, Title, Upper, or None for numbers; a single capital is Upper."""
    return (
        F.when(F.rlike(word, F.lit("^[0-9]+$")), "None")
        .when(F.rlike(word, F.lit(r"^\p{IsUppercase}+$")), "Upper")
        .when(F.rlike(word, F.lit(r"^\p{IsUppercase}")), "Title")
        .otherwise("Lower")
    )


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def case_correct(correction: Column, case: Column) -> Column:
    """A correction in the case of the word; only ASCII letters change."""
    upper = lambda c: F.translate(c, _LOWER, _UPPER)
    return F.when(case == "Title", F.concat(upper(F.substring(correction, 1, 1)), F.substr(correction, F.lit(2)))).when(case == "Upper", upper(correction)).otherwise(correction)


def literal_count(text: Column, kind: str) -> Column:
    """How often a kind of literal stands in a text, wherever it begins."""
    return F.regexp_count(text, F.lit(f"(?:{LITERALS[kind].replace('{W}', ASCII_WORD)})"))


def byte_offset(before: Column, tokens: Column, position: Column) -> Column:
    """Where in UTF-8 bytes the token at ``position`` (from 0) begins."""
    total = lambda array, n: F.octet_length(F.array_join(F.slice(array, F.lit(1), n), ""))
    return (total(before, position + 1) + total(tokens, position)).cast("bigint")


def prefix(text: Column, offset: Column) -> Column:
    """The first ``offset`` bytes of a text."""
    return F.substring(text.cast("binary"), F.lit(1), offset.cast("int")).cast("string")


def line_number(text: Column, offset: Column) -> Column:
    """The line, from 1, of a byte offset."""
    before = prefix(text, offset)
    return (F.length(before) - F.length(F.translate(before, "\n", "")) + 1).cast("bigint")


def line_offset(text: Column, offset: Column) -> Column:
    """The byte offset within its line."""
    return F.octet_length(F.substring_index(prefix(text, offset), "\n", -1)).cast("bigint")


def line_text(text: Column, offset: Column) -> Column:
    """The line that holds a byte offset, without its end."""
    whole = F.substring_index(prefix(text, offset), "\n", -1)
    rest = F.substr(text.cast("binary"), (offset + 1).cast("int")).cast("string")
    return F.regexp_replace(F.concat(whole, F.substring_index(rest, "\n", 1)), "\r$", "")
