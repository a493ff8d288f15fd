import duckdb
import pyarrow as pa
import pytest

from glyphwright.functions import scan
from glyphwright.operators import check, sinks
from glyphwright.plans import registry
from test_tokens import _odd_texts

UPPER = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
TEXTS = [f"SHA {UPPER} AND THE REST", f"({UPPER.lower()}, {UPPER}) é", UPPER * 4, f"{UPPER}@here.org x", f"{UPPER[:31]} {UPPER[:32]}. _{UPPER}", "", None, "1" * 40 + " one"]


@pytest.fixture(scope="module")
def hashes(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hashes"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["byte_offsets", "ident_tokens_documents", "parse_identifiers", "parse_words"])
def test_hashes_in_upper_case_as_in_sql(spark, hashes, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{hashes}/documents.parquet/*.parquet')")
    expected = sorted(con.execute(registry.ORACLES[name]).fetchall())
    assert expected
    assert sorted(map(tuple, registry.QUERIES[name](spark, hashes).collect())) == expected


def test_the_grammar_itself_skips_hashes_in_upper_case():
    data = f"SHA {UPPER} x".encode()
    cut = lambda spans: [data[a:b].decode() for a, b in spans]
    assert cut(scan.parse(data)) == ["SHA", "x"]
    assert cut(scan.parse(data, upper_hashes=True)) == ["SHA", UPPER, "x"]


def _shown(data, spans, dim="\x1b[2m", styles=("\x1b[36m", "\x1b[1;36m"), end="\x1b[0m"):
    out, at = [], 0
    for i, (a, b) in enumerate(spans):
        out += [dim + data[at:a] + end] * (a > at) + [styles[i % 2] + data[a:b] + end if isinstance(styles, tuple) else styles(data[a:b])]
        at = b
    return "".join(out + [dim + data[at:] + end] * (at < len(data)))


def _by_hand(text, kind):
    if text is None:
        return None
    raw = text.encode()
    names = [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in scan.parse(raw)]
    inner = lambda token: _shown(token, [m.span() for m in scan.WORD.finditer(token)])
    return _shown(text, names, styles=inner) if kind == "words" else _shown(text, names)


@pytest.mark.parametrize("kind", ["identifiers", "words"])
def test_highlights_as_by_hand(kind):
    texts = [None, *_odd_texts(), "", None, "aB Ab AB ab Élan ÉLAN élAn _a1_b2_ 日本 ßx Xß", " ", "x"]
    for size in (1 << 20, 40):
        column = pa.array(texts, pa.string())
        with pytest.MonkeyPatch.context() as m:
            m.setattr(scan, "SLAB", size)
            assert sinks.painted(column, kind).to_pylist() == [_by_hand(t, kind) for t in texts]
            assert sinks.painted(column[3:9], kind).to_pylist() == [_by_hand(t, kind) for t in texts[3:9]]
    assert sinks.painted(pa.array([], pa.string()), kind).to_pylist() == []


def test_highlights_look_at_different_identifiers_only(monkeypatch):
    seen = []
    monkeypatch.setattr(scan, "_word_spans", lambda token, f=scan._word_spans: seen.append(token) or f(token))
    sinks.painted(pa.array(["some plain Words, in CAPITALS too; twoWords, a_b " * 2000] * 3), "words")
    assert sorted(set(seen)) == [b"a_b", b"twoWords"] and len(seen) == 2


def test_lines_are_given_if_asked_for_and_in_bounded_batches(spark, monkeypatch):
    text = "é ther\r\n" + "ther né ther " * 200 + "\nther"
    rows = spark.createDataFrame([(1, text), (2, "a ther"), (3, None)], "id int, text string")
    lex = check.lexicon(spark, {"ther": ["there"]})
    given = check.findings(rows, lex, keep=["id"], placed=["prefix_chars"])
    assert "line" not in given.columns
    every = check.findings(rows, lex, keep=["id"], placed=True)
    key = lambda r: (r.id, r.byte_offset)
    whole, some = sorted(every.collect(), key=key), sorted(given.collect(), key=key)
    assert len(whole) == 403 and [tuple(r) for r in some] == [tuple(r[c] for c in given.columns) for r in whole]
    for r in whole:
        line = (text if r.id == 1 else "a ther").split("\n")[r.line_num - 1]
        assert r.line == line.removesuffix("\r") and line[r.prefix_chars :].startswith("ther")
    size = [3, 3, 20, 1, 1, 9, 2]
    monkeypatch.setattr(check, "LINE_BYTES", 10)
    runs = [size[s] for s in check._runs(size, len(size))]
    assert runs == [[3, 3], [20], [1, 1], [9], [2]] and list(check._runs(None, 5)) == [slice(0, 5)]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(scan, "_fields", {})
    many, long = b".".join([b"ab"] * 30), b"word_" * 40
    assert len(scan.parse(many)) == 30 and scan.parse(long) and not scan._fields
    matcher = scan.Matcher({"word": ("Corrections", ("words",))}, {}).ready()
    assert len(matcher.evaluate(b"Word" * 40)) == 40 and not matcher.known
