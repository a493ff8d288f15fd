from pyspark.sql import functions as F

from glyphwright.operators import check, curate, dialect, filetypes, fix, sinks
from glyphwright.plans import registry
from glyphwright.sources import seed


def _find(spark, text, ignore=(), **lexicon):
    dictionary = spark.createDataFrame([("teh", ["the"]), ("hte", ["the", "hate"]), ("bad", [])], "key string, corrections array<string>")
    lex = check.lexicon(spark, dictionary, **lexicon)
    rows = spark.createDataFrame([("p", text)], "path string, text string")
    found = check.findings(rows, lex, keep=["path"], ignore=ignore).collect()
    return sorted((r.byte_offset, r.typo, r.status, tuple(r.corrections)) for r in found)


def test_words_in_identifiers(spark):
    assert _find(spark, "é TehClass my_hte\nBAD TEH") == [
        (3, "Teh", "Corrections", ("The",)), (15, "hte", "Corrections", ("the", "hate")), (19, "BAD", "Invalid", ()), (23, "TEH", "Corrections", ("THE",)),
    ]


def test_letters_of_latin_1(spark):
    """Words whose letters aren't all ASCII, in every case, and what only looks like them to a hash."""
    words = {"über": "ober", "naïve": "naive", "éé": "ee", "straße": "strasse", "ÿx": "yx"}
    found = _find(spark, "Über ÜBER über üBer Naïve naÏve ÉÉ éé Éé STRASSE straße strañe ßx ÿx Ÿx xüber über_naïve överß", words=words)
    text = "Über ÜBER über üBer Naïve naÏve ÉÉ éé Éé STRASSE straße strañe ßx ÿx Ÿx xüber über_naïve överß".encode()
    assert all(text[a : a + len(t.encode())].decode() == t for a, t, _, _ in found)
    assert [t for _, t, _, _ in found] == ["Über", "ÜBER", "über", "Naïve", "ÉÉ", "éé", "Éé", "straße", "ÿx", "Ÿx", "über", "naïve"]


def test_overrides_come_first(spark):
    assert _find(spark, "teh Bad", words={"teh": "teh", "BAD": "good"}) == [(4, "Bad", "Corrections", ("Good",))]
    assert _find(spark, "tehBad teh", identifiers={"tehBad": ""}) == [(0, "tehBad", "Invalid", ()), (7, "teh", "Corrections", ("the",))]
    assert _find(spark, "tehBad", identifiers={"tehBad": "tehBad"}) == []
    assert _find(spark, "O_WRONLY dBA", words={"wronly": "", "d": ""}) == []


def test_ignored(spark):
    assert _find(spark, "file_teh teh", ignore_identifiers=["^file"]) == [(9, "teh", "Corrections", ("the",))]
    assert _find(spark, "teh Teh", ignore_words=["^t"]) == [(4, "Teh", "Corrections", ("The",))]
    assert _find(spark, "`teh` teh", ignore=["`.*`"]) == [(6, "teh", "Corrections", ("the",))]
    assert _find(spark, "é teh # no\r\nteh\r\n", ignore=["(?Rm)^.*# no$"]) == [(13, "teh", "Corrections", ("the",))]
    # A block inside a word doesn't count.
    assert _find(spark, "teh", ignore=["e"]) == [(0, "teh", "Corrections", ("the",))]


def test_nulls_and_empties(spark):
    lex = check.lexicon(spark, words={"teh": "the"})
    rows = spark.createDataFrame([(1, None, "x"), (None, "teh", "x"), (2, "", None), (3, "teh", "y"), (3, "teh", "y")], "id int, text string, typo string")
    assert sorted((str(r.id), r.typo) for r in check.findings(rows, lex, keep=["id"]).collect()) == [("3", "teh"), ("3", "teh"), ("None", "teh")]
    assert check.findings(rows.limit(0), lex, keep=["id"]).count() == 0


def test_file_names(spark):
    lex = check.lexicon(spark, words={"makro": "macro"})
    files = spark.createDataFrame([("makro/makro.rs", "fn makro() {}")], "path string, text string")
    found = check.check_files(files, lex)
    assert sorted((r.line_num is None, r.byte_offset) for r in found.collect()) == [(False, 3), (True, 0)]
    assert sinks.renames(found).first().new_path == "makro/macro.rs"
    flags = check.status_flags(found).first()
    assert (flags.any_typo, flags.any_error, flags.exit_code) == (True, False, 2)


def test_splice(spark):
    cases = [
        ([(3, "ab", "xy")], "ab xy ab"), ([(3, "ab", "longer")], "ab longer ab"), ([(3, "ab", "c")], "ab c ab"), ([(0, "ab", "xy")], "xy ab ab"),
        ([(6, "ab", "xy")], "ab ab xy"), ([(6, "ab", "longer")], "ab ab longer"), ([(6, "ab", "end"), (3, "ab", "middle")], "ab middle end"),
    ]
    df = spark.createDataFrame([("ab ab ab", f, e) for f, e in cases], "t string, f array<struct<byte_offset: bigint, typo: string, fix: string>>, e string")
    assert df.where(fix.splice(F.col("t"), F.col("f")) != F.col("e")).count() == 0


def test_fix_and_diff(spark):
    lex = check.lexicon(spark, words={"teh": "the", "ñame": "name"})
    rows = spark.createDataFrame([("a", "É teh\nok\nÑame Teh!"), ("b", "fine"), ("c", None)], "path string, text string")
    fixed = fix.fix_text(rows, lex)
    assert {r.path: (r.fixed_text, r.n_fixed) for r in fixed.collect()} == {"a": ("É the\nok\nName The!", 3), "b": ("fine", 0), "c": (None, 0)}
    diff = fix.diff_rows(fixed, "path").collect()
    assert len(diff) == 1 and "-É teh\n+É the\n" in diff[0].diff and " ok" not in diff[0].diff


def test_fix_by_row(spark):
    """Keys that are null or repeated don't matter, nor do columns of the names that are made."""
    lex = check.lexicon(spark, words={"teh": "the", "aa": "bbb"})
    texts = ["teh aa bb", "aa bb teh cc", "teh", "teh", None, ""]
    rows = spark.createDataFrame([(1, texts[0], "x", 9), (1, texts[1], "x", 9), (None, texts[2], "x", 9), (None, texts[3], "x", 9), (2, texts[4], "x", 9), (2, texts[5], "x", 9)], "id int, text string, fixed_text string, `a.b` int")
    fixed = fix.fix_text(rows, lex)
    assert fixed.columns == ["id", "text", "a.b", "fixed_text", "n_fixed"]
    got = sorted(((r.text, r.fixed_text, r.n_fixed) for r in fixed.collect()), key=str)
    assert got == sorted([("teh aa bb", "the bbb bb", 2), ("aa bb teh cc", "bbb bb the cc", 2), ("teh", "the", 1), ("teh", "the", 1), (None, None, 0), ("", "", 0)], key=str)
    assert "Exchange" not in fixed._jdf.queryExecution().executedPlan().toString()
    assert fix.fix_text(rows.limit(0), lex).count() == 0


def test_lexicon_in_parts(spark, monkeypatch):
    """A lexicon that is too large to be broadcast at once gives the same findings."""
    dictionary = spark.createDataFrame([("teh", ["the"]), ("hte", ["the", "hate"]), ("bad", []), ("ñame", ["name"])], "key string, corrections array<string>")
    rows = spark.createDataFrame([(1, "teh bad Hte tehBad ñame"), (2, "ok"), (3, None), (4, "Bad\nteh teh")], "id int, text string")

    def see():
        lex = check.lexicon(spark, dictionary, words={"xx": "yy"}, identifiers={"tehBad": "good"})
        found = check.findings(rows, lex, keep=["id"], placed=True).collect()
        fixed = fix.fix_text(rows, lex).collect()
        return len(lex.parts(spark)), sorted(map(str, found)), sorted(map(str, fixed))

    whole = see()
    monkeypatch.setattr(check, "BROADCAST_BYTES", 500)
    parts = see()
    assert whole[0] == 1 and parts[0] > 2 and whole[1:] == parts[1:] and len(whole[1]) == 8


def test_bytes(spark):
    """Content that isn't UTF-8 throughout is read in its valid pieces; places are those of the whole."""
    lex = check.lexicon(spark, words={"teh": "the"})
    rows = spark.createDataFrame([(1, bytearray(b"caf\xe9 teh\n\xffteh")), (2, bytearray("é teh".encode())), (3, bytearray(b"teh\xe2\x82")), (4, bytearray(b"me\xff@x.y teh"))], "id int, content binary")
    found = {(r.id, r.byte_offset, r.line_num, r.line_byte_offset, r.line, r.prefix_chars) for r in check.findings(rows, lex, "content", ["id"], placed=True).collect()}
    assert found == {(1, 5, 1, 5, "caf\ufffd teh", 5), (1, 10, 2, 1, "\ufffdteh", 1), (2, 3, 1, 3, "é teh", 2), (3, 0, 1, 0, "teh\ufffd", 0), (4, 8, 1, 8, "me\ufffd@x.y teh", 8)}
    fixed = {r.id: bytes(r.fixed_text) for r in fix.fix_text(rows, lex, "content").collect()}
    assert fixed == {1: b"caf\xe9 the\n\xffthe", 2: "é the".encode(), 3: b"the\xe2\x82", 4: b"me\xff@x.y the"}


def test_without_unicode(spark):
    lex = check.lexicon(spark, words={"teh": "the"})
    rows = spark.createDataFrame([(1, "teh plain"), (2, "teh א teh"), (3, "teh café teh"), (4, None)], "id int, text string")
    got = sorted((r.id, r.byte_offset) for r in check.findings(rows, lex, keep=["id"], unicode=False).collect())
    assert got == [(1, 0), (2, 0), (2, 7), (3, 0)]  # of é only the first byte is like a letter, which cuts it


def test_dialects(spark):
    rows = registry._clusters(spark)
    assert {(r.header, r.verified, r.level) for r in rows.collect()} == {("color", True, 10), ("realize", True, 10), ("gray", False, 20), ("center", True, 10)}
    compiled = dialect.compile(dialect.infer(rows))
    words = spark.createDataFrame([("realizze", ["realizes"])], "key string, corrections array<string>")

    def see(locale):
        return {r.key: (r.status, r.corrections) for r in dialect.chain(words, compiled, locale).collect()}

    assert see("en") == {"realizze": ("Corrections", ["realizes"])}
    assert see("en-us")["realizes"] == ("Valid", []) and see("en-us")["realizze"] == ("Corrections", ["realizes"])
    assert see("en-gb")["realizes"] == ("Corrections", ["realises"]) and see("en-gb")["realizze"] == ("Corrections", ["realises"])
    assert see("en-us")["centar"] == ("Valid", []) and see("en-gb")["center"] == ("Corrections", ["centre"])


def test_curation(spark):
    entries = lambda *e: spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(e)], "pos int, key string, corrections array<string>")
    both = spark.createDataFrame([("neighborhood", "neighbourhood"), ("neighbourhood", "neighborhood")], "word string, variant string")
    colour = spark.createDataFrame([("colour",)], "word string")
    run = lambda *e: {r.key: r.corrections for r in curate.process(entries(*e), colour, None, both).collect()}
    assert run(("foo", ["xyz", "abc"])) == {"foo": ["xyz", "abc"]}
    assert run(("foo", ["bar"]), ("Foo", ["baz"])) == {"foo": ["bar", "baz"]}
    assert run(("foo", ["bar", "bar"])) == {"foo": ["bar"]}
    assert run(("round", ["trip"]), ("trip", ["round"])) == {}
    assert run(("colour", ["color"])) == {}
    assert run(("neighourhood", ["neighborhood"])) == {"neighourhood": ["neighbourhood"]}


def test_single_words(spark):
    entries = spark.createDataFrame([("it's", ["its"]), ("foo", ["bar", "b_r", "two words", "don't", "x1"]), ("a_b", ["c"]), ("7", ["seven"])], "key string, corrections array<string>")
    assert {r.key: r.corrections for r in curate.single_words(entries).collect()} == {"foo": ["bar"]}  # a number is no identifier
    assert {r.key: r.corrections for r in curate.only_words(entries).collect()} == {"foo": ["bar"]}


def test_glob_order():
    order = lambda *g: sorted(g, key=filetypes.sort_key)
    assert order("b", "c", "a") == ["a", "b", "c"]
    assert order("a_specific", "z_partial*") == ["z_partial*", "a_specific"]
    assert order("a.one", "y*.two", "y.two*") == ["y.two*", "a.one", "y*.two"]
    assert order("*.txt.in", "*.in") == ["*.in", "*.txt.in"]


def test_file_types(spark):
    expected = {"leftpad.js": "js", "a/index.html": "html", "index.htm": "html", "leftpad.ada": None, "package-lock.json": "lock", "index.html.in": "html", "index.html.in.in": "html", "foo.js.in": "js-in"}
    rows = spark.createDataFrame([(p,) for p in expected], "path string")
    assert {r.path: r.t for r in rows.select("path", filetypes.file_type(F.col("path"), registry._TYPES).alias("t")).collect()} == expected
    toplevel = {"html": ["*.html", "*.htm"], "in-canary": ["*.in"]}
    assert spark.range(1).select(filetypes.file_type(F.lit("index.html.in"), toplevel).alias("t")).first().t == "in-canary"
    defaults = {"a.py" + ".in" * 7: "py", "x.h": "sv", "Cargo.toml": "rust", "LICENSE-MIT": "license", "a.min.js": "minified", "Makefile.in": "make", ".in": None, "my.Dockerfile": "docker", "a.b": None}
    rows = spark.createDataFrame([(p,) for p in [*defaults, None]], "path string")
    assert {r.path: r.t for r in rows.select("path", filetypes.file_type(F.col("path")).alias("t")).collect()} == defaults | {None: None}
    own = filetypes.file_type(F.lit("dir/a.PYX"), own={"py": ["*.PYX"]})
    assert spark.range(1).select(own.alias("t")).first().t == "py"


def test_seed(spark):
    words, wrong = set(seed.words()) | seed.others(), seed.dictionary()
    assert len(wrong) > 50_000 and not words & set(wrong) and all(v for v in wrong.values())
    assert wrong["recieve"] == ["receive"] and wrong["goverment"] == ["government"] and "travelled" not in wrong
    assert check.findings(spark.createDataFrame([(" ".join(sorted(words)),)], "text string"), check.lexicon(spark, wrong)).count() == 0
    table = {r.word: r for r in seed.dialects(spark).collect()}
    assert table["colour"].A == ["color"] and table["colour"].mask == 14 and table["organise"].A == ["organize"] and "organize" not in table and len(table) > 400


def test_reports(spark):
    import json

    lex = check.lexicon(spark, words={"teh": "the", "bad": ""})
    rows = spark.createDataFrame([("p", "ok\né teh bad")], "path string, text string")
    found = check.findings(rows, lex, keep=["path"], placed=True).cache()
    assert sorted(r.value for r in sinks.brief(found).collect()) == ["p:2:4: `teh` should be `the`", "p:2:8: `bad` is disallowed"]
    lines = sorted((json.loads(r.value) for r in sinks.json_lines(found).collect()), key=lambda x: x["byte_offset"])
    assert lines[0] == {"type": "typo", "path": "p", "line_num": 2, "byte_offset": 3, "typo": "teh", "corrections": ["the"]} and lines[1]["corrections"] is None
    report = json.loads("".join(sinks.sarif(found, ["no such file"])))["runs"][0]
    region = {"startLine": 2, "endLine": 2, "startColumn": 3, "endColumn": 6}  # columns count code points
    first, second = report["results"]
    assert first["message"]["markdown"] == "`teh` should be `the`" and first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "p"}, "region": region}
    assert first["fixes"][0]["artifactChanges"][0]["replacements"] == [{"deletedRegion": region, "insertedContent": {"text": "the"}}] and first["fixes"][0]["description"] == first["message"]
    assert "fixes" not in second and second["message"]["markdown"] == "`bad` is disallowed" and second["level"] == "error"
    assert report["columnKind"] == "unicodeCodePoints" and report["invocations"] == [{"executionSuccessful": False, "processStartFailureMessage": "no such file"}]
    named = sinks.sarif(found.withColumn("line_num", F.lit(None).cast("long")))
    assert all("region" not in r["locations"][0]["physicalLocation"] and "fixes" not in r for r in json.loads("".join(named))["runs"][0]["results"])
    assert sinks.annotations(found).where("value like '::warning file=p,line=2,col=4::%'").count() == 1
    assert any("é teh bad" in r.value and "^^^" in r.value for r in sinks.long(found).collect())
    shown = rows.select(sinks.highlight(F.col("text")).alias("a"), sinks.highlight(F.col("text"), "words").alias("b")).first()
    import re

    assert all(re.sub("\x1b\\[[0-9;]*m", "", x) == "ok\né teh bad" for x in shown)
