"""Each operator against a brute-force version, and on nulls, empties, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphwright import shipping
from glyphwright.llm import _scale, _text, automaton, bpe, cuckoo, langid, licenses, linededup, mixing, quality, secrets, sharding, simhash, topk

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
#: Nulls in every column, empty and very long texts, repeated rows and texts.
ODD = [
    (None, "no id here at all", "en", "a", 17), (1, None, "en", "a", 0), (2, "", None, None, None), (3, LONG, "en", "b", 9), (4, "same text twice\nand more", "en", "b", 9),
    (5, "same text twice\nand more", None, "b", 9), (5, "same text twice\nand more", None, "b", 9), (6, "?!\n \n--", "xx", None, 5), (7, " \n\n", "en", "a", 3), (-8, "same text twice", "en", None, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names operators use themselves."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("k", "h", "d", "line", "rank", "finish", "total", "bucket", "tokens", "n_tokens", "exact", "kept_id", "a.b", "language", "score", "id", "blob"):
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return sorted((tuple(r) for r in con.execute(sql).fetchall()), key=repr)


def arrow(df, *columns):
    t = df.select(*columns).toPandas()
    return pa.table({c: pa.array([None if x is None or x != x else int(x) if k == "bigint" else x for x in t[c]], pa.int64() if k == "bigint" else pa.string()) for c, k in df.select(*columns).dtypes})


# Shared pieces


@pytest.mark.parametrize("segments", [1, 3, 40])
def test_running_sums(spark, segments):
    rng = random.Random(segments)
    data = [(rng.choice([None, *[f"s{i}" for i in range(segments)]]), rng.randrange(1000), rng.randrange(50)) for _ in range(500)]
    df = spark.createDataFrame(data, "s string, o int, v long")
    ordered = _scale.range_sorted(df, "s", "o", "v")
    want, total, at = [], 0, defaultdict(int)
    for s, o, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        at[s] += v
        want.append((s, o, v, at[s]))
    assert rows(_scale.running_sums(ordered, "v", "r", "s")) == sorted(want, key=repr)
    want = []
    for s, o, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        total += v
        want.append((s, o, v, total))
    assert rows(_scale.running_sums(ordered, "v", "r")) == sorted(want, key=repr)
    assert _scale.running_sums(_scale.range_sorted(df.limit(0), "s"), "v", "r", "s").count() == 0


def test_connected(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in list(parent) if find(x) != x)
    assert sorted(rows(_scale.connected(spark.createDataFrame(edges, "a long, b long")))) == want
    assert _scale.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 SimHash


def brute_duplicates(docs):
    got = simhash.fingerprints(docs).toPandas()
    ids, f = got.doc_id.to_numpy(), got[list(simhash.WORDS)].to_numpy().view(np.uint64)
    d = np.bitwise_count(f[:, None] ^ f[None])
    near = (d[:, :, : simhash.SEARCHED] <= simhash.MAX_BITS).any(2) & (d.sum(2) <= simhash.MAX_ALL)
    group = ids.copy()
    while True:  # spread the smallest id
        new = np.where(near, group[None, :], np.iinfo(np.int64).max).min(1)
        for x in np.unique(ids):
            new[ids == x] = new[ids == x].min()
        if (new == group).all():
            break
        group = new
    return sorted({(int(a), int(g)) for a, g in zip(ids, group, strict=True) if a != g})


def test_simhash_equals_brute_force(docs):
    assert sorted(set(rows(simhash.duplicates(docs)))) == brute_duplicates(docs)


def slow_fingerprint(text):
    """256 majority votes of the distinct words, ties to zero, with the same hash of a word."""
    words = sorted({w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())})
    if not words:
        return None
    mask, out = (1 << 64) - 1, []

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    keys = []
    for w in words:
        total = sum(int(_text.TABLES[i & 63, c]) + (i >> 6 if len(w) > 64 else 0) for i, c in enumerate(w)) + len(w)
        keys.append(mix(total & mask) >> 20)
    for k in range(4):
        hashed = [mix(x + ((k + 1) << 50)) for x in set(keys)]
        votes = [sum(h.to_bytes(8, "little")[i // 8] >> (7 - i % 8) & 1 for h in hashed) for i in range(64)]
        bits = "".join("1" if 2 * v > len(hashed) else "0" for v in votes)
        out.append(int.from_bytes(bytes(int(bits[i : i + 8], 2) for i in range(0, 64, 8)), "little"))
    return out


def test_fingerprints_equal_slow_ones(docs):
    texts = [r.text for r in docs.limit(40).collect()] + ["", "?!", "one", "one two", "One two ONE", "é ü", "x" * 200 + " y", " ".join(f"w{i}" for i in range(700)), None]
    at, prints = simhash.fingerprint(pa.array(texts))
    want = {i: p for i, t in enumerate(texts) if t and (p := slow_fingerprint(t))}
    assert at.tolist() == sorted(want) and [[int(x) for x in p] for p in prints] == [want[i] for i in sorted(want)]


def test_simhash_search():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    codes = np.concatenate([base, *[base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64)) for _ in range(12)], base[:5]])
    bucket = np.sort(rng.integers(0, 4, len(codes)))
    for most in (0, 3, 8):
        i, j = simhash.search(bucket, codes, most)
        d = np.bitwise_count(codes[:, None] ^ codes[None])
        a, b = np.nonzero((d <= most) & (bucket[:, None] == bucket[None]))
        assert sorted({(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist(), strict=True)}) == [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < y]
    assert simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)).tolist() == list(range(8))


def test_simhash_blocks():
    """Codes within the limit share a pair of blocks; they are reported for the first one."""
    assert sum(n for _, n in simhash.SPANS) == 64
    diff = np.array([0, 1, (1 << 64) - 1 ^ (0x7F | 0x7F << 7)], np.uint64)
    assert simhash._first_pair(diff).tolist() == [0, simhash.PAIRS.index((1, 2)), 0]


def test_simhash_is_exact(spark):
    """Differences dealt to the four codes in every way: all pairs within MAX_ALL, nothing else."""
    rng = np.random.default_rng(6)
    assert simhash._limits(simhash.MAX_BITS, simhash.MAX_ALL) == [10, 9, 9, 9] and simhash._limits(3, 40) == [3] * 4 and simhash._limits(99, 39) == [9] * 4
    prints = []
    for way in [(10, 10, 10, 10), (11, 9, 10, 10), (11, 10, 10, 10), (10, 11, 11, 8), (40, 0, 0, 0), (13, 13, 14, 0), (10, 10, 10, 11), (9, 9, 9, 9)] * 25:
        base = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
        near = [int(w) ^ sum(1 << int(b) for b in rng.choice(64, k, False)) for w, k in zip(base, way, strict=True)]
        prints += [base, np.array(near, np.uint64)]
    f = np.array(prints)
    got = simhash.near_pairs(spark.createDataFrame([(i, *w) for i, w in enumerate(f.view(np.int64).tolist())], "rep long, f0 long, f1 long, f2 long, f3 long"))
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    assert {(r.a, r.b, r.bits) for r in got.collect()} == {(a, b, int(d[a, b])) for a, b in zip(*np.nonzero(d <= simhash.MAX_ALL), strict=True) if a < b}


def test_simhash_finds_near_copies(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    data = []
    for g in range(30):
        text = [rng.choice(words) for _ in range(250)]
        for c in range(4):
            own = list(text)
            for _ in range(6 * (c > 1)):
                own[rng.randrange(len(own))] = rng.choice(words)
            data.append((g * 10 + c, (" ".join(own)).upper() if c == 1 else " ".join(own)))
    got = dict(rows(simhash.duplicates(spark.createDataFrame(data, "doc_id long, text string"))))
    assert len([1 for k, v in got.items() if k // 10 == v // 10 and v % 10 == 0]) >= 85 and all(k // 10 == v // 10 for k, v in got.items())


def test_simhash_places_are_data(spark):
    unique = spark.createDataFrame([(1, 2, 3, 4, 5)], "rep long, f0 long, f1 long, f2 long, f3 long")
    plan = simhash.near_pairs(unique)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("shiftrightunsigned") <= 4  # not some for each of 126 places


def test_fingerprints_take_little_memory():
    texts = pa.array([" ".join(f"wort{i}x{k}" for i in range(300)) for k in range(400)])
    tracemalloc.start()
    rows, _ = simhash.fingerprint(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 400
    assert peak < 16 << 20


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    ours, theirs = spark.newSession(), spark.newSession()
    asked = {"spark.sql.execution.arrow.maxBytesPerBatch": "3000000b", "spark.sql.parquet.columnarReaderBatchSize": "100"}
    for k, v in asked.items():
        theirs.conf.set(k, v)
    for s in (ours, theirs):
        shipping.ship(s)
    assert {k: theirs.conf.get(k) for k in asked} == asked
    assert [ours.conf.get(k) for k in asked] == [f"{1 << 20}b", "512"]


def test_simhash_odd(odd):
    assert rows(simhash.duplicates(odd)) == [(5, 4)]
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert simhash.duplicates(odd.limit(0)).count() == 0


def test_simhash_keeps_one_row_of_each_group(spark):
    """A doc_id with two texts, rows without doc_id, and repeats of the row that is kept."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    data = [(1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (None, c + " more"), (4, d), (4, d), (5, d), (6, e), (None, e), (7, ""), (7, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("__k", F.lit(None).cast("map<string,int>"))
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len([x for x in kept if x[0] is None]) == 1 and {x[1] for x in kept if x[0] is None} <= {c, c + " more"}
    assert sorted(x for x in kept if x[0] is not None) == sorted([(1, a), (2, b), (4, d), (6, e), (7, ""), (7, "")])
    assert rows(simhash.duplicates(df)) == [(2, 1), (3, 2), (5, 4)]


# 2 Mixing


def test_mixing_equals_sql(docs, odd):
    for df in (docs, odd):
        t = arrow(df, "doc_id", "source", "text")
        assert rows(mixing.mix(df).select("doc_id", "source", "n_tokens", "finish", "total")) == by_sql(mixing.SQL, documents=t)


def test_mixing_shares(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i % 4 else "b") for i in range(4000)], "doc_id long, text string, source string")
    got = dict(rows(mixing.mix(df, {"a": 1.0, "b": 3.0}, budget=10_000).groupBy("source").agg(F.sum("n_tokens"))))
    assert abs(got["b"] / got["a"] - 3) < 0.05 and 9_980 <= sum(got.values()) <= 10_000
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0.0})


def test_keep_mixed(docs, odd):
    for df in (docs, odd):
        kept = mixing.keep_mixed(df)
        assert kept.columns == df.columns
        want = Counter(r.doc_id for r in mixing.mix(df).collect())
        got = Counter(r.doc_id for r in kept.select("doc_id").collect())
        assert set(got) == set(want) and sum(got.values()) - sum(want.values()) <= 1
    assert mixing.keep_mixed(odd.limit(0)).count() == 0


# 3 Language


def brute_phrases(model, samples, data, language):
    classes = bytes(model.read(data, np.array([0, len(data)]))[0])
    known = [bytes(model.read(d, np.array([0, len(d)]))[0]) for d in samples[language]]
    n = i = 0
    while i < len(classes):
        j = i + 1
        while j <= len(classes) and any(classes[i:j] in x for x in known):
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_langid_equals_brute_force():
    samples = {"x": [np.frombuffer(b"the cat sat on the mat and the dog ran", np.uint8), np.frombuffer("déjà vu".encode(), np.uint8)], "y": [np.frombuffer(b"lorem ipsum dolor sit amet", np.uint8)]}
    model = langid.Model(samples)
    texts = ["The cat!! and dolor", "", "déjà", "zzz 漢", "amet sit dolor  ipsum\nlorem", "a " * 5000]
    offsets = [model.read(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts]
    for t, (c, o) in zip(texts, offsets, strict=True):
        want = [[brute_phrases(model, samples, np.frombuffer(t.encode(), np.uint8), k) for k in ("x", "y")]]
        assert all(model.phrases(c, o, block).tolist() == want for block in (1, 2, 3, 7, 64, 4096))
    together = model.scores(pa.array(texts))
    alone = np.concatenate([model.scores(pa.array([t])) for t in texts])
    assert np.array_equal(together, alone, equal_nan=True)


def test_langid_phrases_dont_end_with_blocks():
    """Periodic texts, where walks from different places never meet, and random ones."""
    rng = random.Random(11)
    samples = {"x": [np.frombuffer(b"abc" * 7 + b"acbbca", np.uint8)], "y": [np.frombuffer("".join(rng.choices("abc", k=60)).encode(), np.uint8)]}
    model = langid.Model(samples)
    texts = [b"abc" * 60, b"bca" * 41 + b"aab", b"", *["".join(rng.choices("abc", k=rng.randrange(1, 200))).encode() for _ in range(20)]]
    want = [[brute_phrases(model, samples, np.frombuffer(t, np.uint8), k) for k in ("x", "y")] for t in texts]
    offsets = np.cumsum([0, *map(len, texts)])
    c, o = model.read(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for block in (1, 2, 5, 16, 23, 4096):
        assert model.phrases(c, o, block).tolist() == want


def test_langid_sample_is_bounded(spark):
    """However often ids are null or the same, and rows repeated."""
    n = 10_000
    same = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id") % 50).alias("text"), F.lit("en").alias("lang"))
    one = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("texto "), F.col("id")).alias("text"), F.lit("es").alias("lang"))
    long = spark.createDataFrame([(1, "lang " * 9000, "de"), (2, "kurz " * 7000, "de"), (3, "mot " * 5000, "fr"), (4, "mot " * 900, "fr"), (5, "mot " * 800, "fr")], "doc_id long, text string, lang string")
    got = langid.sample(same.unionByName(one).unionByName(long)).collect()
    by = {k: [r for r in got if r.label == k] for k in ("en", "es", "de", "fr")}
    assert len(by["en"]) == 50 and len(by["es"]) == langid.SAMPLE_DOCS  # all different texts; the bound
    assert len({bytes(r.bytes) for r in by["es"]}) == langid.SAMPLE_DOCS
    assert [len(r.bytes) for r in by["de"]] == [35_000]  # only long ones: the shortest, whole
    assert sorted(len(r.bytes) for r in by["fr"]) == [3200, 3600]
    assert langid.sample(long.limit(0)).count() == 0


def test_langid_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df, keep=["doc_id", "lang"])
    right = got.where("lang = language").count()
    assert right >= 0.99 * got.count() and got.where("accepted").count() == got.count()


def test_langid_rejects(spark, docs, odd):
    model = langid.train(docs)
    noise = "".join(random.Random(2).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    strange = spark.createDataFrame([(1, noise), (2, "12 ?! 34"), (3, ""), (4, None), (5, "漢字かな交じり文" * 30)], "doc_id long, text string")
    got = {r.doc_id: (r.language, r.accepted) for r in langid.identify(strange, model).collect()}
    assert set(got.values()) == {("und", False)} and langid.keep_known(strange, model).count() == 0
    assert langid.keep_known(docs, model).count() == docs.count()
    assert langid.keep_known(odd).columns == odd.columns and langid.identify(odd).count() == len(ODD)
    assert langid.keep_known(odd.limit(0)).count() == 0 and langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("accepted").count() == 0


@pytest.mark.parametrize(("left_out", "least"), [("en", 0.95), ("es", 0.95), ("de", 0.95), ("fr", 0.6)])
def test_langid_rejects_left_out_language(spark, left_out, least):
    """French of the fixtures is the nearest to the others."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df.where(F.col("lang") != left_out))
    strangers = df.where((F.col("lang") == left_out) & (F.length("text") > 300))
    got = langid.identify(strangers, model)
    n = got.count()
    assert n > 20 and got.where("not accepted and language = 'und'").count() >= least * n and langid.keep_known(strangers, model).count() <= (1 - least) * n


def test_langid_rejects_foreign_prose_and_code(spark, docs):
    strange = [
        "Nel mezzo del cammino di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura.",
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        Path(langid.__file__).read_text()[3000:6000], bytes(random.Random(4).randrange(256) for _ in range(400)).hex(" "),
    ]
    df = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert langid.identify(df, langid.train(docs)).where("accepted").count() == 0


def test_suffix_automaton():
    rng = random.Random(4)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(3)]
        move, link, size, made = automaton.build(texts)
        for n in range(1, 6):
            for k in range(1 << n):
                w, s = "".join("ab"[k >> i & 1] for i in range(n)), 0
                for c in w:
                    s = move[s].get(c, -1) if s >= 0 else -1
                assert (s >= 0) == any(w in t for t in texts)


# 4 Secrets


def test_secrets_equal_sql(docs, odd):
    for df in (docs, odd):
        assert rows(secrets.scan(df)[1]) == by_sql(secrets.SQL, documents=arrow(df, "doc_id", "text"))


def test_secret_rules(spark):
    planted = {
        "aws_access_key": "AKIA" + "A1B2" * 4, "github_token": "ghp_" + "a1" * 18, "slack_token": "xoxb-12345-abcde", "payment_key": "sk_live_" + "a1" * 10, "google_api_key": "AIza" + "a" * 35,
        "private_key": "-----BEGIN RSA PRIVATE KEY-----", "json_web_token": "eyJhbGciOiJ.eyJzdWIiOiI.SflKxwRJSM", "url_password": "https://me:hunter2@host/x", "assigned_secret": 'password = "correcthorse"',
    }
    df = spark.createDataFrame([(i, f"a {s} b\n{s}") for i, s in enumerate(planted.values())], "doc_id long, text string")
    got = secrets.scan(df)[1]
    for i, name in enumerate(planted):
        assert {r.nth for r in got.where((F.col("doc_id") == i) & (F.col("rule") == name)).collect()} == {0, 1}, name
    token = hashlib.sha256(planted["github_token"].encode()).hexdigest()
    assert got.where(F.col("secret_sha256") == token).count() == 2
    clean = spark.createDataFrame([(1, "the token of love is a secret password")], "doc_id long, text string")
    assert secrets.scan(clean)[1].count() == 0


def test_secrets_of_any_length(spark):
    long, token = "p" * 65, "github_pat_" + "A1b2" * 5 + "AB_" + "x" * 59
    planted = {
        "url_password_long": [(f"https://u:{long}@h", long), (f"https://u:{token}@h", token)],
        "url_password_other_user": [("redis://:hunter2@host", "hunter2"), (f"redis://:{long}@host", long), (f"https://{long}:pw@h", "pw"), (f"https://{long}:{long}@h", long)],
        "url_password": [(f"https://{'u' * 64}:{'p' * 64}@h", "p" * 64)],
        "github_fine_grained_token": [(token, token), (f"https://u:{token}@h", token)],
    }
    df = spark.createDataFrame([(i, f"a {s[0]} b\n{s[0]}") for i, s in enumerate(x for v in planted.values() for x in v)], "doc_id long, text string")
    got = {(r.doc_id, r.rule, r.nth, r.secret_sha256) for r in secrets.scan(df)[1].collect()}
    want = {(i, name, nth, hashlib.sha256(s.encode()).hexdigest()) for i, (name, s) in enumerate((name, x[1]) for name, v in planted.items() for x in v) for nth in (0, 1)}
    assert want <= got and len([x for x in got if x[1].startswith("url_password")]) == 2 * 8


def test_rescan_equals_one_scan(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows(secrets.rescan(docs, F.pmod("doc_id", F.lit(2)) == 0, secrets.SQL_RULES))
    assert got == rows(secrets.scan(docs, None, secrets.SQL_RULES)[1]) and got
    assert secrets.rescan(odd, F.col("doc_id") > 2, secrets.SQL_RULES).count() == 0


def test_ledger_folds(spark, monkeypatch, tmp_path):
    """A ledger of many additions is folded; scans go on from there."""
    monkeypatch.setattr(secrets, "FOLD", 3)
    rule = (secrets.Rule("r", 1, "token = ([a-z]*)"),)
    place = str(tmp_path / "ledger")
    for n in range(1, 9):
        docs = spark.createDataFrame([(i, "token = " + "abcdefgh"[:i]) for i in range(1, n + 1)], "doc_id long, text string")
        assert sorted((r.doc_id, r.n_chars) for r in secrets.update(place, docs, rule).collect()) == [(i, i) for i in range(1, n + 1)]
    names = sorted(p.name for p in (tmp_path / "ledger").iterdir())
    assert sum(n.endswith("-fold") for n in names) >= 2
    last = [n for n in names if n.endswith("-fold")][-1]
    assert secrets.Ledger.load(spark, f"{place}/{last}").scanned.groupBy("blob").count().where("count > 1").count() == 0


def test_ledger(spark, monkeypatch, tmp_path):
    seen = []
    plain = secrets._matches

    def watched(df, rules):
        seen.append(sorted((r.text, tuple(r.todo or ["all"])) for r in df.select("text", "todo").collect()))
        return plain(df, rules)

    monkeypatch.setattr(secrets, "_matches", watched)
    a, b = 'token = "aaaaaaaaaa"', "nothing"
    one = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    old = (secrets.Rule("r", 1, "token = (.*)"),)
    place = str(tmp_path / "ledger")
    assert {r.doc_id for r in secrets.update(place, one, old).collect()} == {1, 3} and seen.pop() == [(b, ("all",)), (a, ("all",))]
    two = one.unionByName(spark.createDataFrame([(1, a + "!"), (4, b)], "doc_id long, text string"))
    assert {(r.doc_id, r.n_chars) for r in secrets.update(place, two, old).collect()} == {(1, 12), (3, 12), (1, 13)} and [t for t, _ in seen.pop()] == [a + "!"]
    new = (*old, secrets.Rule("s", 1, "(noth)"))
    got = secrets.update(place, two, new)
    assert {(r.doc_id, r.rule) for r in got.collect()} == {(1, "r"), (3, "r"), (2, "s"), (4, "s")} and {k for _, ks in seen.pop() for k in ks} == {"s@1"}
    assert secrets.update(place, two, new).count() == got.count() and seen.pop() == []
    newer = (secrets.Rule("r", 2, "(token)"), new[1])
    assert {(r.rule, r.version) for r in secrets.update(place, two, newer).collect()} == {("r", 2), ("s", 1)} and {k for _, ks in seen.pop() for k in ks} == {"r@2"}


# 5 Sharding


def test_sharding_equals_sql(docs, odd):
    for df in (docs, odd):
        assert rows(sharding.assign(df)) == by_sql(sharding.SQL, documents=arrow(df, "doc_id", "text"))
    assert sharding.assign(odd.limit(0)).count() == 0
    assert {r.shard for r in sharding.assign(odd.where("doc_id = 1")).collect()} == {0}


def test_shards_are_balanced(docs):
    got = sharding.assign(docs, 8).toPandas().sort_values("start_byte")
    assert got.shard.is_monotonic_increasing
    size, most = got.groupby("shard").n_bytes.sum(), got.n_bytes.max()
    assert (abs(size - got.n_bytes.sum() / 8) <= most).all()


# 6 Quality


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    ids, x, y = quality.sample(docs, labels)
    order = np.random.default_rng(1).permutation(len(y))
    fit, held = order[: len(y) * 2 // 3], order[len(y) * 2 // 3 :]
    trees = quality.fit(x[fit], y[fit])
    assert ((trees.score(x[held]) >= 0.5) == y[held]).mean() >= 0.95
    for j, c in enumerate(quality.FEATURES.values()):
        if c:
            values = np.quantile(x[:, j], np.linspace(0, 1, 25))
            curve = np.stack([trees.raw(np.where(np.arange(x.shape[1]) == j, v, x)) for v in values])
            assert (np.diff(curve, axis=0) * c >= -1e-12).all()
    assert len(quality.sample(docs, labels, max_rows=50)[0]) == 50
    scored = quality.score(docs, trees)
    again = trees.score(quality.statistics(pa.array([r.text for r in docs.orderBy("doc_id").collect()])))
    assert np.allclose([r.score for r in scored.orderBy("doc_id").collect()], again)


def slow_statistics(text):
    data = text.encode()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)
    low = [w.lower() for w in words]
    lines = [x for x in data.split(b"\n") if x]
    n, size = len(words), max(len(data), 1)
    letters = [c for c in data if chr(c) in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    space, wb = sum(c in b" \n\t\r" for c in data), sum(map(len, words))
    return [
        np.log1p(n), wb / max(n, 1), (len(data) - wb - space) / size, sum(c < 97 for c in letters) / max(len(letters), 1), sum(48 <= c <= 57 for c in data) / size,
        len(set(low)) / max(np.sqrt(n), 1), max([0, *Counter(low).values()]) / max(n, 1), len(set(zip(low, low[1:], strict=False))) / max(n - 1, 1), np.log1p(len(lines)), np.log1p(len(data) / max(len(lines), 1)),
        len({x.lower() for x in lines}) / max(len(lines), 1), data.count(b"!") / max(n, 1), data.count(b"|") / max(n, 1), data.count(b".") / max(n, 1), sum(c >= 128 for c in data) / size,
    ]


def test_statistics_equal_slow_ones(docs):
    texts = [r.text for r in docs.limit(60).collect()] + ["", "\n\n", "a", "A a\nA a\n", "é|!.", LONG]
    assert np.allclose(quality.statistics(pa.array(texts)), [slow_statistics(t) for t in texts])


def slow_trees(x, y, monotone, trees, depth, rate, bins, least):
    """Boosting by the book, one row and one split after the other: nested (feature, threshold, left,
    right) with numbers as leaves, and the base."""
    n, m = len(x), len(x[0])
    cuts = [sorted({sorted(r[j] for r in x)[math.floor(q * (n - 1))] for q in np.linspace(0, 1, bins + 1)[1:-1]}) for j in range(m)]
    base = math.log(sum(y) / (n - sum(y)))
    margin, forest = [base] * n, []

    def best_value(rows, low, high):
        g, h = sum(grad[r] for r in rows), sum(hess[r] for r in rows)
        return min(max(g / (h + 1), low), high), g, h

    def gain(g, h, v):
        return 2 * g * v - (h + 1) * v * v

    def grow(rows, low, high, left):
        value, g, h = best_value(rows, low, high)
        best = (1e-6, None)
        for j in range(m) if left else ():
            for c in cuts[j]:
                a, b = [r for r in rows if x[r][j] <= c], [r for r in rows if x[r][j] > c]
                if min(len(a), len(b)) < least:
                    continue
                (va, ga, ha), (vb, gb, hb) = best_value(a, low, high), best_value(b, low, high)
                if monotone[j] * (vb - va) < 0:
                    continue
                more = gain(ga, ha, va) + gain(gb, hb, vb) - gain(g, h, value)
                if more > best[0] + 1e-9:
                    best = (more, (j, c, a, b, va, vb))
        if best[1] is None:
            return rate * value
        j, c, a, b, va, vb = best[1]
        middle = (va + vb) / 2
        sides = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
        return (j, c, grow(a, *sides[0], left - 1), grow(b, *sides[1], left - 1))

    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in margin]
        grad, hess = [b - a for a, b in zip(p, y, strict=True)], [max(a * (1 - a), 1e-6) for a in p]
        tree = grow(range(n), -math.inf, math.inf, depth)
        forest.append(tree)
        margin = [v + walk(tree, r) for v, r in zip(margin, x, strict=True)]
    return base, forest


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_equal_slow_ones():
    """The histograms, the constraints and the flattened nodes."""
    rng = np.random.default_rng(7)
    for monotone in ((0, 0, 0), (1, -1, 0), (-1, -1, 1)):
        x = np.round(rng.normal(size=(90, 3)), 1)  # with ties
        y = (x[:, 0] - x[:, 1] + rng.normal(size=90) > 0).astype(float)
        fast = quality.fit(x, y, monotone, trees=4, depth=3, rate=0.3, bins=8, least=5)
        base, forest = slow_trees(x.tolist(), y.tolist(), monotone, 4, 3, 0.3, 8, 5)
        new = np.round(rng.normal(size=(200, 3)), 1)
        want = [base + sum(walk(t, r) for t in forest) for r in [*x.tolist(), *new.tolist()]]
        assert np.allclose(fast.raw(np.concatenate([x, new])), want)


def test_quality_sample_is_bounded(spark):
    """3,000 rows of one doc_id, equal and other ones, are one."""
    many = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    some = spark.createDataFrame([(2, "other"), (3, None), (4, "last"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (1, 1)], "doc_id long, quality int")
    ids, x, y = quality.sample(many.unionByName(some), labels, max_rows=10)
    assert ids.tolist() == [1, 2, 3, 4] and y.tolist() == [1, 0, 1, 0] and x.shape == (4, len(quality.FEATURES))
    assert len(quality.sample(many, labels, max_rows=1)[0]) <= 1


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (99, 0), (4, 0)], "doc_id long, quality int")
    assert quality.score(odd, quality.train(odd, labels)).count() == len(ODD)
    none = quality.train(odd, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score(odd, none).collect()} == {1.0}
    assert quality.score(odd.limit(0), none).count() == 0


# 7 Top-k


def brute_topk(data, k):
    best = {}
    for i, v in data:
        if i is not None and v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, list(v)), list(v))
    out = []
    for i, v in best.items():
        v = np.array(v, np.float32).astype(float)
        score = []
        for j, w in best.items():
            w = np.array(w, np.float32).astype(float)
            if i != j:
                score.append((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 6) + 0.0, j))
        out += [(i, r + 1, j, -s + 0.0) for r, (s, j) in enumerate(sorted(score)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "side"), [(4, 100), (7, 300), (1000, 1 << 20), (16, 1 << 20)])
def test_topk_equals_brute_force(spark, monkeypatch, block, side):
    """Grids of several rows and columns, and tiles smaller than their cells."""
    monkeypatch.setattr(topk, "TILE", 6)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = random.Random(block)
    data = [(i - 20, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]
    data += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (5, [9.0, 9.0, 9.0]), data[0], data[0]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("block", F.lit("x")).withColumn("id", F.lit("y")).withColumn("a.b", F.lit(1))
    want = brute_topk(data, 5)
    assert sorted(rows(topk.search(df, None, 5, block=block, side=side))) == want
    asks = topk.search(df, df.where("vec_id % 3 = 0"), 5, block=block, side=side)
    assert sorted(rows(asks)) == [r for r in want if r[0] % 3 == 0]
    wide = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(rows(topk.search(wide, wide.where("vec_id = 7"), 5, block=block, side=side))) == [r for r in want if r[0] == 7]
    if block == 7:
        assert topk.search(df.limit(0)).count() == 0 and topk.search(df, df.limit(0)).count() == 0
        assert topk.search(df.where("vec_id = 0 and embedding[0] is not null").limit(1)).count() == 0


def test_topk_tile():
    """Ties by the hundred, and scores nearer to each other than single precision can tell."""
    rng = np.random.default_rng(8)
    base = topk.unit(rng.normal(size=(1, 24)))
    m = np.concatenate([np.repeat(base, 700, 0), topk.unit(base + rng.normal(size=(900, 24)) * 1e-4), topk.unit(rng.normal(size=(400, 24)))])
    ids = rng.permutation(len(m)).astype(np.int64)
    q = np.concatenate([m[:3], m[900:905], m[-5:]])
    qids = np.concatenate([ids[:3], ids[900:905], [5000, 5001, 5002, 5003, 5004]])
    got_ids, got = topk.tile(qids, q, ids, m, 7)
    for k in range(len(q)):
        exact = np.rint(m @ q[k] * 1e6).astype(int)
        want = sorted((-int(s), int(i)) for s, i in zip(exact, ids, strict=True) if i != qids[k])[:7]
        assert [(-s, i) for s, i in zip(got[k].tolist(), got_ids[k].tolist(), strict=True)] == want


def test_topk_equals_sql(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = topk.search(df, df.where(F.col("vec_id") % topk.EVERY == 0), block=20, side=4000)
    assert rows(got) == by_sql(topk.SQL, embeddings=duckdb.read_parquet(f"{DATA}/embeddings.parquet").to_arrow_table())


# 8 Line dedup


def brute_dedup(data):
    """(doc_id, text) after dedup, for distinct ids."""
    seen, out = set(), []
    for i, text in sorted(data, key=lambda r: r[0]):
        if not text:
            out.append((i, text))
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            k = line.strip(" \t\r")
            if k and k in seen:
                gone += 1
                continue
            seen.add(k)
            kept.append(line)
        if not gone or any(x.strip(" \t\r") for x in kept):
            out.append((i, "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_equals_sql(docs):
    got = rows(linededup.dedup(docs.select("doc_id", "text"), count="n_removed"))
    assert got == by_sql(linededup.SQL, documents=arrow(docs, "doc_id", "text"))
    assert sorted([(a, b) for a, b, _ in got], key=repr) == brute_dedup([(r.doc_id, r.text) for r in docs.collect()])


def test_line_dedup_odd(odd):
    kept = linededup.dedup(odd, count="n_tokens")
    assert sorted(kept.columns) == sorted(odd.columns)
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert (-8, "same text twice") in got and (4, "and more") in got and (5, None) not in got and not any(i == 5 for i, _ in got)
    assert {(1, None), (2, ""), (7, " \n\n"), (6, "?!\n \n--"), (None, "no id here at all"), (3, LONG)} <= got
    assert linededup.dedup(odd.limit(0)).count() == 0


def test_line_dedup_is_incremental_and_reversible(spark):
    make = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    first, second, third = make((1, "a\nb"), (2, "b\nc")), make((3, "c\nd\na"), (4, "e\ne")), make((5, "a\nz"))
    s1, r1 = linededup.insert(first)
    s2, r2 = linededup.insert(second, s1)
    assert rows(linededup.apply(first, r1)) == [(1, "a\nb"), (2, "c")]
    assert rows(linededup.apply(second, r2)) == [(3, "d"), (4, "e")]
    refs = lambda s: sorted((r.hi, r.lo, r.refs) for r in s.refs.collect())
    sizes = lambda s: sum(len(cuckoo.CuckooFilter.from_bytes(r.filter)) for r in s.filters.collect())
    assert sizes(s2) == len(refs(s2)) == 5
    s3, back = linededup.delete(s2, make((3, None), (4, None)).select("doc_id"))
    assert refs(s3) == refs(s1) and sizes(s3) == sizes(s1) == 3 and back.count() == 0
    s4, back = linededup.delete(s2, make((1, None)).select("doc_id"))
    assert sorted((r.d, r.line) for r in back.collect()) == [(2, 0), (3, 2)]  # b comes back in 2, a in 3
    s5, r5 = linededup.insert(third, s4)
    assert rows(linededup.apply(third, r5)) == [(5, "z")]
    gone, _ = linededup.delete(s5, make(*[(i, None) for i in range(1, 6)]).select("doc_id"))
    assert refs(gone) == [] and sizes(gone) == 0 and gone.postings.count() == 0


def test_line_dedup_epochs(spark, odd, docs):
    """However many insertions the documents come in, and with filters and shards that are too small."""
    want = rows(linededup.dedup(docs.select("doc_id", "text"), count="n", epochs=1))
    assert rows(linededup.dedup(docs.select("doc_id", "text"), count="n", epochs=5)) == want
    assert rows(linededup.dedup(odd.select("doc_id", "text"), epochs=4)) == rows(linededup.dedup(odd.select("doc_id", "text"), epochs=1))


def test_line_store_grows(spark, monkeypatch):
    """Filters that overflow are built anew, shards double, and deletion still leaves nothing."""
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 4)
    make = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.concat(F.lit("line "), F.col("id"), F.lit("\nline "), F.col("id") % 50, F.lit("\nall have this")).alias("text"))
    store, removed, shards = None, [], []
    for a, b in ((0, 10), (10, 60), (60, 400), (400, 401)):
        store, gone = linededup.insert(make(a, b), store)
        removed += [(r.d, x) for r in gone.collect() for x in r.lines]
        shards.append(store.shards)
    seen, want = set(), []
    for i in range(401):
        for n, k in enumerate((f"line {i}", f"line {i % 50}", "all have this")):
            if k in seen:
                want.append((i, n))
            seen.add(k)
    assert sorted(removed) == want and shards[0] == 16 and shards[2] > shards[1] and store.keys == len(seen) == store.refs.count()
    held = {r.shard: cuckoo.CuckooFilter.from_bytes(r.filter) for r in store.filters.collect()}
    by = defaultdict(list)
    for r in store.refs.collect():
        by[r.shard].append((r.hi, r.lo))
    assert len(held) == store.filters.count() and all(held[s].contains(np.array(k, np.int64).view(np.uint64)).all() and len(held[s]) == len(k) for s, k in by.items())
    left, _ = linededup.delete(store, make(0, 401))
    assert left.keys == 0 and left.refs.count() == 0 and sum(len(cuckoo.CuckooFilter.from_bytes(r.filter)) for r in left.filters.collect()) == 0


def test_line_store_reversible_equals_sql(docs):
    got = rows(linededup.reversible(docs, F.pmod("doc_id", F.lit(2)) == 1, F.pmod("doc_id", F.lit(5)) == 0).select("event", "doc_id", "line"))
    assert got == by_sql(linededup.REVERSIBLE_SQL, documents=arrow(docs, "doc_id", "text")) and {r[0] for r in got} == {"removed", "back"}


def test_line_dedup_with_joins(docs, odd, monkeypatch):
    """Lists that are too long to be broadcast are joined."""
    want = [rows(linededup.dedup(x.select("doc_id", "text"))) for x in (docs, odd)]
    monkeypatch.setattr(_scale, "BROADCAST_BYTES", 0)
    assert [rows(linededup.dedup(x.select("doc_id", "text"))) for x in (docs, odd)] == want


def test_cuckoo():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 64, (20_000, 2), dtype=np.uint64)
    f = cuckoo.CuckooFilter.of(keys)
    assert len(f) == len(keys) and f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 64, (50_000, 2), dtype=np.uint64)).mean() < 0.001
    f.delete(keys[:12_000])
    assert len(f) == 8_000 and f.contains(keys[12_000:]).all() and f.contains(keys[:12_000]).mean() < 0.002
    f = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    assert f.insert(keys[:12_000]) and f.contains(keys).all()
    f.delete(keys)
    assert len(f) == 0


# 9 BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(Path(bpe.VOCABULARY).read_bytes())


def test_bpe_equals_whole_encoding(codec, docs):
    rng = random.Random(6)
    signs = " \n\t'sdtre.!aé漢1\x1c  "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(1500)]
    for t in [*texts, "x" * 5000, " " * 3000, "don't " * 700, *[r.text for r in docs.limit(20).collect()]]:
        want = codec.encoder.encode_ordinary(t)
        for leaf in (1, 5, 64):
            got = codec.encode(t, leaf, rng.choice([1, 2, 32]))
            assert got == want
        assert codec.decode(want, 7) == t


def test_bpe_frame(spark, odd, docs):
    got = bpe.encode(odd)
    assert sorted(got.columns) == sorted(odd.columns) and got.where("not exact").count() == 0 and got.where("tokens is null").count() == 1
    back = bpe.decode(got)
    assert back.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert bpe.encode(odd.limit(0)).count() == 0
    full = bpe.encode(docs.select("doc_id", "text"))
    assert full.where("not exact or size(tokens) <> n_tokens").count() == 0 and full.count() == docs.count()


# 10 Licenses


def test_licenses(spark, odd, docs):
    got = licenses.scan(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = {"all-rights-reserved": "All rights reserved", "Apache-2.0/short": "Licensed under the Apache License, Version 2.0", "MIT/short": "Released under the MIT License", "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3"}
    want = sorted((i, n) for i, t in texts.items() for n, p in plain.items() for _ in re.findall(re.escape(p), t))
    assert sorted((r.doc_id, r.license) for r in got) == want and want
    for r in got:
        assert texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode() == plain[r.license] and r.coverage == 1.0
    assert licenses.scan(odd).count() == 0 and licenses.scan(odd.limit(0)).count() == 0


def test_license_choice_equals_brute_force():
    rng = random.Random(9)
    scanner = licenses.Scanner({"a": "one two three", "b": "four five six seven"})
    for _ in range(60):
        chains = [(rng.randint(1, 9), a := rng.randint(0, 60), a + rng.randint(1, 12), rng.randint(0, 1)) for _ in range(rng.randint(0, 40))]
        kept = []
        for c in sorted(set(chains), key=lambda c: (-c[0], c[1], c[2], scanner.sizes[c[3]], scanner.names[c[3]])):
            if all(c[2] <= k[1] or k[2] <= c[1] for k in kept):
                kept.append(c)
        assert scanner.choose(chains) == sorted(kept, key=lambda c: c[1])


def test_licenses_in_repeated_rows(spark):
    """Every row reports for itself; a template twice in a text is found twice."""
    text = f"x {licenses.TEMPLATES['Apache-2.0/short']} y"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, f"{text} and then something else entirely, which goes on for a while so that nothing is chained: {text}")], "doc_id long, text string")
    got = Counter((r.doc_id, r.license) for r in licenses.scan(df).collect())
    assert got == {(1, "Apache-2.0/short"): 2, (None, "Apache-2.0/short"): 1, (2, "Apache-2.0/short"): 2}


def test_license_variants(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = "é\n * " + mit.upper().replace("FREE OF CHARGE, ", "").replace("TO DEAL", "TO REALLY DEAL") + " tail"
    df = spark.createDataFrame([(1, changed), (2, mit[: len(mit) // 3]), (3, "the above copyright notice and the rights to use"), (4, (mit + " x ") * 2)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, round(r.coverage, 2)) for r in licenses.scan(df).collect())
    assert [g[:2] for g in got] == [(1, "MIT"), (4, "MIT"), (4, "MIT")] and 0.9 < got[0][2] < 1


def test_matching_statistics_equal_brute_force():
    scanner = licenses.Scanner({"a": "x y z x y w", "b": "y z x q", "c": "w w"}, min_match=2)
    _, _, _, hashed = licenses.split(pa.array(["x y z w q"]))
    number = {w: int(np.searchsorted(scanner.vocabulary, h)) for w, h in zip("xyzwq", hashed, strict=True)}
    templates = ["x y z x y w".split(), "y z x q".split(), "w w".split()]
    rng = random.Random(9)
    for _ in range(200):
        text = [rng.choice("xyzwq") for _ in range(rng.randrange(1, 12))]
        want = set()
        runs = {(s, e) for s in range(len(text)) for e in range(s + 1, len(text) + 1) if any(text[s:e] == t[u : u + e - s] for t in templates for u in range(len(t)))}
        for s, e in runs:
            if e - s >= 2 and (s - 1, e) not in runs and (s, e + 1) not in runs:
                want |= {(k, s, u, e - s) for k, t in enumerate(templates) for u in range(len(t) - (e - s) + 1) if t[u : u + e - s] == text[s:e]}
        assert set(scanner.anchors([number[w] for w in text])) == want


def test_license_scan_equals_one_template_each():
    """A template is found whatever runs go on in others: chains are those of scanners of one each."""
    templates = {"a": "x y z x y w x", "b": "y z x q", "c": "w x y", "d": "z x y w", "e": "x y z x y w x z z y q"}
    both, rng = licenses.Scanner(templates, 2, 3, 0.6), random.Random(10)
    for _ in range(300):
        text = [rng.choice("xyzwq") for _ in range(rng.randrange(1, 20))] + ["end"]
        want = []
        for k, (name, t) in enumerate(templates.items()):
            runs = {(s, e) for s in range(len(text)) for e in range(s + 2, len(text) + 1) if any(text[s:e] == t.split()[u : u + e - s] for u in range(len(t.split())))}
            own = [(k, s, u, e - s) for s, e in runs if (s - 1, e) not in runs and (s, e + 1) not in runs for u in range(len(t.split())) if t.split()[u : u + e - s] == text[s:e]]
            want += both.chains(own)
            one = licenses.Scanner({name: t}, 2, 3, 0.6)
            assert [(r[2], r[3], r[4]) for r in one.scan(pa.array([" ".join(text)]))] == [(2 * a, 2 * b - 1, n) for n, a, b, _ in both.choose(both.chains(own))]
        assert [(r[1], r[2], r[3], r[4]) for r in both.scan(pa.array([" ".join(text)]))] == [(t, 2 * a, 2 * b - 1, n) for n, a, b, t in both.choose(want)]
    notice = 'Licensed under the Apache License, Version 2.0 (the "License"); see LICENSE for details.'
    scanner = licenses.Scanner()
    assert [(scanner.names[t], start, end) for _, t, start, end, _ in scanner.scan(pa.array([notice]))] == [("Apache-2.0/short", 0, 46)]


def test_whole_licenses():
    scanner = licenses.Scanner()
    found = lambda text: [(scanner.names[t], n / scanner.sizes[t]) for _, t, _, _, n in scanner.scan(pa.array([text]))]
    for name, text in licenses.TEMPLATES.items():
        assert found(f"Preface\n{text}\nEnd") == [(name, 1.0)], name
    mit, bsd = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["BSD-2-Clause"]
    assert mit.endswith("DEALINGS IN THE SOFTWARE.") and len(licenses.TEMPLATES["Apache-2.0"].split()) > 1500
    assert found(mit[: mit.index(" IN NO EVENT")]) == [("MIT/permission", 1.0)] and found(bsd[: bsd.index(" THIS SOFTWARE IS")]) == [("BSD-2-Clause/conditions", 1.0)]


# Pipeline


def test_pipeline_equals_brute_force(spark, docs, codec):
    import corpus_pipeline

    kept = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_duplicates", "mixture", "tokens"] and corpus_pipeline.ORACLE_SQL is None
    texts = dict(brute_dedup([(i, r.text) for i, r in kept.items()]))  # no document is of an unknown language
    stage = spark.createDataFrame([(i, t, kept[i].lang, kept[i].source, len(t)) for i, t in texts.items()], SCHEMA)
    gone = {a for a, _ in brute_duplicates(stage)}
    stage = stage.where(~F.col("doc_id").isin(*gone)) if gone else stage
    mixed = {r[0] for r in by_sql(mixing.SQL, documents=arrow(stage, "doc_id", "source", "text"))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == mixed
    for i, r in got.items():
        assert r.tokens == codec.encoder.encode_ordinary(texts[i]) and r.exact and r.n_tokens == len(r.tokens) and (r.lang, r.source, r.n_chars) == (kept[i].lang, kept[i].source, len(texts[i]))


def test_pipeline_on_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline

    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, "")
            out.collect()
            if name != "tokens":
                assert sorted(out.columns) == sorted(df.columns), name
