"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its content. A ledger holds, for each blob,
the rules (with their versions) that have already seen it, and the findings. A scan works out which
blobs are new to which rules, runs just those pairs, once for each blob however many paths have it,
adds to the ledger, and joins the findings back to all paths. A second scan of the same content runs
nothing; a new version of one rule runs that rule alone. A scan appends to the ledger what is new and
leaves the rest as it is; a blob may have several entries, whose rules add up. A ledger in a folder is a
series of such additions, which are folded into one when there are ``FOLD`` of them.

Which rows to read text of is settled on ids and hashes. If those to leave out are few they are
broadcast, and no text is shuffled; likewise if those to scan are few; otherwise texts are joined by
their hash. Matching is done by the JVM's regex engine on whole texts.

Defined cases: a null content is no version and has no findings; an empty one is a blob like others. A
null path (doc_id) is a path. A path may have many versions. Repeated rows give one report. Every
match counts, numbered from 0 in order of place (``nth``); secrets themselves aren't stored, only their
SHA-256 and length. Very long texts are matched whole. An empty table adds nothing and reports nothing.
Other columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _scale


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str  # group 1 is the secret; the subset that Java and RE2 share
    needle: str = ""  # text without it can't match

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


_EDGE = r"(?:^|[^0-9A-Za-z_])"
#: Those that the SQL has too.
SQL_RULES = (
    Rule("aws_access_key", 1, _EDGE + r"((?:AKIA|ASIA)[0-9A-Z]{16})", "IA"),
    Rule("github_token", 1, _EDGE + r"(gh[pousr]_[0-9A-Za-z]{36,})", "_"),
    Rule("slack_token", 1, _EDGE + r"(xox[abprs]-[0-9A-Za-z-]{10,})", "xox"),
    Rule("payment_key", 1, _EDGE + r"([rs]k_live_[0-9A-Za-z]{16,})", "k_live_"),
    Rule("google_api_key", 1, _EDGE + r"(AIza[0-9A-Za-z_-]{35})", "AIza"),
    Rule("private_key", 1, r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----)", "-----BEGIN "),
    Rule("json_web_token", 1, _EDGE + r"(eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})", "eyJ"),
    Rule("url_password", 1, _EDGE + r"[a-z][a-z0-9+.-]{1,15}://[^ /:@\n]{1,64}:([^ /@\n]{1,64})@", "://"),
    Rule("assigned_secret", 1, r"""(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi_?[Kk]ey|API_?KEY)["']?[ \t]*[:=][ \t]*["']([^"' \t\n]{8,})["']"""),
)
#: What lies beyond the bounds of url_password and the prefixes of github_token; no text matches both.
RULES = (
    *SQL_RULES,
    Rule("github_fine_grained_token", 1, _EDGE + r"(github_pat_[0-9A-Za-z_]{22,})", "github_pat_"),
    Rule("url_password_long", 1, _EDGE + r"[a-z][a-z0-9+.-]{1,15}://[^ /:@\n]{1,64}:([^ /@\n]{65,})@", "://"),
    Rule("url_password_other_user", 1, _EDGE + r"[a-z][a-z0-9+.-]{1,15}://(?:[^ /:@\n]{65,})?:([^ /@\n]+)@", "://"),
)
_SCANNED, _FINDINGS = "blob binary, rules array<string>", "blob binary, rule string, version int, nth int, n_chars int, secret_sha256 string"


#: Additions to a ledger from which on they are folded.
FOLD = 16


@dataclass
class Ledger:
    """(blob, rules) that have been scanned, and the findings by blob; ``new``: what the last scan added."""

    scanned: DataFrame
    findings: DataFrame
    new: Ledger | None = None

    @staticmethod
    def empty(spark: SparkSession) -> Ledger:
        return Ledger(spark.createDataFrame([], _SCANNED), spark.createDataFrame([], _FINDINGS))

    @staticmethod
    def load(spark: SparkSession, *paths: str) -> Ledger:
        return Ledger(spark.read.schema(_SCANNED).parquet(*[f"{p}/scanned" for p in paths]), spark.read.schema(_FINDINGS).parquet(*[f"{p}/findings" for p in paths]))

    def folded(self) -> Ledger:
        """With one entry for each blob."""
        return Ledger(self.scanned.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules")), self.findings)

    def save(self, path: str) -> None:
        self.scanned.write.parquet(f"{path}/scanned")
        self.findings.write.parquet(f"{path}/findings")


def _blob(text="text"):
    return F.unhex(F.sha2(F.col(text), 256))


def _finding(rule: Rule):
    return lambda s, i: F.struct(
        F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), i.cast("int").alias("nth"),
        F.length(s).alias("n_chars"), F.sha2(s, 256).alias("secret_sha256"),
    )


def _matches(rows: DataFrame, rules) -> DataFrame:
    """rows: (blob, text, todo); todo null: all rules."""
    found = []
    for r in rules:
        wanted = F.col("todo").isNull() | F.array_contains("todo", r.key)
        if r.needle:
            wanted &= F.contains(F.col("text"), F.lit(r.needle))
        secrets = F.when(wanted, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(1)))
        found.append(F.transform(secrets, _finding(r)))
    nothing = F.expr("cast(array() as array<struct<rule: string, version: int, nth: int, n_chars: int, secret_sha256: string>>)")
    return rows.select("blob", F.explode(F.flatten(F.array(*[F.coalesce(x, nothing) for x in found]))).alias("f")).select("blob", "f.*").distinct()


def scan(docs: DataFrame, ledger: Ledger | None = None, rules=RULES) -> tuple[Ledger, DataFrame]:
    """Bring the ledger up to date with all versions in ``docs`` (doc_id, text) and report, for
    these rules: (doc_id, rule, version, nth, n_chars, secret_sha256) for every path."""
    spark = docs.sparkSession
    texts = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    paths = _scale.stored(texts.select("doc_id", _blob().alias("blob")), "paths")
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is None:
        ledger = Ledger.empty(spark)
        todo = blobs.withColumn("todo", keys)
    else:
        seen = Ledger(ledger.scanned.join(blobs.select("blob"), "blob", "left_semi"), ledger.findings).folded().scanned
        todo = blobs.join(seen, "blob", "left").select("blob", "doc_id", F.array_except(keys, F.coalesce("rules", F.expr("cast(array() as array<string>)"))).alias("todo"))
    todo = _scale.stored(todo.where(F.size("todo") > 0), "todo")
    n = todo.agg(F.count("*"), F.coalesce(F.bool_and(F.size("todo") == len(rules)), F.lit(True))).first()
    same = lambda a, b: a["blob"].eqNullSafe(b["blob"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    source = texts.select("doc_id", _blob().alias("blob"), "text")
    others = paths.join(todo, same(paths, todo), "left_anti").distinct()
    if n[1] and _scale.small_enough(others.count(), 48):
        rows = source.join(F.broadcast(others), same(source, others), "left_anti").withColumn("todo", F.lit(None).cast("array<string>"))
    else:
        if _scale.small_enough(n[0], 300):
            todo = F.broadcast(todo)
        rows = source.join(todo, same(source, todo)).select(source["blob"], "text", "todo")
    fresh = _scale.stored(_matches(rows, rules), "findings")
    new = Ledger(todo.select("blob", F.col("todo").alias("rules")), fresh)
    after = Ledger(ledger.scanned.unionByName(new.scanned), ledger.findings.unionByName(fresh), new)
    current = F.concat_ws("@", "rule", "version").isin(*[r.key for r in rules])
    report = paths.distinct().join(after.findings.where(current), "blob").drop("blob")
    return after, report


def update(path: str, docs: DataFrame, rules=RULES) -> DataFrame:
    """:func:`scan` against the ledger under ``path`` in the shared folder, to which what is new is
    added. An addition counts once it is written whole."""
    spark = docs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [p for p in sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(hadoop(f"{path}/{p}/done"))] if fs.exists(root) else []
    # What has been folded counts no more; the number of the last one is in the fold's name.
    folds = [p for p in done if p.endswith("-fold")]
    current = [p for p in done if not folds or p > folds[-1] or p == folds[-1]]

    def add(ledger: Ledger, name: str) -> None:
        ledger.save(f"{path}/{name}")
        fs.create(hadoop(f"{path}/{name}/done")).close()

    after, report = scan(docs, Ledger.load(spark, *[f"{path}/{p}" for p in current]) if current else None, rules)
    add(after.new, f"{len(done):08d}-{uuid.uuid4().hex}")
    if len(current) + 1 >= FOLD:
        add(after.folded(), f"{len(done) + 1:08d}-{uuid.uuid4().hex}-fold")
    return report


def rescan(docs: DataFrame, earlier, rules: Sequence[Rule]) -> DataFrame:
    """The report of a second scan: the first one saw the documents for which ``earlier`` holds, with all
    rules but the last."""
    before, _ = scan(docs.where(earlier), None, rules[:-1])
    return scan(docs, before, rules)[1]


def _sql() -> str:
    parts = []
    for r in SQL_RULES:
        pattern = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{r.name}' AS rule, {r.version} AS version, regexp_extract_all(text, '{pattern}', 1) AS m FROM (SELECT DISTINCT doc_id, text FROM documents)")
    return f"""
WITH found AS ({' UNION ALL '.join(parts)}),
each AS (SELECT doc_id, rule, version, unnest(m) AS secret, unnest(range(len(m))) AS nth FROM found)
SELECT doc_id, rule, CAST(version AS INTEGER) AS version, CAST(nth AS INTEGER) AS nth,
       CAST(length(secret) AS INTEGER) AS n_chars, sha256(secret) AS secret_sha256 FROM each
"""


SQL = _sql()
