"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Method: every historical version of a file is content-addressed (SHA-256 of its text). A
ledger says which blobs were scanned under which version of the rules; only unseen pairs
are scanned, each blob once, however many paths and versions hold it. Findings belong to
blobs and are joined back to all paths.

``regexp_extract_all`` gives a rule's leftmost non-overlapping matches and ``split`` the
texts between them; a running sum of their lengths gives positions, in code points.

The base rules are ``assign access hex``; ``pem jwt github slack`` are added. A cheap guard
(a fixed word, or one look for the rule's beginning) spares most texts both passes.

Defined results: a null text is the empty blob and has no spans; equal texts give equal
findings, one row for each input row; without a ledger everything is unseen; a row of the
ledger without a span says that a blob was scanned; an empty table gives no rows. Only the
named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import no_nulls, settle


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # of the whole span
    guard: str  # a regular expression without which the pattern can't match
    least: int  # characters of the group
    group: int = 0


# What secrets look like.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]""", 8, 2),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA", 16),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32}", 32),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ", 1),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_", 1),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-", 1),
)
BASE = 3
RULES_VERSION = "1"


def blob_id(text: Column) -> Column:
    return F.sha2(no_nulls(text), 256)


def findings(blobs: DataFrame) -> DataFrame:
    """(blob, rank, start, end): the spans of each distinct text of ``blobs`` (blob, t)."""
    literal = lambda x: x.isalnum() or x == "-----BEGIN"
    tests = [F.col("t").contains(r.guard) if literal(r.guard) else F.col("t").rlike(r.guard) for r in RULES]
    marked = blobs.select("blob", "t", F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in enumerate(tests)])).alias("ranks")).where(F.size("ranks") > 0)
    one = marked.select("blob", "t", F.explode("ranks").alias("rank"))

    def by_rule(make):
        out = None
        for k, r in enumerate(RULES):
            out = F.when(F.col("rank") == k, make(r)) if out is None else out.when(F.col("rank") == k, make(r))
        return out

    cut = one.select(
        "blob",
        "rank",
        F.arrays_zip(
            by_rule(lambda r: F.split("t", r.pattern, -1)).alias("gap"),
            by_rule(lambda r: F.regexp_extract_all("t", F.lit(r.pattern), F.lit(0))).alias("whole"),
            by_rule(lambda r: F.regexp_extract_all("t", F.lit(r.pattern), F.lit(r.group))).alias("part"),
        ).alias("cut"),
    )
    rows = cut.select("blob", "rank", F.posexplode("cut").alias("at", "c"))
    rows = rows.select("blob", "rank", "at", F.length("c.gap").alias("gap"), F.length("c.whole").alias("whole"), F.length("c.part").alias("part")).dropDuplicates(["blob", "rank", "at"])
    upto = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("whole", F.lit(0))).over(upto))
    least = F.array(*[F.lit(r.least) for r in RULES])
    return ends.where(F.col("whole").isNotNull() & (F.col("part") >= F.element_at(least, F.col("rank") + 1))).select("blob", "rank", (F.col("end") - F.col("whole")).alias("start"), "end")


LEDGER = "blob string, rules_version string, rank int, start long, end long"
LISTED = 500_000  # hashes with ids, about 60 MB when broadcast


def unseen(history: DataFrame, ledger: DataFrame | None, id_col: str, text: str, version: str) -> DataFrame:
    """(blob, t): rows of each blob that this version of the rules hasn't seen, those of its least id.

    Hashes and ids are compared, not texts: what is then left out, or taken, is broadcast if
    it is at most ``LISTED`` rows, so that no text is shuffled. Rows that repeat an id and a
    text both come; their findings are equal and count once.
    """
    rows = history.select(F.col(id_col).cast("long").alias("id"), no_nulls(F.col(text).cast("string")).alias("t")).withColumn("blob", F.sha2("t", 256))
    hashes = rows.select("blob", "id")
    if ledger is not None:
        hashes = hashes.join(ledger.where(F.col("rules_version") == version).select("blob").distinct(), "blob", "left_anti")
    least = hashes.groupBy("blob").agg(F.min("id").alias("least"), F.count_distinct(F.coalesce("id", F.lit(-(2**62)))).alias("n"))
    if ledger is None:  # the rows left out, those of a text's other ids, are fewer than those that stay
        listed, how = hashes.join(least.where("n > 1").select("blob", "least"), "blob").where("NOT (id <=> least)").select("blob", "id").distinct(), "left_anti"
    else:
        listed, how = least.select("blob", F.col("least").alias("id")), "left_semi"
    listed = settle(listed.select(F.col("blob").alias("a_blob"), F.col("id").alias("an_id")), "secrets-listed")
    few = F.broadcast(listed) if listed.count() <= LISTED else listed
    return rows.join(few, (F.col("blob") == F.col("a_blob")) & F.col("id").eqNullSafe(F.col("an_id")), how).select("blob", "t")


def scan(history: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """New rows of the ledger (LEDGER): the spans of each unseen blob, and one row without a span for each."""
    blobs = unseen(history, ledger, id_col, text, version)
    return blobs.select("blob").distinct().select("blob", F.lit(-1).alias("rank"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")).unionByName(findings(blobs)).select("blob", F.lit(version).alias("rules_version"), "rank", "start", "end")


def advanced(history: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """The ledger after ``history``, written: what was known and what was new."""
    new = settle(scan(history, ledger, id_col, text, version), "secrets-ledger")
    return new if ledger is None else ledger.select(*new.columns).unionByName(new)


def digests(found: DataFrame) -> DataFrame:
    """One row for each blob with findings: the counts and joined spans."""
    names = F.array(*[F.lit(r.kind) for r in RULES])
    joined = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))))
    spans = found.groupBy("blob").agg(*[F.count_if(F.col("rank") == k).alias(f"n_{RULES[k].kind}") for k in range(BASE)], F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))
    return spans.select("blob", *[f"n_{RULES[k].kind}" for k in range(BASE)], F.sha2(joined(F.filter("spans", lambda x: x["rank"] < BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def report(history: DataFrame, id_col: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, version: str = RULES_VERSION) -> DataFrame:
    """One row for each path and version of a file: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The findings are those of the ledger after ``history``: a blob that ``ledger`` (LEDGER)
    lists under this version of the rules is not scanned again, and its findings are joined
    to all its paths all the same.
    """
    known = advanced(history, ledger, id_col, text, version).where((F.col("rules_version") == version) & (F.col("rank") >= 0))
    paths = history.select(F.col(id_col).cast("long").alias("doc_id"), blob_id(F.col(text).cast("string")).alias("blob"))
    # Written first, so that the join stands alone and the rows of a common blob can be split.
    out = paths.join(settle(digests(known), "secrets-digests"), "blob", "left")
    none = F.sha2(F.lit(""), 256)
    return out.select("doc_id", *[F.coalesce(f"n_{RULES[k].kind}", F.lit(0).cast("long")).alias(f"n_{RULES[k].kind}") for k in range(BASE)], F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def incremental_report(history: DataFrame, batches: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``report`` after the history came in batches, by hash of the id: each scans what the ledger lacks."""
    ledger = None
    turn = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(batches))
    for k in range(batches - 1):
        ledger = advanced(history.where(F.coalesce(turn, F.lit(0)) == k), ledger, id_col, text)
    return report(history, id_col, text, ledger)
