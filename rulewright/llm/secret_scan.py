"""Secret scanning with an incremental blob ledger.

A blob is a text under its SHA-256.  The ledger holds, for every pair of blob and
rule version that was ever scanned, the findings (possibly none), filed by rule
version.  The version is a digest of the rules themselves, so changed rules never
meet old findings.  A scan

1. addresses every version of every path by content,
2. keeps the pairs of blob and rule version which the ledger lacks, one path
   for each blob; this list is a stored table of eight bytes a row, so Spark
   knows its size: below the session's broadcast bound it goes to the texts, and
   only above it are texts moved to the list,
3. runs the rules over just those texts and appends to the ledger,
4. joins the findings back to all paths that hold the blob.

The rules are matched from the left without overlap, each kind on its own; a
match that fails its length test is used up, but not reported.

Special cases: a null text counts as empty; positions count code points, ends
are exclusive; equal texts share one ledger entry; spans at one start are
ordered by kind as listed in ``KINDS``; findings and redactions belong to the
text, by its content address, so rows with null or repeated keys each get those of their own text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, prepare, scratch_path, small_batches, stored, text_column

#: Fixed by the contract: kind -> pattern, group that is measured, least length of it.
KINDS = ("assign", "access", "hex")
RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}


def version_of(rules: dict[str, tuple]) -> str:
    """A name for these rules that changes with any of their patterns, flags, groups and lengths."""
    listed = [(kind, p.pattern, int(p.flags), group, least) for kind, (p, group, least) in rules.items()]
    return "rules-" + hashlib.sha256(repr(listed).encode()).hexdigest()[:16]


RULE_VERSION = version_of(RULES)
LEDGER_DDL = "blob string, rule_version string, spans string, n_assign long, n_access long, n_hex long"


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, by start, then kind as listed."""
    found = []
    for order, kind in enumerate(KINDS):
        pattern, group, least = RULES[kind]
        if kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each finding (overlapping ones as one) replaced by a placeholder of its first kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], f"[{kind}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def parse_spans(spans: str) -> list[tuple[int, int, str]]:
    return [(int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(","))] if spans else []


def blob_id(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of (blob, text); a narrow stage."""
    prepare(blobs.sparkSession)
    schema = pa.schema([("blob", pa.string()), ("rule_version", pa.string()), ("spans", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS)])

    def each(batch: pa.RecordBatch) -> dict:
        rows = [find_spans(t or "") for t in text_column(batch, "text")]
        counts = {f"n_{k}": [sum(x[2] == k for x in r) for r in rows] for k in KINDS}
        return {"blob": batch.column(0), "rule_version": [rule_version] * len(rows), "spans": [",".join(f"{k}:{s}:{e}" for s, e, k in r) for r in rows]} | counts

    return map_arrow(blobs.select("blob", "text"), each, schema, LEDGER_DDL)


class BlobLedger:
    """The ledger as a Parquet table in a shared folder; appended to by one scan at a time, never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def rows(self, rule_version: str | None = None) -> DataFrame:
        """All pairs, or those of one rule version (one folder of the table)."""
        if not self._fs.exists(self._path):
            return self.spark.createDataFrame([], LEDGER_DDL)
        found = self.spark.read.schema(LEDGER_DDL).parquet(self.path).select(*[c.split()[0] for c in LEDGER_DDL.split(", ")])
        return found if rule_version is None else found.where(F.col("rule_version") == rule_version)

    def update(self, versions: DataFrame, key_cols: list[str], text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
        """Scan what is unseen, append it, and return (keys, blob) of every version as a stored table."""
        mark = F.xxhash64(*key_cols, "blob").alias("_mark")
        addressed = versions.select(*key_cols, F.col(text_col).alias("text")).withColumn("blob", blob_id(F.col("text")))
        paths = stored(addressed.drop("text"), "paths")
        known = self.rows(rule_version).select("blob")
        unseen = paths.groupBy("blob").agg(F.min(mark).alias("_mark")).join(known, "blob", "left_anti").select("_mark")
        here = addressed.join(stored(unseen, "unseen"), mark == F.col("_mark"), "left_semi")
        # marks choose the texts; that a pair enters once is settled on the blobs themselves, without texts
        found = scan_blobs(here, rule_version).dropDuplicates(["blob"]).join(known, "blob", "left_anti")
        with small_batches(self.spark):
            found.select(*[c.split()[0] for c in LEDGER_DDL.split(", ")]).write.mode("append").partitionBy("rule_version").parquet(self.path)
        return paths

    def scan(self, versions: DataFrame, key_cols: list[str], text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
        """(keys, blob, ledger columns) of every version; only unseen pairs are scanned.

        ``versions`` has one row for each path and version, named by ``key_cols``.
        """
        return self.update(versions, key_cols, text_col, rule_version).join(self.rows(rule_version), "blob")


def new_ledger(spark: SparkSession) -> BlobLedger:
    """An empty ledger among the intermediate tables; give ``BlobLedger`` a path to keep one."""
    return BlobLedger(spark, scratch_path(spark, "ledger"))


def document_findings(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Findings of every document, with the digest of the base spans."""
    ledger = ledger or new_ledger(docs.sparkSession)
    found = ledger.scan(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


def redact_documents(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """The documents with every finding replaced by a placeholder; all rows and columns stay.

    Findings meet texts by content address, whatever the ids are.
    """
    spark = docs.sparkSession
    prepare(spark)
    ledger = ledger or new_ledger(spark)
    paths = ledger.update(docs.select("doc_id", "text"), ["doc_id"])
    hits = ledger.rows(RULE_VERSION).where("spans <> ''").join(paths, "blob", "left_semi").select(F.col("blob").alias("_rw_blob"), F.col("spans").alias("_rw_spans"))

    @F.pandas_udf("string")
    def cleaned(text, spans):
        return text.combine(spans, lambda t, s: redact(t, parse_spans(s)) if s else t)

    joined = docs.withColumn("_rw_blob", blob_id(F.col("text"))).join(stored(hits, "hits"), "_rw_blob", "left")
    clean = F.when(F.col("_rw_spans").isNull(), F.col("text")).otherwise(cleaned(F.coalesce("text", F.lit("")), F.coalesce("_rw_spans", F.lit(""))))
    return joined.withColumn("text", clean).select(*docs.columns)


def spans_digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
