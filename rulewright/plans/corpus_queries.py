"""Queries of the rule engine that meet its rules and structures with whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_folder
from ..operators import bitmaps, decoding, markup, referential
from ..operators.lint import compiled
from ..operators.rulebits import RuleBits
from ..sources import catalogue
from ..sources.shipped import shipped_files
from ..streaming import repeats
from ..streaming.validate import write_errors
from . import decoding_sql, markup_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_RULE_IDS = [rule["id"] for _, data in shipped_files() for rule in data.get("rules", [])]


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_bitmaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RuleBits]:
    lines = decoding.decode(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep_empty=True)
    return bitmaps.document_bitmaps(bitmaps.wording_parts(lines), compiled(catalogue.shipped(spark)), bitmaps.WORDING)


@_query(decoding_sql.ROLES)
def document_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of every line of every document, decoded as a sequence, and how sure it is."""
    lines = decoding.decode(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "seq", "role", F.round("confidence", 6).alias("confidence"))


@_query(decoding_sql.bitmaps(_RULE_IDS))
def document_rule_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document breaks, keeps and does not meet of all rules, by the wording of its decoded lines."""
    found, _ = _line_bitmaps(spark, sf_dir)
    return found.select("doc_id", *[F.get(c, F.lit(0)).alias(c) for c in ("broken", "kept", "unmet")])


@_query(decoding_sql.coverage(_RULE_IDS))
def document_rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each rule is broken, kept and not met."""
    return bitmaps.rule_coverage(*_line_bitmaps(spark, sf_dir))


# ---- nested structure of pages -----------------------------------------------------------------

#: Parts of a page that a text may belong to.
REGIONS = ("head", "nav", "article", "div", "footer", "table", "figure")


@_query(markup_sql.PAGE_NODES)
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element and text of every page with its interval, its parent and its depth."""
    return markup.page_nodes(_read(spark, sf_dir, "pages").select("page_id", "html")).drop("text")


@_query(markup_sql.passages(REGIONS))
def page_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of every page with the innermost region that it lies in, by a join of intervals."""
    nodes = markup.page_nodes(_read(spark, sf_dir, "pages").select("page_id", "html"))
    nodes = nodes.select("page_id", "node", "last", "kind", F.length("text").cast("long").alias("n_chars"))
    return markup.nearest(nodes, F.col("kind") == markup.TEXT, F.col("kind").isin(*REGIONS)).select("page_id", "node", "around", "region", "n_chars")


# ---- referential checks ------------------------------------------------------------------------

#: (name, children, their key, parents, their key)
RELATIONS = (
    ("labels of documents", "labels", "doc_id", "documents", "doc_id"),
    ("orders of customers", "orders", "o_custkey", "customer", "c_custkey"),
    ("lines of orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lines of parts", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lines of suppliers", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events of customers", "events", "user_id", "customer", "c_custkey"),
)


def _faults_sql() -> str:
    parts = []
    for name, child, a, parent, b in RELATIONS:
        parts.append(f"SELECT DISTINCT '{name}' AS relation, 'dangling' AS fault, {a}::BIGINT AS key FROM {child} c WHERE {a} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{b} = c.{a})")
        parts.append(f"SELECT DISTINCT '{name}', 'unreferenced', {b}::BIGINT FROM {parent} p WHERE {b} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {child} c WHERE c.{a} = p.{b})")
    return " UNION ALL ".join(parts)


@_query(_faults_sql())
def reference_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a parent and parents without a child, over six relations of the given tables."""
    return referential.faults([(name, _read(spark, sf_dir, child), a, _read(spark, sf_dir, parent), b) for name, child, a, parent, b in RELATIONS])


@_query("SELECT user_id, event_type, count(*) AS n FROM events e WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id) GROUP BY 1, 2")
def events_of_unknown_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user is no customer, by user and kind: filtered on the scan before anything is moved."""
    lost = referential.missing(_read(spark, sf_dir, "events"), "user_id", _read(spark, sf_dir, "customer"), "c_custkey")
    return lost.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# ---- repeats on a stream -----------------------------------------------------------------------


@_query("""WITH o AS (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), event_id) AS nth FROM events WHERE ts IS NOT NULL)
    SELECT event_id AS key, 'duplicate user_id,event_type' AS error FROM o WHERE nth > 1 AND epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) - 60000 FROM events)""")
def event_repeats_on_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that repeat user and kind of an earlier one, found on a stream over the table as far as its watermark came."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: a stream takes a single file by no other name
    errors = repeats.stream_repeats(rows, "event_id", ("user_id", "event_type"), "ts", "1 minute")
    out = shared_folder(spark, "repeats")
    write_errors(errors, f"{out}/errors", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("key long, error string").parquet(f"{out}/errors")
