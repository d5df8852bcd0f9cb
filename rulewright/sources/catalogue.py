"""Rule catalogues as DataFrames.

A catalogue is a folder with a ``rules`` folder of YAML files: ``schema.yaml``
and the files of ``RULE_FILES``, in that order.  Each list item becomes a row

    file_ord int, rule_ord int, file string, present_fields array<string>,
    id, domain, target, normativity, autofix, source_id, source_type,
    severity, locator, evidence (strings, null if absent or null),
    requirement variant, shown map<string,string>, broken array<string>

``locator`` and ``evidence`` say where a rule was found and in what words.
``present_fields`` keeps absent apart from null.  ``shown`` holds how Python
prints a value, for messages, and ``identity``, by which ids are compared.  ``broken`` names the faults on which a loop over
plain Python objects would stop (a rule that is no mapping, a null ``source`` or
``lint``, a list or mapping where a name is due).
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.ship import ship
from .shipped import ENUMS, REQUIRED_FIELDS, RULE_FILES, shipped_files

RAW_DDL = (
    "file_ord int, rule_ord int, file string, present_fields array<string>, id string, domain string, target string, normativity string, autofix string, "
    "source_id string, source_type string, severity string, locator string, evidence string, requirement_json string, shown map<string,string>, broken array<string>"
)
CONFLICTS_DDL = "conflict_id string, topic string, status string, a_rule_id string, b_rule_id string, b_source_id string, lint string, autofix string, effective_rule string"
UNKNOWNS_DDL = "unknown_id string, topic string, status string"
SOURCES_DDL = "source_id string, medium string, handling map<string,boolean>"
_NAMES = ("id", "domain", "target", "normativity", "autofix")
_CHECKED = ("id", "domain", "normativity", "autofix")


def read_yaml(content: bytes, where: str) -> dict[str, Any]:
    """What a YAML file says.  Anything but a mapping is refused, under the file's name; so is an empty file, which says nothing."""
    import yaml

    match yaml.load(content, Loader=yaml.SafeLoader):
        case dict() as said:
            return said
        case other:
            raise ValueError(f"{where} holds {'nothing' if other is None else 'a ' + type(other).__name__} where a mapping is due")


def rules_of(said: dict[str, Any], where: str) -> list:
    """The rules in a file's mapping: none without the key ``rules``, and no other kind of value than a list."""
    match said:
        case {"rules": list() as rules}:
            return rules
        case {"rules": other}:
            raise ValueError(f"{where} has a {type(other).__name__} under 'rules' where a list is due")
    return []


def _text(value: Any) -> str | None:
    """A value as it is printed; dates and numbers, which YAML reads from bare words, too."""
    return value if isinstance(value, str) or value is None else str(value)


def _identity(rule: dict) -> str:
    """Equal for ids that are equal in Python: 1, 1.0 and true are one id, "1" is another."""
    value = rule.get("id", "<missing-id>")
    if isinstance(value, (bool, int, float)):
        return f"number {int(value) if value == value // 1 else value}"
    return repr(value)


def rule_row(file_ord: int, rule_ord: int, file: str, rule: Any) -> tuple:
    """One row of RAW_DDL."""
    if not isinstance(rule, dict):
        return (file_ord, rule_ord, file, [], *[None] * 10, None, {}, ["rule is not a mapping"])
    broken = [f"{k} is not a scalar" for k in _CHECKED if isinstance(rule.get(k), (list, dict, set))]
    nested: dict[str, Any] = {}
    for outer, inner in (("source", "source_type"), ("source", "source_id"), ("lint", "severity")):
        box = rule.get(outer, {})
        if not isinstance(box, dict):
            broken += [f"{outer} is not a mapping"] * (inner != "source_id")
            box = {}
        nested[inner] = box.get(inner)
        if inner != "source_id" and isinstance(nested[inner], (list, dict, set)):
            broken.append(f"{inner} is not a scalar")
    shown = {k: repr(rule.get(k)) for k in _CHECKED} | {k: repr(nested[k]) for k in ("source_type", "severity")}
    shown |= {"label": str(rule.get("id", "<missing-id>")), "identity": _identity(rule)}
    origin = rule["source"] if isinstance(rule.get("source"), dict) else {}
    requirement = json.dumps(rule["requirement"], ensure_ascii=False, default=str) if "requirement" in rule else None
    return (file_ord, rule_ord, file, [str(k) for k in rule], *[_text(rule.get(k)) for k in _NAMES], _text(nested["source_id"]), _text(nested["source_type"]), _text(nested["severity"]), _text(origin.get("locator")), _text(origin.get("evidence")), requirement, shown, broken)


def _typed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("requirement", F.parse_json("requirement_json")).drop("requirement_json")


def from_files(spark: SparkSession, files: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """A catalogue of parsed files, in the order given."""
    rows = [rule_row(f, r, name, rule) for f, (name, data) in enumerate(files) for r, rule in enumerate(rules_of(data, name))]
    return _typed(spark.createDataFrame(rows, RAW_DDL))


def shipped(spark: SparkSession) -> DataFrame:
    """The shipped catalogue."""
    return from_files(spark, shipped_files())


def _refuse_empty(spark: SparkSession, paths: list[str]) -> None:
    """A scan leaves out files without bytes, so they are looked at beforehand."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen() == 0:
            read_yaml(b"", path)


def load(spark: SparkSession, root: str) -> DataFrame:
    """Read ``{root}/rules`` from any file system Spark reads; a missing file or a fault in one is an error."""
    names = list(RULE_FILES)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                file = posixpath.basename(path)
                rows += [rule_row(names.index(file), k, file, r) for k, r in enumerate(rules_of(read_yaml(content, path), file))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW_DDL.split(", ")])

    ship(spark)
    paths = [f"{root}/rules/{n}" for n in names]
    _refuse_empty(spark, paths)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return _typed(files.mapInPandas(parse, RAW_DDL))


class RuleSchema:
    """Required fields and allowed values: themselves data, read at run time."""

    def __init__(self, required: tuple[str, ...] = REQUIRED_FIELDS, enums: dict[str, tuple[str, ...]] = ENUMS):
        self.required = tuple(required)
        self.enums = {k: tuple(dict.fromkeys(enums[k])) for k in ("domain", "normativity", "autofix", "source_type", "lint_severity")}


def load_schema(spark: SparkSession, root: str) -> RuleSchema:
    """The schema of a catalogue; a missing key is a KeyError."""
    _refuse_empty(spark, [f"{root}/rules/schema.yaml"])
    row = spark.read.format("binaryFile").load(f"{root}/rules/schema.yaml").select("path", "content").first()
    schema = read_yaml(bytes(row["content"]), row["path"])["rule_schema"]
    return RuleSchema(schema["required_fields"], schema["enums"])


def _register(spark: SparkSession, path: str, key: str) -> list[dict]:
    """The entries of a register file; a catalogue without the file has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    _refuse_empty(spark, [path])
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return read_yaml(bytes(row["content"]), path).get(key) or []


def load_registers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conflicts, unknowns, sources) of a catalogue folder, with the columns of those that are shipped."""
    conflicts = []
    for c in _register(spark, f"{root}/rules/conflicts.yaml", "conflicts"):
        a, b, rest = c.get("source_a") or {}, c.get("source_b") or {}, c.get("execution") or {}
        conflicts.append((c.get("id"), c.get("topic"), c.get("status"), a.get("rule_id"), b.get("rule_id"), b.get("source_id"), rest.get("lint"), rest.get("autofix"), rest.get("effective_rule")))
    unknowns = [(u.get("id"), u.get("topic"), u.get("status")) for u in _register(spark, f"{root}/rules/unresolved.yaml", "unknowns")]
    sources = [(x.get("id"), x.get("medium"), x.get("special_handling") or {}) for x in _register(spark, f"{root}/sources/normalized/source-index.yaml", "sources")]
    return spark.createDataFrame(conflicts, CONFLICTS_DDL), spark.createDataFrame(unknowns, UNKNOWNS_DDL), spark.createDataFrame(sources, SOURCES_DDL)


class CatalogueSource(DataSource):
    """``spark.read.format("rule_catalogue").load(root)`` for catalogues on a path that all executors mount; ``load`` reads any file system."""

    @classmethod
    def name(cls) -> str:
        return "rule_catalogue"

    def schema(self) -> str:
        return RAW_DDL

    def reader(self, schema) -> DataSourceReader:
        return _CatalogueReader(self.options["path"])


class _CatalogueReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k, n)) for k, n in enumerate(RULE_FILES)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        k, file = partition.value
        path = f"{self.root}/rules/{file}"
        with open(path, "rb") as f:
            data = read_yaml(f.read(), path)
        for r, rule in enumerate(rules_of(data, file)):
            yield rule_row(k, r, file, rule)
