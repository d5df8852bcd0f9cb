import pytest
import yaml

from rulewright import cli
from rulewright.operators import catalogue as ops
from rulewright.plans import validator
from rulewright.sources import catalogue
from rulewright.sources.fixtures import rule
from rulewright.sources.shipped import ENUMS, REQUIRED_FIELDS, UNKNOWNS, shipped_files


def messages(spark, rules, *more):
    files = [("manuscript.yaml", {"rules": rules}), *more]
    rows = validator.rule_errors(catalogue.from_files(spark, files)).orderBy("file_ord", "rule_ord", "err_ord").collect()
    return [r.message for r in rows]


def test_shipped_catalogue_is_valid(spark):
    rules = catalogue.shipped(spark)
    assert validator.report(rules) == (0, ["OK: 49 rules validated"])
    facets = {(r.facet, r.value): r.n for r in ops.profile(rules).collect()}
    assert [facets["domain", d] for d in ENUMS["domain"]] == [23, 15, 11]
    assert [facets["severity", s] for s in ("error", "manual_review", "warning")] == [41, 5, 3]
    assert [facets["autofix", a] for a in ("conditional", "never", "safe")] == [29, 18, 2]
    assert facets["source_type", "red_annotation"] == 28 and facets["source_type", "explicit_instruction"] == 21
    assert facets["normativity", "mandatory"] == 46 and facets["normativity", "recommended"] == 3
    assert rules.select("target").distinct().count() == 48 and rules.select("id").distinct().count() == 49
    assert len(UNKNOWNS) == 13


def test_an_empty_rule_has_thirteen_errors(spark):
    found = messages(spark, [{}])
    assert found[:8] == [f"<missing-id>: missing required field {f}" for f in REQUIRED_FIELDS]
    assert found[8:] == [f"<missing-id>: invalid {w} None" for w in ("domain", "normativity", "autofix", "source_type", "lint severity")]


def test_absent_ids_share_one_identity(spark):
    assert messages(spark, [rule(("id",)), rule(("id",))]) == ["<missing-id>: missing required field id", "<missing-id>: duplicate id", "<missing-id>: missing required field id"]
    assert messages(spark, [rule(("id",)), rule(id="<missing-id>")]) == ["<missing-id>: missing required field id", "<missing-id>: duplicate id"]


def test_a_null_id_is_present(spark):
    assert messages(spark, [rule(id=None)]) == []
    assert messages(spark, [rule(id=None), rule(id="None")]) == []
    assert messages(spark, [rule(id=None), rule(id=None)]) == ["None: duplicate id"]


def test_ids_are_compared_as_values(spark):
    """1, 1.0 and true are one id, "1" is another; every message names the id as it is written."""
    assert messages(spark, [rule(id=1), rule(id=1.0), rule(id=True), rule(id="1"), rule(id=1.5)]) == ["1.0: duplicate id", "True: duplicate id"]


def test_dates_are_listed_as_they_print(spark):
    import datetime

    day = rule(id=datetime.date(2020, 1, 1), target=datetime.date(2021, 2, 3))
    rules = catalogue.from_files(spark, [("manuscript.yaml", {"rules": [day, day]})])
    assert {r.line for r in ops.list_lines(rules).collect()} == {"2020-01-01\t2021-02-03\tmandatory\tsafe"}
    assert messages(spark, [day, day]) == ["2020-01-01: duplicate id"]


def test_duplicates_within_and_across_files(spark):
    assert messages(spark, [rule(id="A"), rule(id="A"), rule(id="A")]) == ["A: duplicate id"] * 2
    assert messages(spark, [rule(id="A")], ("citations.yaml", {"rules": [rule(id="A")]})) == ["A: duplicate id"]


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"source": {}}, "invalid source_type None"),
        ({"domain": True}, "invalid domain True"),
        ({"domain": "it's"}, 'invalid domain "it\'s"'),
        ({"domain": 3}, "invalid domain 3"),
        ({"normativity": "unknown"}, "invalid normativity 'unknown'"),
        ({"lint": {"severity": "fatal"}}, "invalid lint severity 'fatal'"),
        ({"autofix": None}, "invalid autofix None"),
    ],
)
def test_messages(spark, change, error):
    assert messages(spark, [rule(id="X", **change)]) == [f"X: {error}"]


def test_absent_source_is_two_errors(spark):
    assert messages(spark, [rule(("source",), id="X")]) == ["X: missing required field source", "X: invalid source_type None"]


def test_extra_fields_are_accepted(spark):
    assert messages(spark, [rule(extra=1)]) == []


@pytest.mark.parametrize("broken", ["text", rule(source=None), rule(lint=None), rule(domain=["manuscript"]), rule(id=["a"])])
def test_faults_that_stop_a_run_are_kept_apart(spark, broken):
    rules = catalogue.from_files(spark, [("manuscript.yaml", {"rules": [broken]})])
    assert validator.broken_rules(rules).count() == 1 and validator.rule_errors(rules).count() == 0
    with pytest.raises(ValueError, match="not a"):
        validator.report(rules)


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "rules"
    folder.mkdir()
    for name, data in shipped_files():
        (folder / name).write_text(yaml.safe_dump(data, allow_unicode=True), encoding="utf-8")
    (folder / "schema.yaml").write_text(yaml.safe_dump({"rule_schema": {"required_fields": list(REQUIRED_FIELDS), "enums": {k: list(v) for k, v in ENUMS.items()}}}))
    (folder / "other.yaml").write_text("rules: [{}]")
    return tmp_path


def test_files_read_like_the_shipped_rows(spark, root):
    want = [r.asDict() for r in catalogue.shipped(spark).selectExpr("* except (requirement)", "to_json(requirement) as r").orderBy("file_ord", "rule_ord").collect()]
    read = catalogue.load(spark, str(root)).selectExpr("* except (requirement)", "to_json(requirement) as r").orderBy("file_ord", "rule_ord").collect()
    assert [{k: v for k, v in r.asDict().items() if k != "present_fields"} for r in read] == [{k: v for k, v in r.items() if k != "present_fields"} for r in want]
    spark.dataSource.register(catalogue.CatalogueSource)
    assert spark.read.format("rule_catalogue").load(str(root)).count() == 49


def test_evidence_is_kept(spark, root):
    found = rule(source={"source_id": "S", "source_type": "example", "locator": "p. 3", "evidence": "in these words"})
    (root / "rules" / "citations.yaml").write_text(yaml.safe_dump({"rules": [found, rule(id="ER-MS-Y-001")]}))
    rows = catalogue.load(spark, str(root)).where("file = 'citations.yaml'").orderBy("rule_ord").collect()
    assert [(r.locator, r.evidence) for r in rows] == [("p. 3", "in these words"), (None, None)]


def test_registers_are_read_from_the_folder(spark, root):
    """Conflicts of the folder govern its rules, not those that are shipped."""
    assert [d.count() for d in catalogue.load_registers(spark, str(root))] == [0, 0, 0]
    conflict = {"id": "C1", "topic": "t", "status": "open", "source_a": {"rule_id": "ER-MS-TITLE-001"}, "source_b": {"source_id": "S9"}, "execution": {"lint": "info", "autofix": "never"}}
    (root / "rules" / "conflicts.yaml").write_text(yaml.safe_dump({"conflicts": [conflict]}))
    (root / "rules" / "unresolved.yaml").write_text(yaml.safe_dump({"unknowns": [{"id": "U1", "topic": "t", "status": "s"}]}))
    (root / "sources" / "normalized").mkdir(parents=True)
    (root / "sources" / "normalized" / "source-index.yaml").write_text(yaml.safe_dump({"sources": [{"id": "ER-REF-GUIDE", "medium": "markdown", "special_handling": {"careful": True}}, {"id": "ER-MS-IMG-NOTES", "medium": "m"}]}))
    rules = catalogue.load(spark, str(root))
    conflicts, unknowns, sources = catalogue.load_registers(spark, str(root))
    policy = {r.id: (r.severity, r.autofix, r.conflict_id) for r in ops.effective_policy(rules, conflicts).collect()}
    assert policy["ER-MS-TITLE-001"] == ("info", "never", "C1") and policy["ER-REF-FOREIGN-AUTHOR-001"] == ("error", "never", None)
    assert [tuple(r) for r in ops.dangling_references(rules, conflicts, sources).collect()] == [("conflict source", "C1", "S9")]
    assert [tuple(r) for r in unknowns.collect()] == [("U1", "t", "s")] and {r.source_id: r.handling for r in sources.collect()}["ER-REF-GUIDE"] == {"careful": True}


def test_schema_is_data(spark, root):
    schema = catalogue.load_schema(spark, str(root))
    assert schema.required == REQUIRED_FIELDS
    schema.enums["autofix"] = ("safe",)
    assert validator.rule_errors(catalogue.load(spark, str(root)), schema).count() == 47


@pytest.mark.parametrize(("content", "error"), [("[]", "citations.yaml holds a list where a mapping"), ("", "citations.yaml holds nothing where a mapping"), ("rules: null", "citations.yaml has a NoneType under 'rules' where a list"), ("rules: {a: 1}", "citations.yaml has a dict under 'rules' where a list")])
def test_faulty_files(spark, root, content, error):
    (root / "rules" / "citations.yaml").write_text(content)
    with pytest.raises(Exception, match=error):
        catalogue.load(spark, str(root)).count()


def test_a_file_without_rules_gives_none(spark, root):
    (root / "rules" / "citations.yaml").write_text("version: 1")
    assert catalogue.load(spark, str(root)).count() == 34


def test_command_line(spark, root, capsys):
    assert cli.main(["validate-rules"]) == 0 and capsys.readouterr().out == "OK: 49 rules validated\n"
    assert cli.main(["--root", str(root), "list-rules"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 49 and lines[0] == "ER-MS-TITLE-001\ttitle\tmandatory\tconditional"
    (root / "rules" / "citations.yaml").write_text(yaml.safe_dump({"rules": [rule(autofix="x")]}))
    assert cli.main(["--root", str(root), "validate-rules"]) == 1
    assert capsys.readouterr().out == "ERROR ER-MS-X-001: invalid autofix 'x'\n"
    with pytest.raises(SystemExit) as end:
        cli.main([])
    assert end.value.code == 2


def test_listing_an_incomplete_rule_fails(spark, tmp_path):
    rules = catalogue.from_files(spark, [("manuscript.yaml", {"rules": [rule(("autofix",))]})])
    with pytest.raises(Exception, match="KeyError: autofix"):
        ops.list_lines(rules).collect()
    ops.write_listing(catalogue.shipped(spark), str(tmp_path / "list"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "list")).count() == 49


def test_governance(spark):
    rules, found = catalogue.shipped(spark), ops.conflicts(spark)
    assert ops.governance_findings(rules).count() == 0
    assert ops.dangling_references(rules, found, ops.sources(spark)).count() == 0
    policy = {r.id: (r.severity, r.autofix, r.conflict_id) for r in ops.effective_policy(rules, found).collect()}
    assert policy["ER-REF-FOREIGN-AUTHOR-001"] == ("manual_review", "never", "ER-CONFLICT-002")
    assert policy["ER-MS-REF-PAGERANGE-001"] == ("error", "safe", None)
    bad = catalogue.from_files(spark, [("manuscript.yaml", {"rules": [rule(id="nonsense", normativity="example_only", lint={"severity": "error"})]})])
    assert {r.finding for r in ops.governance_findings(bad).collect()} == {"id", "severity"}


def test_order_does_not_depend_on_partitions(spark):
    rules = catalogue.from_files(spark, [("manuscript.yaml", {"rules": [{}, rule(), rule()]})])
    order = ("file_ord", "rule_ord", "err_ord")
    assert validator.rule_errors(rules.repartition(5)).orderBy(*order).collect() == validator.rule_errors(rules.coalesce(1)).orderBy(*order).collect()


def test_repeats_in_tables_are_those_behind_the_first(spark):
    """Nulls are one identity; rows that tie for the first place are all repeats."""
    rows = [(1, "a", 5), (2, "a", 3), (3, "a", 9), (4, None, 1), (5, None, 2), (6, "b", 1), (7, "c", 4), (8, "c", 4), (9, "c", 7)]
    table = spark.createDataFrame(rows, "id long, u string, o int")
    errors = validator.table_errors(table, "id", unique=("u",), order=("o",))
    assert sorted(r.key for r in errors.collect()) == [1, 3, 5, 7, 8, 9]
    assert "Window" not in errors._jdf.queryExecution().executedPlan().toString()
