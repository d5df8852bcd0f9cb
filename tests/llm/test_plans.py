"""What the plans must not hold: Python where it is barred, shuffles where none is due, products of tables."""

import re

from rulewright.llm import bpe_codec, minhash_dedup, packing, quality_rules, secret_scan, substring_dedup, token_counts, toxicity, url_filter


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_quality_rules_run_no_python(edge_docs):
    for frame in (quality_rules.text_statistics(edge_docs), quality_rules.judge(edge_docs), quality_rules.keep_documents(edge_docs)):
        assert not re.search("Python|Pandas|Arrow", plan(frame))


def test_narrow_operators_do_not_shuffle(spark, edge_docs):
    scored = toxicity.score(edge_docs, {3: 0.5})
    pages = url_filter.judge(edge_docs.selectExpr("doc_id as page_id", "text as url"))
    for frame in (token_counts.prefix_table(edge_docs), token_counts.document_counts(edge_docs), packing.cut_pieces(edge_docs), scored, pages, quality_rules.text_statistics(edge_docs)):
        assert "Exchange" not in plan(frame)


def test_only_chunks_of_long_texts_are_moved(edge_docs):
    """Texts of one chunk are encoded where they are: the branch that reads their results has no exchange."""
    lines = plan(bpe_codec.round_trip(edge_docs)).split("Union\n")[1].splitlines()
    short = [x for x in lines if re.match(r" *:", x)]
    assert any("IsNull(chunk" in x for x in short) and not any("Exchange" in x for x in short)
    assert sum("Exchange" in x for x in lines) == 4


def test_no_products_of_tables(edge_docs):
    for frame in (minhash_dedup.near_duplicates(edge_docs), substring_dedup.parse_documents(edge_docs), secret_scan.document_findings(edge_docs), packing.pack_documents(edge_docs), quality_rules.judge(edge_docs)):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(frame))


def test_only_needed_columns_are_read(spark, edge_docs, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "d"))
    read = re.search(r"ReadSchema: (\S+)", plan(token_counts.prefix_table(spark.read.parquet(str(tmp_path / "d"))))).group(1)
    assert read == "struct<doc_id:bigint,text:string>"
