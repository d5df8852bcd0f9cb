import os

import brute
import corpus_pipeline
import pytest
from brute import prose

from rulewright.llm import queries
from rulewright.llm.bpe_codec import codec
from rulewright.llm.common import stored


@pytest.fixture(scope="module")
def docs(spark):
    passage = prose(70, 60)
    rows = []
    for k in range(120):
        text = prose(1000 + k, 90)
        if k % 10 == 1:
            text = rows[-1][1] if k % 20 == 1 else rows[-1][1] + " tail"
        if k % 10 == 3:
            text += " " + passage + " " + prose(k, 5)
        if k % 10 == 5:
            text += " password = 'abcdefghijkl9' end"
        if k % 10 == 7:
            text = "short text"
        rows.append((k, text, "en", "s0", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_effect(spark, docs):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "near-duplicates", "substring dedup", "secret scan", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = stage["quality rules"](spark, docs, "")
    assert {r.doc_id for r in good.collect()} == {i for i, t in rows.items() if not brute.quality(t)[-1]}
    one = stage["near-duplicates"](spark, good, "")
    groups = brute.near([(r.doc_id, r.text) for r in good.collect()], width=5)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if i == c}
    bare = stage["substring dedup"](spark, one, "")
    lost = brute.substrings([(r.doc_id, r.text) for r in one.collect()])
    assert sum(n for _, n, _ in lost.values()) > 500
    assert {r.doc_id: len(r.text.split()) for r in bare.collect()} == {i: n - m for i, (n, m, _) in lost.items()}
    clean = stage["secret scan"](spark, bare, "")
    assert sum("[assign]" in r.text for r in clean.collect()) == 12 and not any(brute.secrets(r.text) for r in clean.collect())
    for out in (good, one, bare, clean):
        assert out.columns == docs.columns
        assert all(r.n_chars == len(r.text) for r in out.collect())
    packed = stage["packing"](spark, clean, "").collect()
    assert delivered(packed) == {r.doc_id: r.text for r in clean.collect()}


def delivered(packed) -> dict:
    """Texts of a packed corpus by document, from nothing but the token ids."""
    bytes_of, parts = codec("byte_bpe_50k.tiktoken").bytes_of, {}
    for r in sorted(packed, key=lambda r: (repr(r.doc_id), r.piece)):
        assert len(r.ids) == r.length
        parts.setdefault(r.doc_id, []).extend(r.ids)
    assert all(ids[-1] == 0 for ids in parts.values())
    return {i: b"".join(map(bytes_of.__getitem__, ids[:-1])).decode() for i, ids in parts.items()}


def expected(rows: list[tuple]) -> dict:
    """What the five stages leave of (doc_id, text), by plain versions of them (all texts of one clean group)."""
    good = [(i, t) for i, t in rows if not brute.quality(t)[-1]]
    groups = brute.near(good, width=5)
    one = [(i, t) for i, t in good if groups[i][1] == i]
    out = {}
    for i, spans in brute.parse(one).items():
        words = brute.WORD.findall(dict(one)[i])
        gone = {k for a, b, *_ in spans for k in range(a, b)}
        text = " ".join(w for k, w in enumerate(words) if k not in gone) if spans else dict(one)[i]
        spans = [(int(s), int(e), kind) for kind, s, e in (x.split(":") for x in brute.secrets(text).split(",") if x)]
        for start, end, kind in reversed(spans):
            text = text[:start] + f"[{kind}]" + text[end:]
        out[i] = text
    return out


def test_run_delivers_the_corpus(spark, docs, tmp_path):
    """The whole pipeline against plain versions: the packed ids decode to the cleaned texts."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 80 and delivered(packed) == want


def test_run_keeps_no_more_than_two_stages_on_disk(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir")
    before, seen = set(os.listdir(shared)), []
    pack = corpus_pipeline.STAGES[-1][1]

    def last(*args):
        seen.extend(sorted(p.split("-")[0] + p.split("-")[1][:1] for p in set(os.listdir(shared)) - before))
        return pack(*args)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:-1], ("packing", last)])
    other = stored(spark.range(5), "other")
    before = set(os.listdir(shared))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 80
    assert seen == ["stage3"] and other.count() == 5


def test_rows_without_or_with_the_same_id_keep_their_own_redacted_texts(spark):
    """Two null ids and two texts of one id go through the last two stages; no secret stays."""
    texts = ["token=qrstuvwxyzabcdef one", "plain text", "secret=abcdefghijklmnop two", "password = 'abcdefghijkl9' three", "same", "same"]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip([None, None, 7, 7, 8, 8], texts, strict=True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = dict(corpus_pipeline.STAGES)["secret scan"](spark, frame, "")
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == [(0, "[assign] one"), (0, "plain text"), (7, "[assign] two"), (7, "[assign]' three"), (8, "same"), (8, "same")]
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, clean, "").collect()
    bytes_of = codec("byte_bpe_50k.tiktoken").bytes_of
    assert sorted(b"".join(map(bytes_of.__getitem__, r.ids[:-1])).decode() for r in packed) == sorted(r.text for r in clean.collect())


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_take_edge_cases(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, "")
            if name != "packing":
                assert out.columns == docs.columns
                kept = spark.createDataFrame(out.collect(), out.schema)
        assert out.count() >= kept.count()
    for name, stage in corpus_pipeline.STAGES:  # each on the raw cases, too
        assert stage(spark, edge_docs, "").count() > 0, name


def test_rows_without_or_with_the_same_id_are_judged_by_their_own_texts(spark):
    """Junk and copies under null and repeated ids go; no text that nobody else has does."""
    one, two, three, four = (prose(500 + k, 80) for k in range(4))
    junk = "bad words " * 40
    rows = [(7, one, "en", "s"), (7, junk, "en", "s"), (None, two, "en", "s"), (None, junk, "en", "s"), (900, three, "en", "s"), (None, three, "en", "s"), (None, three, "en", "s"), (3, four, "en", "s"), (5, four, "en", "s"), (5, one + " tail", "en", "s"), (8, prose(600, 80), "en", "s"), (8, prose(600, 80), "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality rules"](spark, docs, "")
    assert sorted(map(repr, map(tuple, good.collect()))) == sorted(map(repr, (r for r in rows if r[1] != junk)))
    kept = [tuple(r)[:2] for r in stage["near-duplicates"](spark, good, "").collect()]
    assert good.columns == docs.columns and (None, two) in kept and (900, three) in kept and (3, four) in kept and [r[0] for r in kept].count(8) == 1
    assert sum(t.startswith(one) for _, t in kept) == 1 and len(kept) == 5
    passages = [(None, one + " " + two), (4, two + " " + four), (None, "own words only")]
    bare = stage["substring dedup"](spark, spark.createDataFrame(passages, "doc_id long, text string"), "")
    assert sorted((r.doc_id or 0, r.text) for r in bare.collect()) == sorted([(0, one), (4, two + " " + four), (0, "own words only")])
