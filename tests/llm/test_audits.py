import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from brute import prose

from rulewright.llm import decontamination, periodic_runs, queries, source_divergence
from rulewright.llm.common import WordHashes, hash_filter


@pytest.fixture
def without_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def items(texts):
    base = texts[5].split()
    return [
        (1, " ".join(base[20:50])), (2, " ".join(base[20:50])), (10, "Two  WORDS"), (3, "one"), (4, None), (5, " .,; "), (6, prose(9, 40)), (7, "x " * 12), (None, " ".join(base[100:115])),
        (8, "line-line, line"), (9, " ".join(texts[16].split()[29_980:])), (11, "é ﬁ中文 endoftext it"), (1, "a second text of this item that no document has at all"),
    ]


def check_contamination(spark, docs, rows, listed, **kw):
    bench = spark.createDataFrame(listed, "item_id long, text string").selectExpr("*", "-1 as doc_id", "'x' as record", "0 as n")
    out = decontamination.judge(docs, bench, **kw).collect()
    want = [(i, n, sorted(hit), ids) for (i, *_), (n, hit, ids) in zip(rows, brute.contamination([r[1] for r in rows], listed, **kw), strict=True)]
    got = [(r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.end)], r.items) for r in out]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in out)
    return want


def test_contamination(spark, edge_docs, edge_rows, no_docs):
    listed = items([r[1] for r in edge_rows])
    want = check_contamination(spark, edge_docs, edge_rows, listed)
    assert sum(bool(x[2]) for x in want) > 8 and any(len(x[3]) > 1 for x in want)
    bench = spark.createDataFrame(listed, "item_id long, text string")
    digests = {repr((r.doc_id, r.n_words)): r for r in decontamination.document_digests(edge_docs, bench).collect()}
    for i, n, hit, ids in want:
        r = digests[repr((i, n))]
        assert (r.n_hit, r.n_items, r.contaminated, r.items_sha256) == (len(hit), len(ids), bool(hit), hashlib.sha256(",".join(ids).encode()).hexdigest())
    assert decontamination.judge(no_docs, bench).count() == 0
    assert decontamination.judge(edge_docs, bench.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0


def test_contamination_by_exchange(spark, edge_docs, edge_rows, without_broadcast):
    check_contamination(spark, edge_docs, edge_rows, items([r[1] for r in edge_rows]))


@pytest.mark.parametrize("least", [0.8, 0.5, 0.2])
def test_windows_that_are_contained_in_part(spark, least):
    rng = random.Random(3)
    record = prose(1, 30).split()
    docs = []
    for k in range(60):
        words = [w if rng.random() > 0.12 else "other" for w in record]
        docs.append((k, " ".join(words[rng.randint(0, 8) : rng.randint(12, 30)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = check_contamination(spark, frame, docs, [(1, " ".join(record)), (2, "other " * 6)], least=least)
    assert 0 < sum(bool(x[2]) for x in want) < 60 or least < 0.5


def test_records_are_joined_by_their_rarest_shingles(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h i j" if k else "a b c d e x c d e f g y") for k in range(3)], "doc_id long, text string")
    found = decontamination.records(spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "never seen words " * 5)], "item_id long, text string"))
    distinct = found.dropDuplicates(["record"]).drop("item_id")
    counts = decontamination.shingle_counts(docs, hash_filter(distinct.selectExpr("explode(hashes) as h")), [5])
    index = decontamination.prefix_index(distinct, counts).collect()
    assert len(index) == 1 and index[0].offset != 0 and index[0].offset != 2  # those that stand in all three
    assert decontamination.prefix_index(distinct, counts, 0.5).count() == 4


def test_clean_documents_by_row(spark):
    leak = prose(1, 12)
    rows = [(1, "own text " + leak, 5), (1, "another text of this id", 6), (None, leak, 7), (None, "no leak", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int")
    kept = decontamination.clean_documents(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.n_hit for r in kept.collect()) == [6, 8, 9]


def test_hash_filter_has_no_misses(spark):
    for n in (0, 1, 5000):
        h = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
        passes = hash_filter(spark.createDataFrame([(int(x),) for x in h], "h long"))
        assert passes(h).all() and passes(np.arange(1000) * 7919).mean() < 0.2


def test_runs_of_numbers():
    rng, total = random.Random(5), 0
    for _ in range(1500):
        n, size, least = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 4]), rng.choice([12, 4, 2, 6, 13])
        s = [rng.randrange(size) for _ in range(n)]
        if n > 8 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        want = brute.runs(s, least)
        assert periodic_runs.runs_of(np.array(s, np.int64), least) == want
        assert periodic_runs.word_runs([b"%d" % x for x in s], WordHashes(), least) == want
        total += len(want)
    assert total > 2000


def test_suffix_tree_parts():
    s = np.array([ord(c) for c in "mississippi" * 3])
    order, rank = periodic_runs.suffix_order(s)
    text = [tuple(s[k:]) for k in range(len(s))]
    assert order.tolist() == sorted(range(len(s)), key=text.__getitem__) and (order[rank] == np.arange(len(s))).all()
    shared = periodic_runs.common_prefixes(s, order, rank)
    for r in range(1, len(s)):
        a, b = text[order[r - 1]], text[order[r]]
        assert shared[r] == next(k for k in range(len(s) + 1) if a[k : k + 1] != b[k : k + 1] or k == len(a))
    for depth, low, high, first, last in periodic_runs.inner_nodes(shared).tolist():
        assert min(shared[low + 1 : high + 1]) == depth and shared[low] < depth and (high + 1 == len(s) or shared[high + 1] < depth)
        edges = [low, *[k for k in range(low + 1, high + 1) if shared[k] == depth], high + 1]
        sizes = {(a, b - 1): b - a for a, b in zip(edges, edges[1:])}
        assert sizes[first, last] == max(sizes.values())


def test_long_runs_take_no_square():
    for s in (np.zeros(100_000, np.int64), np.arange(100_000) % 700):
        assert periodic_runs.runs_of(s) == [(0, 100_000, int(s.max()) + 1)]


def digest_of(words):
    found = brute.runs(words)
    gone = {p for s, n, q in found for p in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


def run_rows(edge_rows):
    rng = random.Random(2)
    texts = [r[1] for r in edge_rows if r[0] != 16] + ["a b " * 30, ("x y z " * 5 + "q ") * 4, "w " * 11, "w " * 12, " ".join(rng.choice("ab") for _ in range(300))]
    return [*enumerate(texts), (None, texts[-1]), (3, "a " * 20), (3, "a " * 20)]


def test_document_runs(spark, edge_rows, no_docs):
    rows = run_rows(edge_rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as runs", "1 as start", "2 as period")
    out = periodic_runs.run_digests(frame).collect()
    want = [(i, *digest_of(brute.WORD.findall(t or ""))) for i, t in rows]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 6 and max(w[1] for w in want) > 5
    assert periodic_runs.run_digests(no_docs).count() == 0


def test_planted_words(spark, edge_rows):
    rows = [(k, t) for k, (_, t) in enumerate(run_rows(edge_rows) * 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want, changed = [], 0
    for i, text in rows:
        words = brute.WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)], changed + 1
        want.append((i, *digest_of(words)))
    assert changed > 5
    assert sorted(map(tuple, periodic_runs.run_digests(frame, queries.planted_words).collect())) == want


def test_collapse_documents(spark):
    rows = [(1, "a  b\ta b a b a b a b a b a b end", 5), (1, " kept  as\nit is ", 6), (None, None, 7), (2, "z " * 40, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = {r.length: r.text for r in periodic_runs.collapse_documents(docs).collect()}
    assert out == {5: "a b end", 6: " kept  as\nit is ", 7: None, 8: "z"}


def audit_rows(edge_rows):
    rng = random.Random(8)
    words = [prose(k, 1) for k in range(60)] + ["é", "Ünder", "日本", "w" * 60]
    made = [(1, " ".join(rng.choice(words) + rng.choice([" ", ".", "3", "\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None])) for _ in range(120)]
    lonely = [(2, "only here", "xx", "a"), (3, "and there", "xx", "b"), (4, None, "yy", "z"), (5, "... 123", "en", "wordless")]
    return [*[r[:4] for r in edge_rows if r[0] != 16], *made, *lonely, *made[:5]]


@pytest.mark.parametrize(("most", "longest"), [(100_000, 40), (7, 40), (100_000, 3), (0, 0)])
def test_source_divergence(spark, edge_rows, no_docs, most, longest):
    rows = audit_rows(edge_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'t' as term", "1 as n", "2 as p", "3 as rank", "'i' as item")
    got = sorted(map(tuple, source_divergence.audit(docs, most=most, longest=longest).collect()))
    want = brute.divergence([r[1:] for r in rows])
    assert got == want and {"pair", "term"} == {r[2] for r in want}
    if not most:
        assert source_divergence.audit(no_docs).count() == 0


def test_source_divergence_by_exchange(spark, edge_rows, without_broadcast):
    rows = audit_rows(edge_rows)
    docs = spark.createDataFrame([r[1:] for r in rows], "text string, lang string, source string")
    assert sorted(map(tuple, source_divergence.audit(docs, ranks=5).collect())) == brute.divergence([r[1:] for r in rows], 5)


def test_counts_are_held_and_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "HELD", 6)
    held, rng, want, got = source_divergence.Counts(), random.Random(1), {}, {}
    for _ in range(40):
        group = np.array([held.group(rng.choice("xy"), "s") for _ in range(3)], np.int64)
        names, numbers = [rng.choice("abc") for _ in group], np.array([rng.randrange(3) for _ in group], np.int64)
        held.add_names(group, pa.array(names))
        held.add_numbers((group << 32) + numbers)
        for g, name, k in zip(group.tolist(), names, numbers.tolist(), strict=True):
            lang = list(held.groups)[g][0]
            for key in ((lang, -1, name), (lang, k, "")):
                want[key] = want.get(key, 0) + 1
        batches = list(held.hand_on()) if held.full() else []
        for r in [x for b in [*batches, *(held.hand_on() if _ == 39 else ())] for x in b.to_pylist()]:
            key = (r["lang"], r["id"], r["term"])
            got[key] = got.get(key, 0) + r["n"]
    assert got == want


def test_words_that_the_automaton_passes_over():
    text = b" a bb  ccc d "
    assert source_divergence._passed_over(text, np.array([2, 12])) == [b"bb", b"ccc"] and source_divergence._passed_over(text, np.array([2, 5, 10, 12])) == []
    owner, words = source_divergence._words([b" a  b ", b"", b"   ", b"c"])
    assert owner.tolist() == [0, 0, 3] and words.to_pylist() == ["a", "b", "c"]


def test_pairs_are_summed_in_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "PAIRS", 2)
    entry = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64())]))
    lists = [[{"source": s, "p": 10 * k + j + 1, "p0": 2} for j, s in enumerate("abcd")] for k in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(lists, entry)], ["lang", "entries"])
    got = {tuple(r.values())[:3]: r["value"] for b in source_divergence._pairs_of_terms([batch]) for r in b.to_pylist()}
    f = lambda p, q: (p - q) ** 2 // q
    for lang, ks in (("en", (0, 2)), ("de", (1,))):
        for i, a in enumerate("abcd"):
            for j, b in enumerate("abcd"):
                if a != b:
                    assert got[lang, a, b] == sum(f(10 * k + i + 1, 10 * k + j + 1) - f(10 * k + i + 1, 2) - f(2, 10 * k + j + 1) for k in ks)
