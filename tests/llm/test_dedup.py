import brute
import numpy as np
import pytest
from brute import prose

from rulewright.llm import embedding_dedup, minhash_dedup, substring_dedup
from rulewright.llm.common import WordHashes
from rulewright.llm.components import components


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(500, 540)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = brute.roots({x for link in links for x in link}, links)
    assert got == {k: v for k, v in want.items() if any(k in link and link[0] != link[1] for link in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_embeddings(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    rows = [(k, [float(x) for x in centres[k % 6] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])], int(k % 2)) for k in range(150)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, rows[0][1], 0), (207, [], 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([*rows, rows[3]], "vec_id long, embedding array<double>, label int")
    frame = frame.withColumns({c: F.lit(-1) for c in ("dim", "vector", "cell", "block", "left", "right", "root", "n_links", "component", "c0", "lo0")})  # names that are used inside
    out = embedding_dedup.near_duplicates(frame, block_rows=block).collect()
    assert len(out) == len(rows) + 1
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute.embeddings(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_boxes_leave_out_far_blocks_and_no_link(spark, monkeypatch):
    """Clusters on a sphere: most tiles go, every link stays; axes from the sample, and unit axes without one."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in c + rng.normal(size=12) * 0.1], 0) for k, c in enumerate(np.repeat(rng.normal(size=(12, 12)), 40, axis=0))]
    rows += [(1000 + k, [float(x) for x in rng.normal(size=300)], 0) for k in range(70)]
    want = brute.embeddings(rows)
    for least in (64, 10_000):
        listed = []

        def tiles(blocks, reach):
            found = plain(blocks, reach)
            listed.append((blocks.count(), found.count()))
            return found

        plain = embedding_dedup._tiles
        monkeypatch.setattr(embedding_dedup, "_tiles", tiles)
        fit = embedding_dedup.principal_axes
        monkeypatch.setattr(embedding_dedup, "principal_axes", lambda v, kind, least=least, fit=fit: fit(v, kind, least=least))
        out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block_rows=16).collect()
        monkeypatch.undo()
        assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want
        n, kept = listed[0]
        assert n > 30 and (kept < n * (n + 1) / 4 or least > 64)


def test_strips_find_what_whole_products_find():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 40)) * np.linspace(3, 0.1, 40)
    x[350:] = x[:350] + rng.normal(size=(350, 40)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.svd(x, full_matrices=False)[2].T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T, 1) >= 0.93), strict=True)}
    for k in (3, 17, 40):
        i, j = embedding_dedup.tile_links(x, None, axes[:, :k], 0.93)
        assert set(zip(i, j, strict=True)) == want
        i, j = embedding_dedup.tile_links(x[:300], x[300:], axes[:, :k], 0.93)
        assert set(zip(i, j, strict=True)) == {(a, b) for a, b in want if a < 300 <= b}


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def near_family(seed, n, change):
    """Copies of one text in which some words differ."""
    rng = np.random.default_rng(seed)
    base = prose(seed, 90).split()
    out = []
    for _ in range(n):
        words = list(base)
        for k in rng.integers(0, 90, int(rng.integers(0, change))):
            words[k] = f"w{rng.integers(1000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("block", "elements", "width"), [(8, 600, 4), (512, 1 << 18, 4), (512, 1 << 18, 5)])
def test_near_duplicates(spark, edge_docs, edge_rows, block, elements, width, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ELEMENTS", elements)
    more = [(100 + k, t) for k, t in enumerate(near_family(1, 60, 9) + near_family(2, 40, 4) + [prose(9, k) for k in range(1, 8)] * 2)]
    frame = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = minhash_dedup.near_duplicates(frame, width).collect()
    want = brute.near([(r[0], r[1]) for r in edge_rows] + more, width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
    assert len(out) == len(edge_rows) + len(more)
    assert all(r.kept for r in out if r.doc_id is None)


def test_versions_of_one_document_join_their_classes(spark):
    """A document is linked by any of its texts; 9 and 2 share one, 9 and 5 the other."""
    rows = [(9, prose(1, 40)), (9, prose(2, 40)), (2, prose(1, 40)), (5, prose(2, 40) + " x"), (7, prose(3, 40)), (4, ""), (4, prose(3, 40))]
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.component_id) for r in out} == {(9, 2), (2, 2), (5, 2), (7, 4), (4, 4)}


def test_a_family_around_one_text_is_verified_without_tiles(spark, monkeypatch):
    """Full sets are copied for tiles only where the smallest member leaves someone unlinked."""
    base = prose(77, 200).split()
    rows = [(k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]])) for k in range(150)]
    rows += [(500 + k, " ".join([*prose(78, 200).split()[: 200 - 12 * k], *prose(79 + k, 12 * k).split()])) for k in range(6)]  # a chain
    seen = []
    tile = minhash_dedup.deal_tiles

    def deal(members, group, weight, most):
        out = tile(members, group, weight, most)
        seen.append((group, members.count(), out.count()))
        return out

    monkeypatch.setattr(minhash_dedup, "deal_tiles", deal)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ELEMENTS", 4096)
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near(rows)
    assert [g for g, *_ in seen] == ["leader", "component"] and seen[1][1] <= 6


def test_sizes_of_links_lie_in_neighbouring_classes():
    for a in range(1, 4000):
        b = a * 100 // 80  # the largest set that a set of this size can be linked to
        assert int(np.log(b) / minhash_dedup._CLASS) - int(np.log(a) / minhash_dedup._CLASS) <= 1


def test_near_duplicates_keep_one_of_each(spark, edge_docs, no_docs):
    kept = minhash_dedup.keep_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {5, None} <= {r.doc_id for r in kept.collect()} and not {6, 7} & {r.doc_id for r in kept.collect()}
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_super_min_hash_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        for size in (5, 60, 2000):
            both = rng.integers(0, 1 << 62, int(size * share) + 1).astype(np.uint64)
            own = [rng.integers(0, 1 << 62, max(1, int(size * (1 - share) / 2))).astype(np.uint64) for _ in range(2)]
            sets = [np.unique(np.concatenate([both, o])) for o in own]
            true = len(both) / (len(both) + sum(map(len, own)))
            sig = minhash_dedup.super_min_hash(sets)
            assert abs((sig[0] == sig[1]).mean() - true) < 0.16
            assert (sig == np.vstack([minhash_dedup.super_min_hash([s]) for s in sets])).all()  # sets do not disturb each other


@pytest.mark.parametrize(("window", "anchor"), [(50, 25), (6, 3)])
def test_substrings(spark, edge_docs, edge_rows, window, anchor):
    passage = prose(50, 80)
    more = [(200 + k, f"{prose(60 + k, k)} {passage} {prose(90 + k, 3)} {' '.join(passage.split()[k : k + 55])}") for k in range(20)]
    frame = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = substring_dedup.parse_documents(frame, window, anchor).collect()
    want = brute.substrings([(r[0], r[1]) for r in edge_rows if r[0] is not None] + more, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out if r.doc_id is not None} == want
    assert len(out) == len(edge_rows) + len(more)
    for r in out:
        assert all(s.end - s.start >= window and s.source < r.doc_id for s in r.spans)


def test_factors_are_the_longest_substrings_of_their_sources(spark):
    window, rng = 6, np.random.default_rng(8)
    stock = [prose(300 + k, 24).split() for k in range(5)]
    rows = []
    for i in range(24):
        words = prose(400 + i, int(rng.integers(0, 12))).split()
        for _ in range(int(rng.integers(0, 5))):
            part = stock[rng.integers(5)]
            a = int(rng.integers(0, 14))
            words += part[a : a + int(rng.integers(3, 20))] + prose(int(rng.integers(1 << 30)), int(rng.integers(0, 3))).split()
        rows.append((i, " ".join(words)))
    rows += [(30, rows[3][1]), (31, rows[4][1] + " " + rows[5][1]), (-7, "x y z " * 12), (32, "x y z " * 20)]
    texts = {i: t.split() for i, t in rows}
    out = substring_dedup.parse_documents(spark.createDataFrame(rows, "doc_id long, text string"), window, 3).collect()
    got = {r.doc_id: [(s.start, s.end, s.source, s["at"]) for s in r.spans] for r in out}
    assert sum(map(len, got.values())) > 30
    for i, spans in got.items():
        assert all(texts[i][a:b] == texts[j][at : at + b - a] for a, b, j, at in spans)
    assert got == brute.parse(rows, window)


def test_versions_of_one_document_are_judged_on_their_own_texts(spark):
    passage = prose(21, 60)
    rows = [(1, prose(22, 5) + " " + passage), (2, passage + " " + prose(23, 9)), (2, prose(24, 70)), (2, prose(24, 70)), (3, prose(24, 70) + " " + passage), (None, passage)]
    out = substring_dedup.parse_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(0, 60, 0), (1, 65, 0), (2, 69, 60), (2, 70, 0), (2, 70, 0), (3, 130, 130)]
    assert [(s.source, s["at"]) for r in out if r.doc_id == 3 for s in r.spans] == [(2, 0), (1, 5)]


def test_substring_removal_keeps_other_texts_as_they_are(spark, edge_docs, no_docs):
    before = {r.doc_id: r.text for r in edge_docs.collect()}
    after = substring_dedup.remove_duplicates(edge_docs)
    assert after.columns == edge_docs.columns
    texts = {r.doc_id: r.text for r in after.collect()}
    assert texts[5] == before[5] and texts[6] == "" and texts[0] is None and texts[14] == before[14]
    assert substring_dedup.parse_documents(no_docs).count() == 0


def test_each_window_has_one_block():
    rng = np.random.default_rng(5)
    h = WordHashes().of([b"w%d" % k for k in rng.integers(0, 40, 700)])
    _, at, first, n = substring_dedup.blocks(h)
    assert (first <= at).all() and (at + 25 <= first + 50).all()
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == 700 - 49
