import hashlib

import brute
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rulewright.llm import bpe_codec, packing, token_counts

ODD = st.text(alphabet=" \n\tab'é中ﬁ😀<|endoftext|>1▁", max_size=60)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_chunks_and_whole_text_have_the_same_ids(text):
    codec = bpe_codec.codec("byte_bpe_50k.tiktoken")
    whole = codec.encoding.encode_ordinary(text)
    assert codec.encode(text, chunk=8, overlap=4) == whole
    assert codec.decode(whole) == text.encode()
    assert "".join(bpe_codec.pieces(text, codec.splitter, 8, 4)) == text


@settings(max_examples=200, deadline=None)
@given(ODD, st.sampled_from([(4, 4), (5, 3), (16, 8)]))
def test_chunks_are_split_as_if_alone_and_met_at_true_boundaries(text, size):
    codec = bpe_codec.codec("byte_bpe_50k.tiktoken")
    true = set(codec.splitter.starts(text))
    at = 0
    for piece in bpe_codec.pieces(text, codec.splitter, *size)[:-1]:
        at += len(piece)
        assert at in true


def test_texts_without_plain_spaces_are_chunked():
    split = bpe_codec.codec("byte_bpe_50k.tiktoken").splitter
    for text in ("中文，" * 70_000, "abc\n" * 50_000, "x\t1" * 70_000):
        assert len(bpe_codec.pieces(text, split)) == len(bpe_codec.chunks_of(text, bpe_codec.CHUNK_CHARS, bpe_codec.OVERLAP_CHARS)) > 5
    assert len(bpe_codec.pieces("a" * 200_000, split)) == 1  # one pre-token
    run = "b" * 100_000
    assert [len(x) for x in bpe_codec.pieces(run + " c" * 40_000, split)][0] > len(run)


def test_the_splitter_sees_characters_as_the_encoder_does():
    codec = bpe_codec.codec("byte_bpe_50k.tiktoken")
    odd = list(map(chr, codec.splitter.stand_ins))[::97]
    for c in [*odd, "é", "中", "²", "\u2028", "\x1c"]:
        text = f"a{c}b{c}{c} {c}1{c}"
        starts = codec.splitter.starts(text)
        parts = [text[i:j] for i, j in zip(starts, [*starts[1:], None])]
        assert [t for p in parts for t in codec.encoding.encode_ordinary(p)] == codec.encoding.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_every_prefix_has_the_library_count(text):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counter = token_counts.counter("piece_bpe_32k.model")
    table = counter.table(text).tolist()
    assert table == [len(model.encode(text[:k])) for k in range(len(text) + 1)]
    steps = counter.text_steps(text)
    assert len(steps) == len(text)
    for budget in (0, 1, 5):
        assert token_counts.longest_fit(steps, budget) == max(k for k, n in enumerate(table) if n <= budget)


def test_token_counts(spark, edge_docs, edge_rows, model):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.document_counts(edge_docs).collect()}
    want = {(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in edge_rows}
    assert got == want


def test_look_ups_call_no_encoder(spark, edge_docs, edge_rows, model, tmp_path, monkeypatch):
    """Limits, totals and the longest prefixes come from the stored table, with the model out of reach."""
    token_counts.prefix_table(edge_docs).write.parquet(str(tmp_path / "prefixes"))

    def no_encoder(*_):
        raise AssertionError("encoded on look-up")

    for name in ("counter", "PrefixCounter", "text_column"):
        monkeypatch.setattr(token_counts, name, no_encoder)
    table = spark.read.parquet(str(tmp_path / "prefixes"))
    assert "text" not in table.columns
    for limit in (0, 3, 40, 4096):
        for r in token_counts.look_up(table, limit).collect():
            texts = [t or "" for i, t, *_ in edge_rows if i == r.doc_id]
            assert r.n_tokens in [len(model.encode(t)) for t in texts] and r.over_limit == (r.n_tokens > limit)
            text = next(t for t in texts if len(model.encode(t)) == r.n_tokens)
            assert len(model.encode(text[: r.fit_chars])) <= limit or not r.over_limit
            assert not r.over_limit or len(model.encode(text[: r.fit_chars + 1])) > limit


def test_truncation_needs_no_encoding(spark, edge_docs, model):
    short = edge_docs.where("doc_id < 16").dropDuplicates(["doc_id"])
    cut = token_counts.truncate(short, token_counts.prefix_counts(short), 30)
    assert cut.columns == short.columns
    assert all(len(model.encode(r.text or "")) <= 30 for r in cut.collect())


def test_round_trip(spark, edge_docs, edge_rows):
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.codec("byte_bpe_50k.tiktoken").encoding._mergeable_ranks, special_tokens={})
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.round_trip(edge_docs).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t, *_ in edge_rows:
        ids = plain.encode_ordinary(t or "")
        want.add((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == want
    small = bpe_codec.round_trip(edge_docs, chunk=64, overlap=16).collect()  # most texts are many chunks
    assert {tuple(r) for r in small} == want and len(small) == len(edge_rows)
    ids = bpe_codec.encode(edge_docs)
    assert {bytes(r.bytes) for r in bpe_codec.decode(ids).collect()} == {(t or "").encode() for _, t, *_ in edge_rows}


def test_empty_tables(spark, no_docs):
    assert token_counts.document_counts(no_docs).count() == bpe_codec.round_trip(no_docs).count() == packing.pack_documents(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_ids_are_those_of_the_asked_library(text):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.id_source("byte_bpe_50k.json").ids(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=40))
def test_plan_uses_every_piece_once_and_fits(counts):
    fills = packing.plan_bins(counts, 64)
    used = {}
    for f in fills:
        assert sum(f.lengths) <= 64 and f.bins > 0
        for n in f.lengths:
            used[n] = used.get(n, 0) + f.bins
    assert used == counts
    assert sum(f.bins for f in fills) <= sum(-(-n * c // 32) for n, c in counts.items()) + 1  # best fit leaves no two bins half empty


def least_bins(lengths, capacity):
    """The fewest sequences for a few pieces, by dynamic programming over subsets: (sequences, tokens in the last one)."""
    best = {0: (1, 0)}
    for mask in range(1, 1 << len(lengths)):
        options = []
        for k, n in enumerate(lengths):
            if mask >> k & 1:
                bins, used = best[mask ^ 1 << k]
                options.append((bins, used + n) if used + n <= capacity else (bins + 1, n))
        best[mask] = min(options)
    return best[(1 << len(lengths)) - 1][0] if lengths else 0


def test_plans_are_close_to_the_fewest_sequences():
    import random

    rng, excess = random.Random(3), []
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        counts = {n: lengths.count(n) for n in lengths}
        excess.append(sum(f.bins for f in packing.plan_bins(counts, 20)) - least_bins(lengths, 20))
    assert min(excess) == 0 and max(excess) <= 1 and sum(excess) <= 12


def test_complements_fill_exactly():
    assert sum(f.bins for f in packing.plan_bins({60: 5, 40: 5, 55: 4, 25: 4, 20: 4, 50: 3, 30: 3, 15: 3, 5: 3}, 100)) == 12


def test_packing(spark, edge_docs, edge_rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(edge_docs).collect()
    want = []
    for i, t, *_ in edge_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        ends = [first + 2048 * k for k in range((len(ids) - first) // 2048 + 1)]
        want += [(i, k, max(0, e - (2048 if k else first)), min(2048, e), brute.crc(ids[max(0, e - (2048 if k else first)) : e])) for k, e in enumerate(ends)]
    got = [(r.doc_id, r.piece, r.start, r.start + r.length if r.piece == 0 else r.length, r.ids_crc32) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packed_ids_are_kept_on_demand(spark, edge_docs):
    rows = packing.pack_documents(edge_docs.where("doc_id < 8"), keep_ids=True).select("length", F.size("ids").alias("n")).collect()
    assert all(r.length == r.n for r in rows)
