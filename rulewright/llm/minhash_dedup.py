"""Near-duplicate texts by SuperMinHash signatures, banding, verification and union-find.

A text is the set of its distinct shingles of ``width`` words.  SuperMinHash gives
every element one random rank in each of the signature's places by walking a random
permutation of them; place k of step j gets the value j + uniform, so once every
place holds a value below j + 1, later steps can change nothing and the walk
stops early.  Places are correlated without replacement, which lowers the
variance of the estimate below that of independent permutations.

1. One narrow pass: set size, digest of the set, band keys, one byte per place.
   Texts with equal sets form a class; only its smallest id goes on.
2. Bands: representatives that share a band key share a bucket.  Every member of
   a bucket joins the group named by the smallest id of the bucket, so any two
   candidates meet in some group, and no pair is written out.
3. Groups are compared as tiles of blocks on the signature bytes.  A block holds
   members of one size class; classes that lie further apart than a link allows
   are no tile.  Pairs whose estimate could belong to a link (``LOOSE``, over five
   standard deviations below the threshold) join *loose* components; each tile
   returns only its local roots.
4. Each loose component is verified on full sets, first against its smallest
   member: every set is read once, and who is linked to that member needs no
   comparison with others that are.  A family around one text ends here.
5. Those who are left are compared with all members whose size class allows it, as tiles again.
   Union-find skips rows that are linked already; a tile returns its local roots.
6. The roots are joined by distributed connected components.

With 40 bands of 5 a pair at the threshold is missed with probability
(1 - 0.8**5)**40 = 1.3e-7.

Special cases: a text with fewer words than a shingle is one shingle; without
words, or null, the set is empty and links with nothing; so does a row with a
null id, whose component is null.  Rows that repeat an id are versions of one
document, which is linked by any of its texts; each row stands in the result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary_column, lower_words, map_arrow, own_id, mix64, prepare, stored, window_hashes
from .components import UnionFind, components, link_matrix_forest

SHINGLE_WORDS = 5
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 80
BANDS, ROWS = 40, 5
PLACES = BANDS * ROWS
#: Least share of equal places of a pair that is looked at in full.
LOOSE = 0.64
#: Members of a block, and elements of their sets; a tile compares two blocks.
BLOCK, BLOCK_ELEMENTS = 512, 1 << 18
#: Sizes of one class differ by less than a link allows, so links stay inside a class or join neighbouring ones.
_CLASS = math.log(100 / PERCENT * (1 + 1e-6))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, hashes: WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = lower_words(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(window_hashes(h, min(width, len(h))))


def super_min_hash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (len(sets) x places) as uint64: step in the top byte, then random bits.

    All sets walk together, one step of the permutation at a time; a set leaves
    when the largest value over its places is below the next step.
    """
    m = places
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    todo = np.flatnonzero(sizes)
    if not len(todo):
        return sig
    owner = np.repeat(todo, sizes[todo])
    seed = mix64(np.concatenate([sets[k] for k in todo]))
    perm: np.ndarray | None = None  # of each element, made once a second step is needed
    flat = sig.ravel()
    for step in range(m):
        draw = mix64(seed + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = step + (mix64(draw + _GOLD) >> np.uint64(33)).astype(np.int64) % (m - step)
        if perm is None:
            place = swap
        else:
            row = np.arange(len(owner))
            place = perm[row, swap].astype(np.int64)
            perm[row, swap] = perm[:, step]
            perm[:, step] = place
        value = (np.uint64(step) << np.uint64(55)) | (draw >> np.uint64(9))
        np.minimum.at(flat, owner * m + place, value)
        if step == m - 1:
            break
        top = sig.max(axis=1)
        open_set = top > (np.uint64(step + 1) << np.uint64(55))
        stay = open_set[owner]
        if not stay.any():
            break
        if perm is None:
            kept = place[stay]
            perm = np.tile(np.arange(m, dtype=np.uint8), (int(stay.sum()), 1))
            row = np.arange(len(kept))
            perm[row, kept] = 0
            perm[:, 0] = kept
        elif not stay.all():
            perm = perm[stay]
        owner, seed = owner[stay], seed[stay]
    return sig


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands array<long>, bytes binary) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def each(batch: pa.RecordBatch, hashes: WordHashes) -> dict:
        ids, texts = batch.column(0), binary_column(batch, "text")
        sets = [shingles(t, hashes, width) for t in texts]
        bands, bytes_of = [], []
        for k in range(0, len(sets), 64):  # bounds the permutations that are held at once
            sig = super_min_hash(sets[k : k + 64])
            keys = mix64(sig.reshape(len(sig), BANDS, ROWS))
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _GOLD, keys.shape[:2]).copy()
            for r in range(ROWS):
                key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + keys[:, :, r])
            bands += [b if len(s) else [] for b, s in zip(key.view(np.int64), sets[k : k + 64], strict=True)]
            bytes_of += [x.tobytes() for x in (mix64(sig) >> np.uint64(56)).astype(np.uint8)]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return {"doc_id": ids, "n_shingles": [len(s) for s in sets], "digest": digests, "bands": bands, "sig": bytes_of}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, schema, "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary", WordHashes)


def deal_tiles(members: DataFrame, group: str, weight: Column, most: int) -> DataFrame:
    """Add (own, left, right): the tiles of blocks in which each member takes part.

    A block is a hashed part, of weight about ``most``, of the members of one group,
    size class and ``kind``.  Blocks of kind 0 are no tile with each other.
    """
    keys = [group, "cls", "kind"]
    members = members.withColumn("cls", F.floor(F.log("n_shingles") / _CLASS).cast("int"))
    sizes = stored(members.groupBy(*keys).agg(F.ceil(F.sum(weight) / most).cast("int").alias("_blocks")), "sizes")
    name = F.concat_ws(":", "cls", "kind", "_part").alias("own")
    blocks = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(group, "cls", "kind", F.struct("cls", "kind", "_part").alias("order"), name)
    right = blocks.select(F.col(group).alias("_group"), F.col("cls").alias("_cls"), F.col("kind").alias("_kind"), F.col("order").alias("_order"), F.col("own").alias("right"))
    left = blocks.withColumn("_meet", F.explode(F.array(F.col("cls"), F.col("cls") + 1)))
    tiles = left.join(right, (F.col(group) == F.col("_group")) & (F.col("_meet") == F.col("_cls"))).where("order <= _order and (kind = 1 or _kind = 1)").select(group, F.col("own").alias("left"), "right")
    tiles = stored(tiles, "tiles")
    parts = tiles.select(group, F.col("left").alias("own"), "left", "right").unionByName(tiles.where("left <> right").select(group, F.col("right").alias("own"), "left", "right"))
    dealt = members.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int")).withColumn("own", name).drop("_blocks", "_part", "cls")
    return dealt.join(stored(parts, "parts"), [group, "own"]).repartition(group, "left", "right")  # else all tiles of a group would stay in the join's partition


def _stack(table: pa.Table, payload: str) -> tuple[pa.Table, np.ndarray, list, int]:
    """A tile's rows, left block first, their ids and payloads, and where the right block starts (on the diagonal, the end)."""
    ids = table.column("doc_id").to_numpy()
    behind = np.array(table.column("own").to_pylist()) != table.column("left")[0].as_py()
    order = np.lexsort((ids, behind))
    table = table.take(pa.array(order))
    return table, ids[order], table.column(payload).to_pylist(), int((~behind).sum())


def _roots(ids: np.ndarray, uf: UnionFind, rank: np.ndarray) -> pa.Table:
    """(doc_id, root) of the members that are linked to a smaller one or are such a root."""
    root = np.sort(ids)[uf.roots()[rank]]
    apart = root != ids
    return pa.table({"a": ids[apart], "b": root[apart]})


def _ranks(ids: np.ndarray) -> np.ndarray:
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids)] = np.arange(len(ids))
    return rank


def loose_tile(table: pa.Table) -> pa.Table:
    """Local roots by the estimate from signature bytes."""
    table, ids, payload, cut = _stack(table, "sig")
    sig = np.frombuffer(b"".join(payload), np.uint8).reshape(len(ids), -1)
    sizes = table.column("n_shingles").to_numpy()
    need = LOOSE * sig.shape[1]
    uf, rank = UnionFind(len(ids)), _ranks(ids)
    rows, cols = [], []
    for i in range(cut):
        first = i + 1 if cut == len(ids) else cut
        like = sizes[first:]
        fit = np.flatnonzero((like * 100 >= sizes[i] * PERCENT) & (sizes[i] * 100 >= like * PERCENT)) + first
        if len(fit):
            fit = fit[np.count_nonzero(sig[fit] == sig[i], axis=1) >= need]
            rows.append(np.full(len(fit), i))
            cols.append(fit)
    if rows:
        link_matrix_forest(uf, rank[np.concatenate(rows)], rank[np.concatenate(cols)])
    return _roots(ids, uf, rank)


def _alike(shared: np.ndarray, a, b) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with so many shared elements are linked."""
    return shared * 100 >= PERCENT * (a + b - shared)


def against_smallest(table: pa.Table) -> pa.Table:
    """A part of a component beside its smallest member: kind 0 for those that are linked to it, 1 for others."""
    ids, root = table.column("doc_id").to_numpy(), table.column("component")[0].as_py()
    own = np.flatnonzero(ids == root)  # several, where rows repeat the id with other texts
    sets = [np.frombuffer(p, np.uint64) for p in table.column("elements").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    every, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    linked = ids == root
    for k in own:
        place = np.minimum(np.searchsorted(sets[k], every), sizes[k] - 1)
        linked |= _alike(np.add.reduceat((sets[k][place] == every).astype(np.int64), starts), sizes[k], sizes)
    keep = np.ones(len(ids), bool)
    keep[own] = table.column("first").to_numpy(zero_copy_only=False)[own]  # of its copies, the one in the first part
    table = table.append_column("kind", pa.array(np.where(linked, 0, 1).astype(np.int32)))
    return table.filter(pa.array(keep)).select(["doc_id", "component", "n_shingles", "elements", "kind"])


def exact_tile(table: pa.Table) -> pa.Table:
    """Local roots by the exact similarity of full sets; members of kind 0 are linked by then."""
    table, ids, payload, cut = _stack(table, "elements")
    sets = [np.frombuffer(p, np.uint64) for p in payload]
    sizes = np.array([len(s) for s in sets])
    uf, rank = UnionFind(len(ids)), _ranks(ids)
    done = rank[table.column("kind").to_numpy() == 0]
    if len(done):
        link_matrix_forest(uf, np.full(len(done), done.min()), done)
    vocabulary, local = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marks = np.zeros(len(vocabulary), np.uint8)
    for i in range(cut):
        first = i + 1 if cut == len(ids) else cut
        root = uf.roots()[rank]
        like = sizes[first:]
        open_to = np.flatnonzero((root[first:] != root[i]) & (like * 100 >= sizes[i] * PERCENT) & (sizes[i] * 100 >= like * PERCENT)) + first
        if not len(open_to):
            continue
        marks[local[starts[i] : ends[i]]] = 1
        if len(open_to) * 4 > len(ids) - first:
            shared = np.add.reduceat(marks[local[starts[first] :]], starts[first:] - starts[first], dtype=np.int64)[open_to - first]
        else:
            shared = np.array([int(marks[local[starts[k] : ends[k]]].sum(dtype=np.int64)) for k in open_to])
        marks[local[starts[i] : ends[i]]] = 0
        hit = open_to[_alike(shared, sizes[i], sizes[open_to])]
        if len(hit):
            link_matrix_forest(uf, np.full(len(hit), rank[i]), rank[hit])
    return _roots(ids, uf, rank)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    prepare(docs.sparkSession)
    signed = stored(_signatures(docs, width), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    # aggregates are stored before they are joined: both sides are then plain exchanges, which Spark splits at a hot key
    digests = stored(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digests")
    member = stored(known.select("doc_id", "digest").join(digests, "digest").select("doc_id", "rep"), "members")
    classes = stored(member.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")), "classes")
    # a document of several texts joins their classes
    versions = member.join(classes.where("rep < last").select("doc_id", F.col("rep").alias("b")), "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    reps = known.join(digests, "digest").where("doc_id = rep").dropDuplicates(["digest"])
    reps = stored(reps.select("doc_id", "n_shingles", "bands", "sig"), "representatives")

    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").drop("last")
    buckets = stored(buckets, "buckets")
    members = banded.join(buckets, "key").select("leader", "doc_id").distinct()
    members = members.join(reps.select("doc_id", "n_shingles", "sig"), "doc_id").withColumn("kind", F.lit(1))
    tiles = deal_tiles(stored(members, "groups"), "leader", F.lit(1), BLOCK)
    loose = tiles.groupBy("leader", "left", "right").applyInArrow(loose_tile, "a long, b long").distinct()
    loose = stored(components(loose), "loose")

    links = _verified(docs, loose, width).unionByName(versions)
    groups = components(links)
    rep_of = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(rep_of, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _verified(docs: DataFrame, loose: DataFrame, width: int) -> DataFrame:
    """(a, b): links on full sets that join what is linked within the loose components (node, component)."""

    def elements(batch: pa.RecordBatch, hashes: WordHashes) -> dict:
        sets = [shingles(t, hashes, width) for t in binary_column(batch, "text")]
        return {"doc_id": batch.column(0), "component": batch.column(1), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "elements": [s.tobytes() for s in sets]}

    schema = pa.schema([("doc_id", pa.int64()), ("component", pa.int64()), ("n_shingles", pa.int64()), ("elements", pa.binary())])
    ddl = "doc_id long, component long, n_shingles long, elements binary"
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(loose.select(F.col("node").alias("doc_id"), "component").hint("shuffle_hash"), "doc_id").select("doc_id", "component", "text")
    full = stored(map_arrow(texts, elements, schema, ddl, WordHashes).where("n_shingles > 0"), "sets")
    weight = F.col("n_shingles") + BLOCK_ELEMENTS // BLOCK

    # the smallest member goes to every part of its component
    parts = stored(full.groupBy("component").agg(F.ceil(F.sum(weight) / BLOCK_ELEMENTS).cast("int").alias("_parts")), "parts")
    all_parts = F.sequence(F.lit(0), F.col("_parts") - 1)
    dealt = full.join(parts, "component").withColumn("part", F.explode(F.when(F.col("doc_id") == F.col("component"), all_parts).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int")))))
    dealt = dealt.withColumn("first", F.col("part") == 0).drop("_parts").repartition("component", "part")
    judged = stored(dealt.groupBy("component", "part").applyInArrow(against_smallest, f"{ddl}, kind int"), "judged")
    near = judged.where("kind = 0 and doc_id <> component").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))

    open_still = stored(judged.where("kind = 1").select("component").distinct(), "open")
    tiles = deal_tiles(judged.join(open_still, "component", "left_semi"), "component", weight, BLOCK_ELEMENTS)
    return near.unionByName(tiles.groupBy("component", "left", "right").applyInArrow(exact_tile, "a long, b long"))


def keep_documents(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component, all columns as they were.

    A row stands for its text.  Rows without an id, and those of an id that several texts have, are told apart
    by their texts: each text goes or stays on its own, a row with an id of its own before one
    without, and of rows that repeat id and text one stays.
    """
    docs_id = docs["doc_id"].cast("long")
    kind = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = docs.groupBy(docs_id.alias("_rw_shared")).agg(F.count("*").alias("n"), (F.min(kind) < F.max(kind)).alias("several")).where("n > 1 or _rw_shared is null")
    shared = stored(shared.select("_rw_shared", F.expr("several or _rw_shared is null").alias("_rw_several")), "shared-ids")
    if shared.isEmpty():
        gone = near_duplicates(docs, width).where("not kept").select("doc_id").distinct()
        return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
    flagged = docs.join(shared.withColumn("_rw_flag", F.lit(True)), docs_id.eqNullSafe(F.col("_rw_shared")), "left")
    flagged = flagged.withColumn("_rw_id", F.when(F.col("_rw_several"), own_id("_rw_shared", "text")).otherwise(docs_id))
    gone = near_duplicates(flagged.select(F.col("_rw_id").alias("doc_id"), "text"), width).where("not kept").select(F.col("doc_id").alias("_rw_id")).distinct()
    left = flagged.join(gone.hint("shuffle_hash"), "_rw_id", "left_anti")
    return left.where("_rw_flag is null").unionByName(left.where("_rw_flag").dropDuplicates(["_rw_id"])).select(*docs.columns)
