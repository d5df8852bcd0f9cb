"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are projected on the leading principal axes of a bounded sample, so that
the first coordinates carry most of a product.  Within a label the vectors are
laid in cells along two axes, and consecutive cells form blocks.  A block keeps
its bounding box on ``BOX_AXES`` axes; two blocks form a tile only if their boxes
come as close as the threshold asks for, since a distance on some axes never
exceeds the whole one.  In a tile, products are accumulated over leading
dimensions first; what the remaining ones can still add is at most the product of
the two suffix norms, and a pair is dropped as soon as that cannot reach the
threshold.  Survivors are decided by the full cosine of the unrotated vectors in
double precision.

The projection only orders the work: any orthonormal axes give the same links.  A
tile returns, per vector, how many links it found and its local root, so no pair
ever leaves a task.  A label that holds many rows is many tiles; each vector of a
block goes to every tile of its block, so tiles are large (``BLOCK_ROWS``) and are
worked through in strips of ``STRIP`` rows.

What is broadcast are the axes: of dimensions that hold at least ``LEAST_SAMPLE``
of the ``SAMPLE_ROWS`` sampled vectors, ``AXES`` axes each; a dimension without
them takes unit axes.

Special cases: vectors that are null, empty, zero, or hold a null or non-finite
component, and vectors with a null label, link with nothing and are components
of their own, as are rows with a null id.  Vectors of different dimension are
never compared.  Equal vectors link like any others.  Rows that repeat an id
count once: of their usable vectors the one of smallest label, then bytes, stands for the id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_arrow, prepare, stored
from .components import UnionFind, components, link_matrix_forest

THRESHOLD = 0.93
#: Vectors in a block; a tile compares two blocks, so many rows of the left at a time.
BLOCK_ROWS, STRIP = 4096, 256
#: Vectors that the axes are fitted on (those of smallest hash), and how many of a dimension it takes.
SAMPLE_ROWS, LEAST_SAMPLE = 4096, 64
#: Leading axes, and those of them that bound blocks.
AXES, BOX_AXES = 256, 6
#: Leading dimensions that are added in one step.
STEP = 8
#: Cells from -1 to 1 on the first axis and on the second.
SLABS, BINS = 32, 256
#: Far above the rounding of suffix norms and single-precision boxes.
_SLACK = 1e-6


def units(buffers: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Rows of length 1 in double precision, from vectors as they are stored."""
    x = np.frombuffer(b"".join(buffers), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(vectors: DataFrame, kind: str, sample_rows: int = SAMPLE_ROWS, least: int = LEAST_SAMPLE) -> dict[int, np.ndarray]:
    """dimension -> its leading orthonormal axes as columns, from a bounded sample."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("dim", "vector").collect()
    of_dim: dict[int, list[bytes]] = {}
    for r in sample:
        of_dim.setdefault(r["dim"], []).append(r["vector"])
    axes = {}
    for dim, rows in of_dim.items():
        if len(rows) >= least:
            _, _, basis = np.linalg.svd(units(rows, dim, kind), full_matrices=False)
            axes[dim] = np.ascontiguousarray(basis[:AXES].T)
    return axes


def axes_of(axes: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return axes[dim] if dim in axes else np.eye(dim, min(dim, AXES))


def _usable(embeddings: DataFrame, kind: str) -> DataFrame:
    """(vec_id, label, dim, vector binary): vectors that can link, in their own precision."""

    def each(batch: pa.RecordBatch) -> dict:
        ids, labels, dims, vectors = [], [], [], []
        for vec_id, label, vector in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.array(vector, kind) if vector else np.empty(0)  # a null component becomes not-a-number
            if label is not None and len(x) and np.isfinite(x).all() and x.any():
                ids.append(vec_id)
                labels.append(label)
                dims.append(len(x))
                vectors.append(x.tobytes())
        return {"vec_id": ids, "label": labels, "dim": dims, "vector": vectors}

    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("vector", pa.binary())])
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").where("vec_id is not null")
    found = map_arrow(rows, each, schema, "vec_id long, label string, dim int, vector binary")
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vector")).alias("v")).select("vec_id", "v.*")


def tile_links(left: np.ndarray, right: np.ndarray | None, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into the stacked rows) of one tile that reach the threshold.

    ``right`` is None on the diagonal, where each pair is taken once.
    """
    other = left if right is None else right
    b = other @ axes
    rest_b = _suffix_norms(b)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(left), STRIP):
        strip = left[at : at + STRIP]
        i, j = _strip_links(strip @ axes, b, rest_b, threshold - _SLACK, at + 1 if right is None else None)
        for k in range(0, len(i), 65536):
            hit = np.einsum("ij,ij->i", strip[i[k : k + 65536]], other[j[k : k + 65536]]) >= threshold
            found.append((at + i[k : k + 65536][hit], j[k : k + 65536][hit]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j + (0 if right is None else len(left))


def _suffix_norms(a: np.ndarray) -> np.ndarray:
    """Column k: what rows of length 1 still hold behind their first k coordinates."""
    held = np.cumsum(a * a, axis=1)
    return np.sqrt(np.maximum(1 - np.hstack([np.zeros((len(a), 1)), held]), 0))


def _strip_links(a: np.ndarray, b: np.ndarray, rest_b: np.ndarray, need: float, above: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose leading products and suffix norms let them reach ``need``; on the diagonal only j >= i + above."""
    rest_a, width = _suffix_norms(a), a.shape[1]
    partial, i, j = np.zeros((len(a), len(b))), None, None
    for at in range(0, width, STEP):
        end = min(width, at + STEP)
        if i is None:
            partial += a[:, at:end] @ b[:, at:end].T
            alive = partial + rest_a[:, end, None] * rest_b[None, :, end] >= need
            if above is not None:
                alive = np.triu(alive, above)
            if end == width or alive.sum() * 16 < alive.size:
                i, j = np.nonzero(alive)
                sums = partial[i, j]
        else:
            sums = sums + np.einsum("ij,ij->i", a[i, at:end], b[j, at:end])
            keep = sums + rest_a[i, end] * rest_b[j, end] >= need
            i, j, sums = i[keep], j[keep], sums[keep]
    return i, j


def _placed(usable: DataFrame, shared, kind: str) -> DataFrame:
    """Vectors with their cell and their coordinates ``c0``, ``c1``, ... on the axes of boxes."""
    names = [f"c{k}" for k in range(BOX_AXES)]

    def place(batch: pa.RecordBatch) -> dict:
        at = np.zeros((batch.num_rows, BOX_AXES))
        dims, vectors = batch.column(2).to_numpy(), batch.column(3).to_pylist()
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            lead = units([vectors[r] for r in rows], int(dim), kind) @ axes_of(shared.value, int(dim))[:, :BOX_AXES]
            at[rows, : lead.shape[1]] = lead
        first, second = (np.clip(((at[:, k] + 1) / 2 * n).astype(np.int32), 0, n - 1) for k, n in ((0, SLABS), (1, BINS)))
        return {n: batch.column(k) for k, n in enumerate(batch.schema.names)} | {"cell": first * BINS + second} | {n: at[:, k].astype(np.float32) for k, n in enumerate(names)}

    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("vector", pa.binary()), ("cell", pa.int32()), *((n, pa.float32()) for n in names)])
    return map_arrow(usable, place, schema, "vec_id long, label string, dim int, vector binary, cell int, " + ", ".join(f"{n} float" for n in names))


def _tiles(blocks: DataFrame, reach: float) -> DataFrame:
    """(label, dim, left, right): pairs of blocks whose boxes come close enough.

    Blocks meet under the slabs of the first axis that both can reach, so the
    blocks of one label are spread over many keys.
    """
    slab = lambda c: F.greatest(F.lit(0), F.least(F.lit(SLABS - 1), F.floor((c + 1) / 2 * SLABS))).cast("int")
    here = blocks.withColumn("slab", F.explode(F.sequence(slab(F.col("lo0")), slab(F.col("hi0")))))
    there = blocks.withColumn("slab", F.explode(F.sequence(slab(F.col("lo0") - reach), slab(F.col("hi0") + reach))))
    there = there.select("label", "dim", "slab", *[F.col(c).alias(f"r_{c}") for c in ("block", *(f"{e}{k}" for e in ("lo", "hi") for k in range(BOX_AXES)))])
    apart = lambda k: F.greatest(F.lit(0.0), F.col(f"r_lo{k}").cast("double") - F.col(f"hi{k}"), F.col(f"lo{k}").cast("double") - F.col(f"r_hi{k}"))
    squared = sum((apart(k) * apart(k) for k in range(BOX_AXES)), F.lit(0.0))
    near = here.join(there, ["label", "dim", "slab"]).where((F.col("block") <= F.col("r_block")) & (squared <= reach * reach))
    return near.select("label", "dim", F.col("block").alias("left"), F.col("r_block").alias("right")).distinct()


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    prepare(spark)
    kind = "f4" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    if kind == "f8":
        embeddings = embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    usable = stored(_usable(embeddings, kind), "vectors")
    shared = spark.sparkContext.broadcast(principal_axes(usable, kind))
    placed = stored(_placed(usable, shared, kind), "placed")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK

    # blocks: cells in order, gathered to about block_rows; a cell of more rows is several blocks
    boxes = [f(f"c{k}").alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in range(BOX_AXES)]
    cells = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), *boxes)
    before = F.sum("n").over(W.partitionBy("label", "dim").orderBy("cell")) - F.col("n")
    cells = cells.withColumn("before", before).withColumn("sub", F.ceil(F.col("n") / block_rows).cast("int")).withColumn("block", F.floor(F.col("before") / block_rows).cast("long"))
    cells = stored(cells, "cells")
    names = cells.select("label", "dim", "cell", "sub", "block")
    whole = [f(f"{n}{k}").alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in range(BOX_AXES)]
    bounds = cells.drop("block").withColumn("block", F.explode(F.expr("sequence(cast(floor(before / {0}) as bigint), cast(floor(before / {0}) as bigint) + sub - 1)".format(block_rows)))).groupBy("label", "dim", "block").agg(*whole)
    tiles = stored(_tiles(stored(bounds, "blocks"), reach), "tiles")
    member = tiles.select("label", "dim", F.col("left").alias("block"), "left", "right").unionByName(tiles.where("left <> right").select("label", "dim", F.col("right").alias("block"), "left", "right"))
    rows = placed.select("vec_id", "label", "dim", "vector", "cell")
    dealt = rows.join(names, ["label", "dim", "cell"]).withColumn("block", F.col("block") + F.pmod(F.xxhash64("vec_id"), F.col("sub"))).drop("cell", "sub").join(member, ["label", "dim", "block"])

    def compare(table: pa.Table) -> pa.Table:
        dim, left_block, right_block = (table.column(n)[0].as_py() for n in ("dim", "left", "right"))
        ids, block = table.column("vec_id").to_numpy(), table.column("block").to_numpy()
        order = np.lexsort((ids, block))
        ids, block = ids[order], block[order]
        rows = units(table.column("vector").take(pa.array(order)).to_pylist(), dim, kind)
        cut = len(ids) if left_block == right_block else int(np.searchsorted(block, right_block))
        i, j = tile_links(rows[:cut], None if left_block == right_block else rows[cut:], axes_of(shared.value, dim), threshold)
        counts = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        by_id = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        uf = UnionFind(len(ids))
        link_matrix_forest(uf, rank[i], rank[j])
        root = ids[by_id][uf.roots()[rank]]
        hit = counts > 0
        return pa.table({"vec_id": ids[hit], "n_links": counts[hit].astype(np.int64), "root": root[hit]})

    found = dealt.groupBy("label", "dim", "left", "right").applyInArrow(compare, "vec_id long, n_links long, root long")
    found = stored(found, "links")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    out = embeddings.select(F.col("vec_id").cast("long")).join(links, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
