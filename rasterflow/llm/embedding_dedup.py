"""Embedding near-dedup by a subspace pigeonhole join.

For unit vectors, cosine >= t means squared distance <= 2 - 2t. A rotation keeps distances and spreads them evenly
over the coordinates, which are then cut into blocks of few dimensions. Each block gets a share of the squared
distance in proportion to its dimensions; a linked pair stays within the share in one block at least, as the
shares add up to the whole. So every block is range-joined on its own: rows are dealt into bins of the block's
first coordinate, as wide as the block's radius, and meet their own bin and the next one only; within a task they
are sorted by the block's second coordinate, and a row meets only those within the radius of it there. Candidates of
any block are verified by the exact cosine of the vectors as they were given, in double precision.

Equal vectors collapse first. A pair counts in the first block that proposes it, so nothing is counted twice
and no list of pairs is ever written: a task returns a link count per vector and a spanning forest of its
links. A bin of many rows is cut into chunks, and chunks meet pairwise, so no task holds more than two.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, cut, join_hot

#: Dimensions of a block, rows of a chunk; rows and pairs whose block distance is held at once, and pairs verified at once.
BLOCK_DIMS, CHUNK_ROWS, TILE_ROWS, TILE_CELLS, PAIRS = 8, 16_384, 128, 500_000, 20_000
#: Room for rounding in squared distances of unit vectors.
SLACK = 1e-9


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def turned(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The unit vectors of x, rotated. Rows go in tiles of one shape, so that a row's rounding does not depend on those
    it comes with: tasks must agree on which block is the first to propose a pair."""
    x = x / np.abs(x).max(1, keepdims=True)  # squares of the largest doubles would overflow
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    tiles = np.concatenate([x, np.zeros((-len(x) % TILE_ROWS, x.shape[1]))]).reshape(-1, TILE_ROWS, x.shape[1])
    return np.matmul(tiles, turn).reshape(-1, x.shape[1])[: len(x)]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of row i of a and row i of b, in double precision."""
    # by powers of two, which rounds nothing: squares of the largest doubles would overflow
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a, b))
    dot = lambda p, q: np.einsum("ij,ij->i", p, q)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def _compare(given: tuple[np.ndarray, np.ndarray | None], spun: tuple[np.ndarray, np.ndarray | None], k: int, blocks: list[slice], budgets: list[float], least: float):
    """given, spun: the vectors of two chunks as they are and rotated; the second None: pairs i < j of the first.
    Yields (i, j) of verified pairs that block k is the first to propose."""
    alone = spun[1] is None
    block, radius = blocks[k], math.sqrt(budgets[k] + 2 * SLACK)
    by = min(block.start + 1, block.stop - 1)
    order = [np.argsort(x[:, by], kind="stable") for x in spun if x is not None]
    left, other = spun[0][order[0]], spun[0 if alone else 1][order[-1]]
    a, b, line = left[:, block], other[:, block], other[:, by]
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)

    def within(p, q, at: int) -> np.ndarray:
        s = blocks[at]
        return ((left[p, s] - other[q, s]) ** 2).sum(1) <= budgets[at] + SLACK

    for at in range(0, len(a), TILE_ROWS):
        rows = slice(at, at + TILE_ROWS)
        low, high = np.searchsorted(line, left[rows, by][[0, -1]] + (-radius - SLACK, radius + SLACK), "left")
        low = max(low, at) if alone else low
        for c in range(low, high, TILE_CELLS // TILE_ROWS):
            cols = slice(c, min(high, c + TILE_CELLS // TILE_ROWS))
            i, j = np.nonzero(aa[rows, None] + bb[None, cols] - 2 * a[rows] @ b[cols].T <= budgets[k] + 2 * SLACK)
            i, j = i + at, j + c
            if alone:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), PAIRS):
                p, q = i[s : s + PAIRS], j[s : s + PAIRS]
                for earlier in range(k):
                    keep = ~within(p, q, earlier)
                    p, q = p[keep], q[keep]
                keep = within(p, q, k)
                p, q = order[0][p[keep]], order[-1][q[keep]]
                keep = cosines(given[0][p], given[0 if alone else 1][q]) >= least
                if keep.any():
                    yield p[keep], q[keep]


def embedding_components(vectors: DataFrame, least: float = 0.95, block_dims: int = BLOCK_DIMS, chunk_rows: int = CHUNK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id_col, n_links (other rows with cosine >= least), component_id (smallest id that
    links reach, itself included), kept (id_col = component_id).

    Vectors that are null, empty, zero, or hold null, NaN or infinite components have no links and stand alone.
    Vectors of different lengths never link. Repeated rows are rows of their own that link with each other; a
    null id is never kept. An empty table gives no rows. Further columns are left out, whatever their names."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    narrow = dict(vectors.dtypes)[vector_col] == "array<float>"
    fine = F.coalesce(F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"), F.lit(False))
    # -0.0 and 0.0 are equal; the key must be equal too
    own = own.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("key", F.xxhash64("v"))
    own = cut(own)
    same = cut(own.filter("v IS NOT NULL").groupBy("key", "v").agg(F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    counts, edges = None, None
    for (dims,) in same.select(F.size("v").alias("dims")).distinct().collect():
        found = _links(same.filter(F.size("v") == dims), dims, least, block_dims, chunk_rows, narrow)
        counts = found if counts is None else counts.union(found)
    if counts is None:
        joined = own.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        counts = cut(counts)
        roots = components(counts.filter("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")))
        linked = counts.groupBy("node").agg(F.sum("links").alias("links"))
        named = same.join(linked, "node", "left").join(roots, "node", "left").select(
            "key", "v", "low", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
        lowest = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
        named = join_hot(named, lowest, ["root"], "low", same.count()).select("key", "v", "n_links", "component_id", F.col("copies").alias("n"))
        joined = join_hot(own, named, ["key", "v"], "id", own.count(), "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return joined.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(same: DataFrame, dims: int, least: float, block_dims: int, chunk_rows: int, narrow: bool) -> DataFrame:
    """(node, links, root): a node's links in one task, weighted by copies; and, in rows of their own, edges. narrow:
    components are floats, so tasks get them as such."""
    blocks = [slice(i, min(i + block_dims, dims)) for i in range(0, dims, block_dims)]
    total = 2 - 2 * least
    budgets = [total * (b.stop - b.start) / dims for b in blocks]
    turn = rotation(dims)

    kind = "<f4" if narrow else "<f8"

    def rotate(batches):
        for b in batches:
            x = np.array(b["v"].tolist(), float).reshape(len(b), dims)
            spun = turned(x, turn)
            bins = np.stack([np.floor(spun[:, s.start] / math.sqrt(t + 2 * SLACK)) for s, t in zip(blocks, budgets)], 1).astype(np.int32)
            yield pd.DataFrame({"node": b["node"], "copies": b["copies"], "x": [row.tobytes() for row in x.astype(kind)], "bins": list(bins)})

    rows = cut(same.select("node", "copies", "v").mapInPandas(rotate, "node long, copies long, x binary, bins array<int>"))
    rows = rows.select("node", "copies", "x", F.posexplode("bins").alias("block", "bin"))
    # coordinates of unit vectors lie in [-1, 1]: at most 2 / radius bins a block, whatever the number of rows
    sizes = {(k, b): n for k, b, n in rows.groupBy("block", "bin").count().collect()}
    chunks = {kb: -(-n // chunk_rows) for kb, n in sizes.items()}
    most = max(chunks.values())
    of = F.create_map(*(F.lit(x) for (k, b), n in chunks.items() for x in (f"{k},{b}", n)))
    n_of = lambda b: F.coalesce(F.try_element_at(of, F.concat_ws(",", "block", b)), F.lit(0))
    rows = rows.withColumn("n", n_of(F.col("bin"))).withColumn("below", n_of(F.col("bin") - 1)).withColumn("above", n_of(F.col("bin") + 1))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    # a task is (block, bin, i, j): chunk i of the bin meets chunk j of the same bin (j >= i) or of the next one (j + most)
    tasks = F.expr(f"""concat(
        transform(sequence(0, n - 1), j -> named_struct('bin', bin, 'i', least(j, chunk), 'j', greatest(j, chunk), 'side', if(j >= chunk, 0, 1))),
        if(above = 0, array(), transform(sequence(0, greatest(above, 1) - 1), j -> named_struct('bin', bin, 'i', chunk, 'j', j + {most}, 'side', 0))),
        if(below = 0, array(), transform(sequence(0, greatest(below, 1) - 1), i -> named_struct('bin', bin - 1, 'i', i, 'j', chunk + {most}, 'side', 1))))""")
    dealt = rows.select("node", "copies", "x", "block", F.explode(tasks).alias("t")).select("node", "copies", "x", "block", "t.*")

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        alone = g["i"].iloc[0] == g["j"].iloc[0]
        g = g.sort_values(["side", "node"])
        x = np.frombuffer(b"".join(g["x"]), kind).reshape(len(g), dims).astype(float)
        copies, cut_at = g["copies"].to_numpy(), int((g["side"] == 0).sum())
        links, forest = np.zeros(len(g), np.int64), Forest(len(g))
        if not alone and cut_at in (0, len(g)):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        spun = turned(x, turn)
        both = [(v, None) if alone else (v[:cut_at], v[cut_at:]) for v in (x, spun)]
        for p, q in _compare(*both, int(g["block"].iloc[0]), blocks, budgets, least):
            q = q if alone else q + cut_at
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            forest.add(p, q)
        node, some = g["node"].to_numpy(), links > 0
        a, b = forest.edges()
        return pd.concat([pd.DataFrame({"node": node[some], "links": links[some], "root": None}), pd.DataFrame({"node": node[a], "links": 0, "root": node[b]})]).astype({"root": "Int64"})

    return dealt.groupBy("block", "bin", "i", "j").applyInPandas(meet, "node long, links long, root long")
