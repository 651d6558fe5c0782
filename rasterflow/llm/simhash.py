"""SimHash near-dedup with BK-trees.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it set. Fingerprints that
differ in few bits are linked. Documents with equal fingerprints collapse before any comparison, so groups of
exact copies cost one row. The rest is dealt into shards, each with a BK-tree of its own: a child hangs under
its parent by the integer Hamming distance between them, and a search with radius r at distance d follows the
edges d-r..d+r only. A tree never holds more than a bounded number of rows, so no tree grows with the corpus;
it is built in the task that owns the shard, which is also where the shard's queries come, instead of being
sent to every executor.

Which fingerprints share a shard is decided so that no link is lost: cut the 64 bits into radius+1 blocks, and
two fingerprints within the radius agree on one block at least. A block value that too many fingerprints share
is cut again, over the bits it leaves open, until its rows fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, column_of, components, cut, join_hot

SEED = 42
#: Rows of one bucket before it is cut again, and rows of one shard's tree on average.
BUCKET_ROWS, SHARD_ROWS = 4096, 8192
_STEP, _PAIRS = 1 << 17, 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Words of [^ \\t-\\r]+ with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of k words, repeats included, in pieces; fewer words: the whole sequence; none: nothing."""
    if words and len(words) < k:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, len(words) - k + 1, _STEP):
        part = words[at : at + _STEP + k - 1]
        yield np.fromiter((digest(join(s), SEED) for s in zip(*(part[i:] for i in range(k)))), np.uint64, len(part) - k + 1)


def fingerprint(words: list[bytes], k: int) -> int:
    return majority(shingle_hashes(words, k))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes have set."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int((np.uint64(1) << np.flatnonzero(ones * 2 > n).astype(np.uint64)).sum(dtype=np.uint64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): a 64-bit fingerprint per row; a null text counts as one without words, whose fingerprint is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": [signed(fingerprint(words_of(t), k)) for t in b["text"]]})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(run, "id long, fp long").withColumnRenamed("id", id_col)


class BKTree:
    """Over distinct 64-bit values. kids[i, d] is the child of node i at distance d, or -1."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        self.kids = np.full((n, 65), -1, np.int32)
        todo, at = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        while len(todo):
            slot = at * 65 + np.bitwise_count(points[todo] ^ points[at])
            taken, first, which = np.unique(slot, return_index=True, return_inverse=True)
            self.kids.reshape(-1)[taken] = todo[first]  # the first to come takes the free slot, the others go below it
            below = np.ones(len(todo), bool)
            below[first] = False
            at, todo = todo[first][which][below], todo[below]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (query number, node) within the radius, in pieces of bounded size."""
        n = len(self.points)
        step = max(1, 2_000_000 // max(n, 1))
        for start in range(0, len(queries) if n else 0, step):
            q = np.arange(start, min(start + step, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                nq, nn = [], []
                for e in range(-radius, radius + 1):
                    kid = self.kids[node, np.clip(d + e, 0, 64)]
                    go = (kid >= 0) & (d + e >= 0) & (d + e <= 64)
                    nq.append(q[go])
                    nn.append(kid[go].astype(np.int64))
                q, node = np.concatenate(nq), np.concatenate(nn)


def _blocks(mask: int, parts: int) -> list[int]:
    """mask, and in turn each of `parts` runs of the bits that it leaves open."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return sorted({mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])} - {mask})


def _shard_links(radius: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(g["fp"].to_numpy(np.int64)).view(np.uint64)
        tree, forest = BKTree(points), Forest(len(points))
        for q, node in tree.search(points, radius):
            forest.add(q, node)
        a, b = forest.edges()
        return pd.DataFrame({"a": points.view(np.int64)[a], "b": points.view(np.int64)[b]})

    return run


def fingerprint_links(fps: DataFrame, radius: int, bucket_rows: int = BUCKET_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """fps: distinct values fp long. (a, b): links that join the same values as all pairs within the radius do;
    a shard hands on a spanning forest of its links, so a dense group of n values costs at most n rows."""
    if bucket_rows < 1 << radius + 1:  # or a bucket could be cut where fewer than radius + 1 bits are open
        raise ValueError("buckets must hold all values of radius + 1 bits")
    out, masks = None, _blocks(0, radius + 1)
    rows = fps.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    while masks:
        rows = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = cut(rows.groupBy("mask", "key").count().filter("count > 1"))
        small, n, big = sizes.agg(F.count(F.when(F.col("count") <= bucket_rows, 1)), F.sum(F.when(F.col("count") <= bucket_rows, F.col("count"))), F.count(F.when(F.col("count") > bucket_rows, 1))).first()
        if small:
            shards = max(1, -(-n // shard_rows))
            here = rows.join(sizes.filter(F.col("count") <= bucket_rows).drop("count"), ["mask", "key"])
            here = here.select("fp", F.pmod(F.xxhash64("mask", "key"), F.lit(shards)).alias("shard"))
            found = here.groupBy("shard").applyInPandas(_shard_links(radius), "a long, b long")
            out = found if out is None else out.union(found)
        if not big:
            break
        finer = {m: _blocks(m, radius + 1) for m in masks}
        rows = rows.join(sizes.filter(F.col("count") > bucket_rows).drop("count"), ["mask", "key"])
        # a few rows, as many as there are masks, whatever the number of fingerprints
        into = fps.sparkSession.createDataFrame([(signed(m), [signed(x) for x in xs]) for m, xs in finer.items()], "mask long, finer array<long>")
        rows = cut(rows.join(F.broadcast(into), "mask").select("fp", F.explode("finer").alias("mask")).distinct())
        masks = sorted({x for into in finer.values() for x in into})
    return out if out is not None else fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)


def simhash_components(docs: DataFrame, k: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id, the smallest id that links of at
    most `radius` differing bits reach.

    Null and wordless texts have fingerprint 0 and link like others; repeated rows stay rows of their own; a
    null id never becomes a component_id unless its component has no other; an empty table gives no rows. Further
    columns are left out, whatever their names."""
    own = cut(fingerprints(docs, k, id_col, text_col))
    fps = cut(own.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")))
    roots = components(fingerprint_links(fps.select("fp"), radius))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    of = _named(named, F.min("low").alias("component_id"), fps.count()).select("fp", "component_id", "n")
    return join_hot(own, of, ["fp"], id_col, own.count()).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(named: DataFrame, what: Column, rows: int) -> DataFrame:
    """named with what its root's rows come to; the root of a large component is no hot key."""
    of = named.groupBy("root").agg(what, F.count("*").alias("n"))
    return join_hot(named.withColumnRenamed("n", "own_n"), of, ["root"], "low", rows).withColumnRenamed("own_n", "n")


# Near-duplicate documents: fingerprints propose, shingle sets decide.

#: Distance at which 64-bit fingerprints of texts with 0.8 of their shingles in common still lie, with hardly an
#: exception; least hashes by which documents come to share a shard, and those that part a crowded one.
NEAR_RADIUS, SHARE_KEYS, PART_KEYS = 20, 4, 4
#: Documents whose ids are broadcast at most, to read their texts again; beyond, the join is a shuffle.
BROADCAST_ROWS = 200_000
#: The part of the texts whose shingles are counted to tell which come last, the texts below which all are, how many
#: shingles come last at most, and rows of a bucket before it is cut.
SAMPLE_PART, SAMPLE_ROWS, COMMON_SHINGLES, CROWD_ROWS = 8, 4096, 200_000, 1024
#: Words of 64 bits of a parity map, and rows that a task hands back at once.
MAP_WORDS, _ROWS = 8, 1 << 16
#: Texts whose copies a task leaves out; bytes of the sets and numbers of postings that a shard holds on average.
_MARKS, SHARD_BYTES, SHARD_POSTINGS = 200_000, 24 << 20, 1 << 18


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    parts = list(shingle_hashes(words, k))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _mark(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _least_hashes(hashes: np.ndarray, n: int) -> list[int]:
    """The smallest of each of n re-hashings: two sets agree on one with the chance of their Jaccard similarity."""
    out = []
    for j in range(n):
        h = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(signed(int((h ^ (h >> np.uint64(32))).min())) if len(h) else j)
    return out


def _bucket_trees(least: float | None, radius: int):
    """Without `least`: the members that have a neighbour within the radius. With it: a spanning forest of the pairs
    whose shingle sets are as similar; pairs that are joined already are not looked at again."""

    def survivors(g: pd.DataFrame) -> pd.DataFrame:
        points, which = np.unique(g["fp"].to_numpy(np.int64), return_inverse=True)
        points = points.view(np.uint64)
        near = np.bincount(which, minlength=len(points)) > 1
        for q, node in BKTree(points).search(points, radius):
            near[q[q != node]] = True
        return g.loc[near[which], ["task", "node", "fp"]]

    def links(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
        points, which = np.unique(g["fp"].to_numpy(np.int64), return_inverse=True)
        members = [np.flatnonzero(which == i) for i in range(len(points))] if len(points) < len(g) else [np.array([i]) for i in np.argsort(which)]
        forest, node = Forest(len(g)), g["node"].to_numpy()

        def similar(a: int, b: int) -> bool:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < least * max(len(x), len(y)):
                return False
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both >= least * (len(x) + len(y) - both)

        def member_pairs() -> Iterator[np.ndarray]:
            """Pairs of members of neighbouring points, in pieces of bounded size."""
            single = np.array([m[0] if len(m) == 1 else -1 for m in members])
            for q, at in BKTree(points.view(np.uint64)).search(points.view(np.uint64), radius):
                q, at = q[q <= at], at[q <= at]
                alone = (single[q] >= 0) & (single[at] >= 0)
                both = np.column_stack([single[q[alone]], single[at[alone]]])
                both = both[both[:, 0] != both[:, 1]]
                for s in range(0, len(both), _PAIRS):
                    yield both[s : s + _PAIRS]
                for i, j in zip(q[~alone].tolist(), at[~alone].tolist()):
                    for x in members[i]:
                        y = members[j] if i != j else members[j][members[j] > x]
                        yield np.column_stack([np.full(len(y), x), y])

        for left in member_pairs():
            while len(left := left[forest.up[left[:, 0]] != forest.up[left[:, 1]]]):
                ok = np.array([similar(a, b) for a, b in left[:32]])
                forest.add(left[:32][ok, 0], left[:32][ok, 1])
                left = left[32:]
        a, b = forest.edges()
        return pd.DataFrame({"a": node[a], "b": node[b]})

    def run(g: pd.DataFrame) -> pd.DataFrame:
        f = survivors if least is None else links
        parts = [f(part) for _, part in g.groupby("task", sort=True) if len(part) > 1]
        return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in (("task", "node", "fp") if least is None else ("a", "b"))})

    return run


def _tasks(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """rows: (node, fp, keys). (task, node, fp): members that share a least hash meet in a task; a hash that too many
    share is parted by a second one; what is still too many is cut into chunks that meet pairwise."""
    share, part = range(SHARE_KEYS), range(SHARE_KEYS, SHARE_KEYS + PART_KEYS)
    first = rows.select("node", "fp", "keys", F.explode(F.array(*(F.xxhash64(F.lit(j), F.col("keys")[j]) for j in share))).alias("key"))
    sizes = cut(first.groupBy("key").count().filter("count > 1"))
    fits = first.join(sizes.filter(F.col("count") <= bucket_rows).drop("count"), "key").select("node", "fp", F.col("key").alias("task"))
    if not sizes.filter(F.col("count") > bucket_rows).count():
        return fits
    crowd = first.join(sizes.filter(F.col("count") > bucket_rows).drop("count"), "key")
    second = crowd.select("node", "fp", F.explode(F.array(*(F.xxhash64("key", F.lit(j), F.col("keys")[j]) for j in part))).alias("key"))
    chunks = cut(second.groupBy("key").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("chunks"), F.count("*").alias("n")).filter("n > 1"))
    own = second.join(chunks, "key").withColumn("own", F.expr("CAST(pmod(xxhash64(node), chunks) AS int)"))
    meet = F.expr("transform(sequence(0, chunks - 1), c -> xxhash64(key, least(c, own), greatest(c, own)))")
    return fits.union(own.select("node", "fp", F.explode(meet).alias("task")))


def _needed(n: int, least: float) -> int:
    """Shingles that a set of n has in common with any set that is as similar."""
    return int(np.ceil(least * n - 1e-9))


def parity_map(hashes: np.ndarray) -> bytes:
    """A bit per value modulo the map's length, set if an odd number of hashes have it. What two sets have in common
    cancels out, so their maps differ in no more bits than the sets have values that are in one of them only."""
    bits = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * MAP_WORDS), minlength=64 * MAP_WORDS) % 2
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _group_pairs(task: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs that stand in one task, of a sorted array of tasks, in bounded pieces. Groups
    of one size go together."""
    start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(task) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(task)])
    for k in np.unique(size[size > 1]).tolist():
        of = start[size == k]
        if k > 256:  # row by row
            for at in of.tolist():
                for i in range(k - 1):
                    yield np.full(k - 1 - i, at + i), np.arange(at + i + 1, at + k)
            continue
        i, j = np.triu_indices(k, 1)
        step = max(1, _PAIRS // len(i))
        for s in range(0, len(of), step):
            yield (of[s : s + step, None] + i).reshape(-1), (of[s : s + step, None] + j).reshape(-1)


def _prefix_pairs(slim: DataFrame, texts: DataFrame, k: int, least: float, shards: int, crowd_rows: int) -> DataFrame:
    """texts: (mark, node, root, map, size). (a, b): nodes of different roots, among them all whose sets are as similar as `least`.

    Two such sets of x and y shingles have one in common among the first x - _needed(x) + 1 and y - _needed(y) + 1 in any
    order that is the same for all, and at most (x + y) * (1 - least) / (1 + least) are in one of them only. A pair is left
    out where it is met only if the parity maps show more of those, and after that if what its prefixes have in common, and all that
    may follow, is too little: pairs that merely share a passage are never written. Shingles that a sample finds in many
    texts come last, which decides the work only."""
    m = SAMPLE_PART if texts.count() > SAMPLE_ROWS else 1

    def together(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
        """rows of column arrays, put together into batches."""
        held, n = [], 0
        for row in rows:
            held.append(row)
            n += len(row[0])
            if n > _ROWS:
                yield batch(held, types)
                held, n = [], 0
        if held:
            yield batch(held, types)

    def batch(held: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, (_, t) in zip(zip(*held), types)], [n for n, _ in types])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together(((shingle_set(words_of(t), k).view(np.int64),) for t in column_of(batches, "text")), [("h", pa.int64())])

    often = slim.filter(F.pmod(F.xxhash64("text"), F.lit(m)) == 0).select("text").mapInArrow(hashes, "h long").groupBy("h").count().filter("count > 3")
    # as columns: as many rows would be objects of the driver's Python, 300 bytes each
    most = often.orderBy(F.desc("count"), "h").limit(COMMON_SHINGLES).toArrow()
    late = most["h"].to_numpy()[np.lexsort((most["h"].to_numpy(), -most["count"].to_numpy()))][::-1]
    by = np.argsort(late.view(np.uint64))
    known = slim.sparkSession.sparkContext.broadcast((late.view(np.uint64)[by], by + 1))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = known.value
        posted: set[bytes] = set()

        def one(t: str | None) -> tuple | None:
            mark = _mark(w := words_of(t))
            if mark in posted:  # a copy would be dropped later
                return None
            if len(posted) < _MARKS:
                posted.add(mark)
            own = shingle_set(w, k)
            rank = np.zeros(len(own), np.int64)
            if len(values) and len(own):
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                rank = np.where(values[at] == own, ranks[at], 0)
            first = own[np.argsort(rank, kind="stable")[: len(own) - _needed(len(own), least) + 1]]
            high, low = np.frombuffer(mark, ">i8").astype(np.int64)
            return first.view(np.int64), np.full(len(first), high), np.full(len(first), low), np.full(len(first), len(own))

        rows = (row for row in map(one, column_of(batches, "text")) if row)
        yield from together(rows, [(c, pa.int64()) for c in ("token", "m1", "m2", "n")])

    def met(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates(["token", "m1", "m2"])
        return g.loc[g.duplicated("token", keep=False), ["token", "m1", "m2", "n"]]

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["task", "n"], kind="stable")
        node, root, n, own, alone = (g[c].to_numpy() for c in ("node", "root", "n", "own", "alone"))
        maps = np.frombuffer(b"".join(g["map"]), np.uint64).reshape(-1, MAP_WORDS)
        out = []
        for i, j in _group_pairs(g["task"].to_numpy()):
            keep = (root[i] != root[j]) & (n[j] <= n[i] / least + 1e-9) & (alone[i] | (own[i] != own[j]))
            i, j = i[keep], j[keep]
            apart = np.bitwise_count(maps[i] ^ maps[j]).sum(1)
            keep = apart <= (n[i] + n[j]) * ((1 - least) / (1 + least)) + 1e-6
            if keep.any():
                i, j = i[keep], j[keep]
                swap = node[i] > node[j]
                out.append((np.where(swap, node[j], node[i]), np.where(swap, node[i], node[j]), np.where(swap, n[j], n[i]), np.where(swap, n[i], n[j])))
        a, b, x, y = (np.concatenate(c) for c in zip(*out)) if out else np.zeros((4, 0), np.int64)
        found = pd.DataFrame({"a": a, "b": b, "c": np.ones(len(a), np.int64), "x": x, "y": y})
        return found.groupby(["a", "b"], as_index=False).agg(c=("c", "sum"), x=("x", "first"), y=("y", "first"))

    posts = slim.select("text").mapInArrow(prefixes, "token long, m1 long, m2 long, n long")
    # a fifth of the shingles and one more stand in prefixes, of each text once at least
    many = texts.agg(F.sum(F.col("size") * F.lit(1 - least) + 1)).first()[0] or 0
    groups = max(1, -(-int(many) // SHARD_POSTINGS))
    shared = posts.groupBy(F.pmod("token", F.lit(groups)).alias("shard")).applyInPandas(met, "token long, m1 long, m2 long, n long")
    shared = cut(shared.join(texts.select("m1", "m2", "node", "root"), ["m1", "m2"]).select("token", "node", "root", "n"))
    sizes = shared.groupBy("token").agg(F.ceil(F.count("*") / crowd_rows).cast("int").alias("chunks"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    own = shared.join(sizes.select("token", "chunks"), "token").withColumn("own", F.expr("CAST(pmod(xxhash64(node), chunks) AS int)"))
    # a chunk meets itself in one task, and each other chunk across only in a task of the two
    meet = F.expr("transform(sequence(0, chunks - 1), c -> struct(xxhash64(token, least(c, own), greatest(c, own)) AS task, c = own AS alone))")
    dealt = own.select("node", "root", "n", "own", F.explode(meet).alias("m")).select("node", "root", "n", "own", "m.task", "m.alone")
    rows = dealt.join(texts.select("node", "map"), "node").withColumn("shard", F.pmod("task", F.lit(shards)))
    found = rows.groupBy("shard").applyInPandas(pairs, "a long, b long, c long, x long, y long")
    total = found.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("x").alias("x"), F.first("y").alias("y"))
    rest = lambda c: F.ceil(F.lit(least) * F.col(c) - 1e-9) - 1
    return total.filter(F.col("c") + F.greatest(rest("x"), rest("y")) >= (F.col("x") + F.col("y")) * (least / (1 + least)) - 1e-6).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, radius: int = NEAR_RADIUS, bucket_rows: int = BUCKET_ROWS, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, mark (digest of its word sequence), group_id, kept. Documents are in one group if
    links join them: equal word sequences (A-Z in lower case), or a Jaccard similarity of at least `least` between
    their sets of k-word shingles. One text of each group is kept, that with the smallest id.

    Most links are found among fingerprints within `radius` bits in the BK-tree of a shard, which holds documents that
    share one of SHARE_KEYS least hashes. Pairs that this does not join are found by common shingles in their prefixes,
    so none is lost. Every link is verified on the whole sets. Null and wordless texts are copies of each other; a null id ranks last;
    rows that repeat id and text are all kept or all not; an empty table gives no rows."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["id"], b["text"]):
                w = words_of(text)
                own = shingle_set(w, k)
                # of the set, as the similarity that decides is: how often a line is repeated must not move it
                fp = majority(own[at : at + _STEP] for at in range(0, len(own), _STEP))
                out.append((doc, _mark(w), signed(fp), _least_hashes(own, SHARE_KEYS + PART_KEYS), parity_map(own), len(own)))
            yield pd.DataFrame(out, columns=["id", "mark", "fp", "keys", "map", "size"]).astype({"id": "Int64"})

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [words_of(t) for t in b["text"]]
            yield pd.DataFrame({"mark": [_mark(x) for x in w], "shingles": [shingle_set(x, k).tobytes() for x in w]})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = cut(slim.mapInPandas(sketch, "id long, mark binary, fp long, keys array<long>, map binary, size long"))
    distinct = own.groupBy("mark").agg(F.min("id").alias("low"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("map").alias("map"), F.first("size").alias("size"), F.count("*").alias("n"))
    texts = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    tasks = _tasks(texts.select("node", "fp", "keys"), bucket_rows)
    shards = max(1, -(-texts.count() * SHARE_KEYS // shard_rows))
    dealt = lambda df, n: df.withColumn("shard", F.pmod("task", F.lit(n))).groupBy("shard")
    left = cut(dealt(tasks, shards).applyInPandas(_bucket_trees(None, radius), "task long, node long, fp long"))

    def with_sets(nodes: DataFrame) -> DataFrame:
        active = cut(nodes.distinct().join(texts, "node").select("node", "mark", "low"))
        ids = active.select(F.col("low").alias("of")).distinct()
        ids = F.broadcast(ids) if active.count() <= BROADCAST_ROWS else ids
        shingles = slim.join(ids, F.col("id").eqNullSafe(F.col("of"))).select("text").mapInPandas(sets, "mark binary, shingles binary")
        return active.join(shingles, "mark").groupBy("node").agg(F.first("shingles").alias("shingles"))

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b["x"], b["y"])]
            n = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in both]
            yield b.loc[[c >= least * (len(x) + len(y) - c) for c, (x, y) in zip(n, both)], ["a", "b"]]

    # the sets of a shard are held at once, so their bytes tell how many shards there are
    weight = left.join(texts.select("node", "size"), "node").agg(F.sum(8 * F.col("size") + 256)).first()[0] or 0
    found = cut(dealt(left.join(with_sets(left.select("node")), "node"), max(1, -(-weight // SHARD_BYTES))).applyInPandas(_bucket_trees(least, radius), "a long, b long"))
    roots = components(found)
    half = lambda at: F.conv(F.hex(F.substring("mark", at, 8)), 16, -10).cast("long")
    rooted = texts.join(roots, "node", "left").select(half(1).alias("m1"), half(9).alias("m2"), "node", "map", "size", F.coalesce("root", "node").alias("root"))
    pairs = cut(_prefix_pairs(slim, rooted, k, least, shards, min(bucket_rows, CROWD_ROWS)))
    if not pairs.isEmpty():
        of = with_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        ends = pairs.join(of.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        roots = components(found.union(ends.select("a", "b", "x", "y").mapInPandas(verified, "a long, b long")))
    named = texts.join(roots, "node", "left").select("mark", "low", "n", F.coalesce("root", "node").alias("root"))
    best = F.min(F.struct(F.col("low").isNull().alias("last"), "low", "mark")).alias("best")
    of = _named(named, best, texts.count()).select("mark", F.col("best.low").alias("group_id"), F.col("best.mark").alias("kept_mark"), "n")
    return join_hot(own, of, ["mark"], "id", own.count()).select(F.col("id").alias(id_col), "mark", "group_id", ((F.col("mark") == F.col("kept_mark")) & F.col("id").eqNullSafe(F.col("group_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs less the rows that near_duplicates does not keep; one row of those that repeat id and text."""
    found = cut(near_duplicates(docs, k, least, id_col=id_col, text_col=text_col, **how))
    # an id of one row is told by itself; where rows share an id, their texts tell them apart too
    per = cut(found.groupBy(F.col(id_col).alias("kept_id")).agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("int")).alias("n")).filter("n > 0"))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"))
    out = row.join(per.filter("rows = 1"), F.col("own").eqNullSafe(F.col("kept_id")), "left_semi").select("row")
    if per.filter("rows > 1").count():

        @F.pandas_udf("binary")
        def mark(texts: pd.Series) -> pd.Series:
            return pd.Series([_mark(words_of(t)) for t in texts])

        shared = found.filter("kept").select(F.col(id_col).alias("kept_id"), F.col("mark").alias("kept_mark")).distinct().join(per.filter("rows > 1").select(F.col("kept_id").alias("of")), F.col("kept_id").eqNullSafe(F.col("of")), "left_semi")
        ids = shared.select("kept_id").distinct()
        more = row.join(ids, F.col("own").eqNullSafe(F.col("kept_id")), "left_semi").withColumn("m", mark(F.col("row")[text_col].cast("string")))
        more = more.join(shared, F.col("own").eqNullSafe(F.col("kept_id")) & (F.col("m") == F.col("kept_mark")), "left_semi")
        out = out.union(more.dropDuplicates(["own", "m"]).select("row"))
    return out.select("row.*")
