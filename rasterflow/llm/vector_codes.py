"""Vector codes: each vector is cut into parts, and a part is replaced by the index of its nearest codebook entry.

Codebooks come from Lloyd's rounds over all vectors, on integers, so that every engine gets the same entries. Scans are
saved as Hamerly does: a part keeps one upper bound of its distance to its own entry and one lower bound of that to any
other. When entries move, the bounds move with them; where the upper one is strictly below the lower one, or below half
the way to the entry's nearest neighbour, the entry is still the only nearest. Everything else is scanned over the whole
codebook in exact integers, ties going to the lower index. Bounds are doubles that are rounded outwards, so rounding can
cost a scan but never a result.

A round is a map over the vectors, whose state (indices and bounds) is written with them to the shared folder, and one
aggregation of sums per entry, combined in every task first. Only the codebooks pass through the driver; their size is
set by the parameters, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_folder, join_hot, shared_dir

#: Integers beyond this stay at it; no sum of them is cut off.
MOST = 1 << 62
#: Rows that are scanned at once, and how far bounds are rounded outwards.
TILE_ROWS, SLACK = 4096, 1e-9


def exact_up_to(width: int) -> int:
    """Largest component for which squared distances of parts of that width are exact in doubles, in any order of sums."""
    return 1 << ((51 - max(width - 1, 1).bit_length()) // 2)


@dataclass
class Book:
    """One part's codebook: entries (k, width) as 64-bit integers, and how far each moved in the last round."""

    entries: np.ndarray
    moved: np.ndarray | None = None

    def __post_init__(self) -> None:
        k, width = self.entries.shape
        self.exact = exact_up_to(width)
        self.narrow = bool(k == 0 or np.abs(self.entries).max(initial=0) <= self.exact)
        self.c = self.entries.astype(float)
        self.cc = (self.c**2).sum(1)
        if self.moved is not None:
            gap = np.sqrt(((self.c[:, None] - self.c[None]) ** 2).sum(2))
            np.fill_diagonal(gap, np.inf)
            self.half = gap.min(1) / 2 * (1 - SLACK)
            order = np.argsort(-self.moved, kind="stable")
            self.most = np.full(k, self.moved[order[0]])
            self.most[order[0]] = self.moved[order[1]] if k > 1 else 0.0


def scan(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the lowest among equals), its squared distance and the second smallest,
    over the whole codebook. x holds 64-bit integers; distances are exact."""
    at, best, second = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
    for s in range(0, len(x), TILE_ROWS):
        part = x[s : s + TILE_ROWS].astype(float)
        d = (part**2).sum(1)[:, None] - 2 * part @ book.c.T + book.cc
        own = d.argmin(1)
        at[s : s + TILE_ROWS], best[s : s + TILE_ROWS] = own, d[np.arange(len(own)), own]
        if d.shape[1] > 1:
            second[s : s + TILE_ROWS] = np.partition(d, 1, axis=1)[:, 1]
    return at, best, second


def scan_wide(x: np.ndarray, book: Book) -> tuple[np.ndarray, list[int]]:
    """The same for integers of any size, without the second smallest; for the few rows that doubles can't hold."""
    at, best = np.zeros(len(x), np.int64), []
    c = book.entries.astype(object)
    for i, row in enumerate(x.astype(object)):
        d = ((c - row) ** 2).sum(1).tolist()
        best.append(min(d))
        at[i] = d.index(best[-1])
    return at, best


def assign(x: np.ndarray, book: Book, at: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(index, upper, lower) of each row of x for the codebook, given those for the one before, and the number of rows
    that were scanned."""
    n = len(x)
    wide = np.abs(x).max(1, initial=0) > book.exact if book.narrow else np.ones(n, bool)
    if at is None:
        at, upper, lower, todo = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n), np.ones(n, bool)
    else:
        at = at.copy()
        upper = (upper + book.moved[at]) * (1 + SLACK)
        lower = np.maximum((lower - book.most[at]) * (1 - SLACK) - SLACK, 0)
        bound = np.maximum(lower, book.half[at])
        todo = ~(upper < bound)
        near = np.flatnonzero(todo & ~wide)
        upper[near] = np.sqrt(((x[near] - book.entries[at[near]]).astype(float) ** 2).sum(1)) * (1 + SLACK)
        todo = ~(upper < bound)
    rows = np.flatnonzero(todo & ~wide)
    at[rows], best, second = scan(x[rows], book)
    upper[rows], lower[rows] = np.sqrt(best) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
    far = np.flatnonzero(wide)
    at[far], _ = scan_wide(x[far], book)
    upper[far], lower[far] = np.inf, 0.0  # scanned in each round
    return at, upper, lower, len(rows) + len(far)


def errors(x: np.ndarray, book: Book, at: np.ndarray) -> np.ndarray:
    """Squared distances to the given entries, as Python integers where they may not fit doubles."""
    if not book.narrow or np.abs(x).max(initial=0) > book.exact:
        return ((x.astype(object) - book.entries.astype(object)[at]) ** 2).sum(1)
    return ((x - book.entries[at]) ** 2).sum(1)


def _cuts(dims: int, parts: int) -> list[slice]:
    return [slice(dims * p // parts, dims * (p + 1) // parts) for p in range(parts)]


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


STATE = "id long, label string, q array<long>, at array<int>, upper array<double>, lower array<double>"


def _assigned(rows: DataFrame, books: list[Book], cuts: list[slice]) -> DataFrame:
    """rows with their state for these codebooks."""
    dims, parts = cuts[-1].stop, len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("q"), dims, np.int64)
            old = [_matrix(b.column(c), parts, k) for c, k in (("at", np.int64), ("upper", float), ("lower", float))] if "at" in b.schema.names else None
            new = [assign(q[:, s], book, *((v[:, p] for v in old) if old else ())) for p, (s, book) in enumerate(zip(cuts, books))]
            at, upper, lower = (np.stack([x[i] for x in new], 1) for i in range(3))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("q"), _lists(at, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64())], ["id", "label", "q", "at", "upper", "lower"])

    return rows.mapInArrow(run, STATE)


def _moved(state: DataFrame, books: list[Book], cuts: list[slice]) -> list[Book]:
    """Each entry becomes the floored mean of its parts; entries without any stay."""
    dims, parts, k = cuts[-1].stop, len(cuts), len(books[0].entries)
    width = max(s.stop - s.start for s in cuts)
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for b in batches:
            q, at = _matrix(b.column("q"), dims, np.int64), _matrix(b.column("at"), parts, np.int64)
            large = np.abs(q).max(1, initial=0) > 1 << 31  # rows of their own, as sums of them may pass 64 bits
            for p, s in enumerate(cuts):
                key, x = p * k + at[:, p], np.zeros((len(q), width), np.int64)
                x[:, : s.stop - s.start] = q[:, s]
                np.add.at(total, key[~large], x[~large])
                n += np.bincount(key[~large], minlength=parts * k)
                if large.any():
                    yield rows(key[large], np.ones(int(large.sum()), np.int64), x[large])
            if n.max() > 1 << 30:
                yield rows(np.arange(parts * k), n, total)
                total, n = np.zeros_like(total), np.zeros_like(n)
        yield rows(np.flatnonzero(n), n[n > 0], total[n > 0])

    def rows(key: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["key", "n", *names])

    found = state.select("q", "at").mapInArrow(sums, ", ".join(f"{c} long" for c in ("key", "n", *names)))
    means = found.groupBy("key").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names)).collect()
    new = [b.entries.copy() for b in books]
    for r in means:  # parts * entries rows at most
        p, j = divmod(r["key"], k)
        new[p][j] = [int(r[f"s{i}"]) // r["n"] for i in range(new[p].shape[1])]
    return [Book(e, np.sqrt(((e.astype(float) - b.entries.astype(float)) ** 2).sum(1)) * (1 + SLACK)) for e, b in zip(new, books)]


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, q): vectors that are whole, as floor(scale * x) of each component."""
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.expr("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    q = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(-float(MOST)))))
    return own.filter(F.coalesce(whole, F.lit(False))).select("id", "label", q.alias("q"))


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """One row per whole vector: id_col, code (index of each part, two hex digits each, so at most 256 entries), error
    (squared distances summed over the parts), label_error (errors summed over the rows of one label; nulls are one),
    codebooks_sha256 (all entries as decimal integers, by part, entry and position, joined by commas).

    Vectors that are null, empty, or hold null, NaN or infinite components are dropped, and so are those of another length
    than the first one by id; a length that `parts` does not divide gives parts that differ by one. The first entries are
    the vectors of the lowest ids, null ids last and equal ids by content; fewer vectors than `entries` give a smaller
    codebook. Repeated rows stay rows of their own. Components beyond 2^62 / scale stay there, and errors beyond a long at
    its largest. An empty table gives no rows."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    spark = vectors.sparkSession
    folder = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    try:
        return _coded(spark, integers(vectors, scale, id_col, vector_col, label_col), folder, parts, entries, rounds, id_col)
    finally:
        drop_folder(spark, folder)


def _coded(spark: SparkSession, whole: DataFrame, folder: str, parts: int, entries: int, rounds: int, id_col: str) -> DataFrame:
    whole.write.parquet(f"{folder}/0")
    rows = spark.read.schema("id long, label string, q array<long>").parquet(f"{folder}/0")
    lead = [F.asc_nulls_last("id"), F.asc("q")]
    first = rows.select("id", "q").orderBy(*lead).limit(1).collect()
    dims = len(first[0]["q"]) if first else parts
    rows = rows.filter(F.size("q") == dims)
    seeds = rows.select("id", "q").orderBy(*lead).limit(entries).collect()
    cuts = _cuts(dims, parts)
    start = np.array([r["q"] for r in seeds], np.int64).reshape(len(seeds), dims)
    books = [Book(start[:, s].copy()) for s in cuts]
    for r in range(1, rounds + 1) if seeds else ():
        _assigned(rows, books, cuts).write.parquet(f"{folder}/{r}")
        drop_folder(spark, f"{folder}/{r - 1}")
        rows = spark.read.schema(STATE).parquet(f"{folder}/{r}")
        books = _moved(rows, books, cuts)
    said = hashlib.sha256(",".join(str(v) for b in books for v in b.entries.reshape(-1).tolist()).encode()).hexdigest()

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, at = _matrix(b.column("q"), dims, np.int64), _matrix(b.column("at"), parts, np.int64)
            off = [errors(q[:, s], book, at[:, p]).tolist() for p, (s, book) in enumerate(zip(cuts, books))]
            total = [min(sum(x), (1 << 63) - 1) for x in zip(*off)]
            code = [row.tobytes().hex() for row in at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(code), pa.array(total, pa.int64())], ["id", "label", "code", "error"])

    final = cut((_assigned(rows, books, cuts) if seeds else rows.withColumn("at", F.array(F.lit(0)))).mapInArrow(done, "id long, label string, code string, error long"))
    # a label that is null is told apart from the empty one
    keyed = final.withColumn("known", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", F.lit("")))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    per = keyed.groupBy("known", "label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"), F.count("*").alias("n"))
    joined = join_hot(keyed, per, ["known", "label"], "id", final.count())
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
