"""Cost-balanced packing of tokenised documents into training sequences.

Attention makes a document's cost grow faster than its length: cost(n) = n + n * n / quadratic. Documents are
taken in descending order and each goes to the sequence that costs least so far among those with room for it.
A document longer than a sequence enters as pieces of a whole sequence each and one remainder. What finds no room
whole is cut, and its pieces go to the sequence that costs least among those with any room, so that every piece
is placed by cost. Every window of documents fills its sequences to the last token, and what a window has over
moves on to the next, so only the end of a partition has a tail; that is laid out in sequences whose lengths are
powers of two, which need no padding.

Packing is local to a partition: documents meet in windows of bounded size, nothing is shuffled, and no task
depends on another. Costs are even within a window; windows of one corpus resemble each other, but nothing evens
them out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_library
from .common import column_of

#: Sequences of one window, and rows of an Arrow batch that a task hands back.
WINDOW, ROWS = 256, 16_384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_ARROW = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in SCHEMA.split(", ")])


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens), ids being little-endian unsigned 32-bit integers."""

    def __init__(self, capacity: int, quadratic: float, first: int):
        self.capacity, self.quadratic, self.next = capacity, quadratic, first
        self.rows: list[tuple] = []

    def cost(self, n: int) -> float:
        return n + n * n / self.quadratic

    def pieces(self, doc: int | None, ids: bytes) -> list[tuple]:
        """A document cut where it exceeds a sequence."""
        step = 4 * self.capacity
        return [(doc, at // 4, ids[at : at + step], len(ids) // 4) for at in range(0, len(ids), step)]

    def pack(self, items: list[tuple], sizes: list[int]) -> list[tuple]:
        """Fill sequences of the given sizes; returns the pieces that are left when all are full."""
        room, first = np.array(sizes, np.int64), self.next
        costs = np.zeros(len(sizes))
        self.next += len(sizes)
        full = room.copy()

        def put(item: tuple, at: int) -> tuple:
            doc, start, ids, total = item
            n = min(len(ids) // 4, int(room[at]))
            self.rows.append((doc, start, n, zlib.crc32(ids[: 4 * n]), total, first + at, int(full[at] - room[at]), self.cost(n)))
            room[at] -= n
            costs[at] += self.cost(n)
            return doc, start + n, ids[4 * n :], total

        def cheapest(least: int) -> int | None:
            fits = np.flatnonzero(room >= least)
            return int(fits[np.argmin(costs[fits])]) if len(fits) else None

        rest = []
        for item in sorted(items, key=lambda x: (-len(x[2]), x[0] is None, x[0] or 0, x[1])):
            at = cheapest(len(item[2]) // 4)
            if at is None:
                rest.append(item)
            else:
                put(item, at)
        over = []
        for item in rest:
            while item[2] and (at := cheapest(1)) is not None:
                item = put(item, at)
            if item[2]:
                over.append(item)
        return over

    def take(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.rows), ROWS):
            columns = zip(*self.rows[at : at + ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
        self.rows = []


def pack_documents(docs: DataFrame, encode: Callable[[Iterable[str | None]], Iterator[bytes]] | str, end_id: int = 2, capacity: int = 4096, quadratic: float = 4096.0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (tokens of its document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (gapless from 0 in a sequence), cost. encode: a tokenizer file, or a function
    from texts to the ids of each as little-endian unsigned 32-bit bytes.

    Every document gets end_id at its end, so a null or empty text is one token. Repeated rows and null ids are
    packed like others; ties in length go by id. No sequence holds more than `capacity` tokens; all hold exactly that
    many, but for the last of a partition, whose lengths are powers of two. A sequence_id is unique, not dense. An
    empty table gives no rows."""
    stop = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load_library(encode) if isinstance(encode, str) else None
        ids_of = library.encode_all if library else encode
        packer = Packer(capacity, quadratic, TaskContext.get().partitionId() << 40)
        items: list[tuple] = []
        waiting = 0
        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of(column_of([b], "text"))):
                for piece in packer.pieces(doc, ids + stop):
                    items.append(piece)
                    waiting += len(piece[2]) // 4
                    if waiting >= window * capacity:
                        items = packer.pack(items, [capacity] * window)
                        waiting = sum(len(x[2]) // 4 for x in items)
                if len(packer.rows) >= ROWS:
                    yield from packer.take()
        items = packer.pack(items, [capacity] * (waiting // capacity))
        tail = sum(len(x[2]) // 4 for x in items)
        packer.pack(items, [1 << k for k in reversed(range(tail.bit_length())) if tail >> k & 1])
        yield from packer.take()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)
