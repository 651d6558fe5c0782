"""Token counts by distinct pre-token.

Pieces are counted once for each distinct pre-token, joined to the documents' pre-token frequencies and summed;
ids are never built. The pre-tokens that most documents have would be hot join keys, so a bounded list of the
most frequent ones goes to the readers as a broadcast, and their share of a document's sum never leaves the
task that reads it. The long tail of rare pre-tokens is joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import column_of, cut

#: Most pre-tokens that are broadcast, and the most bytes one of them may have; longer ones are known by a digest.
COMMON, KEY_BYTES = 200_000, 32
#: Distinct pre-tokens of a task before it hands them on, and rows handed on at once.
_FLUSH, _ROWS = 200_000, 1 << 15
#: Fixed: the split that byte-level BPE files with use_regex name.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def key_of(token: bytes) -> bytes:
    """What a pre-token is joined by: itself, or a digest behind 0xfe, which is in no UTF-8 text, where it is long."""
    return token if len(token) <= KEY_BYTES else b"\xfe" + xxhash.xxh3_128_digest(token)


class Counting:
    """Pre-tokens of a text, and the number of pieces of one."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.word = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def frequencies(self, text: str | None) -> tuple[Counter, int]:
        """Pre-tokens of the whole text, and its number of added tokens, which stand for themselves."""
        words: Counter = Counter()
        found, at = 0, 0
        for m in self.special.finditer(text or "") if self.special else ():
            self._add(words, text[at : m.start()])
            found, at = found + 1, m.end()
        self._add(words, (text or "")[at:])
        return words, found

    def _add(self, words: Counter, part: str) -> None:
        if len(part) < 1 << 20:
            words.update(self.word.findall(part))
        else:
            words.update(m[0] for m in self.word.finditer(part))

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def counting(path: str) -> Counting:
    return Counting(path)


def distinct_pieces(slim: DataFrame, path: str) -> DataFrame:
    """(token binary, documents long, pieces int): each distinct pre-token by its key, once."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = counting(path), Counter()
        for text in column_of(batches, "text"):
            seen.update(split.frequencies(text)[0].keys())
            if len(seen) > _FLUSH:
                yield from flat(seen)
                seen.clear()
        yield from flat(seen)

    def flat(seen: Counter) -> Iterator[pa.RecordBatch]:
        words, n = list(seen), list(seen.values())
        for at in range(0, len(words), _ROWS):
            part = pa.array([w.encode() for w in words[at : at + _ROWS]], pa.binary())
            yield pa.RecordBatch.from_arrays([part, pa.array(n[at : at + _ROWS], pa.int64())], ["token", "documents"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = counting(path)
        for b in batches:
            words = b.column("token").to_pylist()
            pieces = split.pieces([t.decode() for t in words])
            yield pa.RecordBatch.from_arrays([pa.array(list(map(key_of, words)), pa.binary()), b.column("documents"), pa.array(pieces, pa.int32())], ["token", "documents", "pieces"])

    found = slim.select("text").mapInArrow(tokens, "token binary, documents long")
    return found.groupBy("token").agg(F.sum("documents").alias("documents")).mapInArrow(count, "token binary, documents long, pieces int")


def common_pieces(pieces: DataFrame, most: int = COMMON) -> dict[bytes, int]:
    """The pre-tokens in most documents, at most `most` of them: the lowest bar that so many pass is read off a
    histogram, so nothing is sorted."""
    bars = pieces.groupBy(F.least(F.floor(F.log2("documents") * 8), F.lit(400)).cast("int").alias("bar")).count().collect()
    at, total = 401, 0
    for bar, n in sorted(((r[0], r[1]) for r in bars), reverse=True):
        if (total := total + n) > most:
            break
        at = bar
    rows = pieces.filter(F.least(F.floor(F.log2("documents") * 8), F.lit(400)) >= at).select("token", "pieces").toArrow()
    return dict(zip(rows["token"].to_pylist(), rows["pieces"].to_pylist()))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has no bytes and no tokens. Rows that repeat both id and text are summed together and
    parted again, so each keeps its own count; null ids stay null; an empty table gives no rows."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(distinct_pieces(slim, path))
    known = docs.sparkSession.sparkContext.broadcast(common_pieces(pieces, common))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, often = counting(path), known.value
        out: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), column_of([b], "text")):
                raw = (text or "").encode()
                mark = xxhash.xxh3_128_digest(raw)
                words, total = split.frequencies(text)
                for w, n in words.items():
                    token = key_of(w.encode())
                    if (p := often.get(token)) is not None:
                        total += n * p
                    else:
                        out.append((doc, mark, None, token, n))
                # 0xff is in no UTF-8 text: this key meets no pre-token, and is another one for each document
                out.append((doc, mark, len(raw), b"\xff" + mark, total))
                if len(out) > _ROWS:
                    yield flat(out)
                    out = []
        if out:
            yield flat(out)

    def flat(out: list[tuple]) -> pa.RecordBatch:
        kinds = pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "mark", "n_bytes", "token", "n"])

    freq = slim.mapInArrow(rows, "id long, mark binary, n_bytes long, token binary, n long")
    # the row with n_bytes holds what is summed already; any other one has a partner, or a join went wrong
    each_of = F.when(F.col("n_bytes").isNotNull(), F.lit(1)).otherwise(F.coalesce("pieces", F.raise_error(F.lit("a pre-token was not counted")).cast("int")))
    summed = freq.join(pieces.select("token", "pieces"), "token", "left").groupBy("id", "mark").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * each_of).alias("all"), F.count("n_bytes").alias("rows"))
    each = summed.select("id", "n_bytes", F.expr("all div rows").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_"))
    return each.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
