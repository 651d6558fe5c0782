"""Substring dedup by line hashing.

A text is cut into units: its lines, and within a line the stretches that end a sentence or start with a capital, so
that a passage that was pasted into the middle of a line is a run of whole units too. A line that is all short units,
such as a navigation bar, is a unit as a whole besides. Units are normalised (lower
case, white space to one space) and digested to 128 bits. Digests are grouped over the whole corpus: the occurrence
in the document with the lowest id, and there the first one, is kept, and every other one is a repeat. Repeats that
stand side by side form a run, and runs of at least MIN_WORDS words are removed, as long as they hold a unit that is more
than a few words; what is shorter may well be chance, and stays (min_words=1, longest=1 removes every repeated unit).
Scripts without spaces count by characters. Offsets are those of the original text.

Grouping is a partial aggregation per digest, so a line that a third of all documents share is one row per task
before anything moves. Only digests of two documents or more are joined back, and hot ones are dealt over sub-keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, column_of, cut, join_hot

#: Words that a run of repeats needs to be removed, and that its longest unit needs.
MIN_WORDS, LONGEST = 20, 4
_STOP = regex.compile(r"[.!?]+(?=\s)|(?<=\s)(?=\p{Lu}\p{Ll})")
#: Letters of scripts without spaces, and how many of them, or of any characters in a row, count for a word at least.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
LETTERS, CHARS = 2, 16
_BATCH = 16_384


def _unit(text: str, start: int, stop: int, parts: list[str]) -> tuple[int, int, int, bytes]:
    plain = " ".join(parts)
    words = max(len(parts), len(plain) // CHARS)
    if not plain.isascii():
        words = max(words, len(_UNSPACED.findall(plain)) // LETTERS)
    return start, stop, words, xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass"))


def lines(text: str | None, longest: int = LONGEST) -> Iterator[tuple[list[tuple[int, int, int, bytes]], tuple[int, int, int, bytes] | None]]:
    """Of each line that has a word: its units, and where there are several and none has `longest` words, the whole line
    as one unit. A line of longer units needs none: where it is repeated, so are they."""
    text = text or ""
    at = 0
    for line in text.split("\n"):
        start, end = at, at + len(line)
        fine = []
        for stop in (*(m.end() for m in _STOP.finditer(text, at, end)), end):
            if parts := text[start:stop].lower().split():
                fine.append(_unit(text, start, stop, parts))
                start = stop
        if fine:
            short = len(fine) > 1 and max(u[2] for u in fine) < longest
            yield fine, _unit(text, fine[0][0], fine[-1][1], text[fine[0][0] : fine[-1][1]].lower().split()) if short else None
        at = end + 1


def units(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, stop, words, digest) of each unit that has a word, in order, without the whole lines."""
    for fine, _ in lines(text):
        yield from fine


def numbered(text: str | None, longest: int = LONGEST) -> Iterator[tuple[int, bytes]]:
    """(number, digest) of each unit; a whole line has the number ~n, n being that of its first unit."""
    no = 0
    for fine, whole in lines(text, longest):
        if whole:
            yield ~no, whole[3]
        for u in fine:
            yield no, u[3]
            no += 1


def removals(text: str | None, elsewhere: dict[int, int], own: int | None, min_words: int, longest: int) -> list[tuple[int, int, int, int | None, list[int | None]]]:
    """(start, stop, words, first_doc_id, keepers) of the runs to remove; keepers are the documents that keep one of
    the run's units, and first_doc_id is that of its first. elsewhere: unit number -> the document that keeps
    the unit; units that repeat one of the same text are found here."""
    seen: set[bytes] = set()
    runs: list[list] = []
    no, before = 0, -1
    for fine, whole in lines(text, longest):
        # a line that is repeated as a whole is one unit, another one its parts
        line = whole and (~no in elsewhere or whole[3] in seen)
        for at, (start, stop, words, digest) in [(~no, whole)] if line else enumerate(fine, no):
            first = elsewhere.get(at)
            if first is not None or digest in seen:
                keeper = own if first is None else first
                if before == (no if line else at):
                    runs[-1][1], runs[-1][2], runs[-1][3] = stop, runs[-1][2] + words, max(runs[-1][3], words)
                    runs[-1][4].append(keeper)
                else:
                    runs.append([start, stop, words, words, [keeper]])
                before = no + len(fine) if line else at + 1
            seen.add(digest)
        seen.update(u[3] for u in (*fine, *([whole] if whole else [])))
        no += len(fine)
    return [(a, b, n, who[0], list(dict.fromkeys(who))) for a, b, n, most, who in runs if n >= min_words and most >= longest]


def without(text: str, gone: list[tuple]) -> str:
    """text less the stretches; a line that goes whole takes its line end with it."""
    out, at = [], 0
    for start, stop, *_ in gone:
        out.append(text[at:start])
        whole = (start == 0 or text[start - 1] == "\n") and text[stop : stop + 1] == "\n"
        at = stop + whole
    return "".join([*out, text[at:]])


def shared_units(slim: DataFrame, longest: int = LONGEST, hot: int = HOT) -> DataFrame:
    """slim: (id, mark, text), mark telling the texts of one id apart. (id, mark, shared array<long>): number and keeper
    of each unit that a document with a lower id has too, one after the other."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for doc, mark, text in zip(b.column("id").to_pylist(), b.column("mark").to_pylist(), column_of([b], "text")):
                met: set[bytes] = set()
                for no, digest in numbered(text, longest):
                    if digest not in met:
                        met.add(digest)
                        out.append((doc, mark, no, digest))
                        if len(out) >= _BATCH:
                            yield flat(out)
                            out = []
        if out:
            yield flat(out)

    def flat(out: list[tuple]) -> pa.RecordBatch:
        doc, mark, no, digests = zip(*out)
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(no, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["id", "mark", "no", "h", "l"])

    rows = slim.filter("id IS NOT NULL").mapInArrow(cut_up, "id long, mark long, no int, h long, l long")
    first = cut(rows.groupBy("h", "l").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).filter("first <> last").select("h", "l", "first", "n"))
    total = first.agg(F.sum("n")).first()[0] or 0
    again = join_hot(rows, first, ["h", "l"], "id", total, hot=hot).filter("id <> first")
    return again.groupBy("id", "mark").agg(F.flatten(F.collect_set(F.array(F.col("no").cast("long"), "first"))).alias("shared"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed", hot: int = HOT) -> DataFrame:
    """docs with text_col less its repeats, and removed_col: array of (start, stop, words, first_doc_id, keepers), in code
    points of the original text.

    Null and empty texts have no units and come back as they are. Rows that share an id rank as one document: they
    are no repeats of each other, and each is cut by its own text. Rows with a null id are neither keepers nor compared
    with other documents; only what they repeat themselves goes. Repeated rows come back alike. An empty table gives no
    rows. Columns of any name pass through, but for one named like removed_col, which is replaced."""

    @F.pandas_udf("text string, removed array<struct<start:int,stop:int,words:int,first_doc_id:long,keepers:array<long>>>")
    def apply(ids: pd.Series, texts: pd.Series, shared: pd.Series) -> pd.DataFrame:
        out = []
        for doc, text, s in zip(ids, texts, shared):
            where = {} if s is None else dict(zip(s[::2].tolist(), s[1::2].tolist()))
            gone = removals(text, where, None if pd.isna(doc) else int(doc), min_words, longest)
            out.append((without(text, gone) if gone else text, [dict(zip(("start", "stop", "words", "first_doc_id", "keepers"), g)) for g in gone]))
        return pd.DataFrame(out, columns=["text", "removed"])

    body = F.col(text_col).cast("string")
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"), body.alias("body"), F.xxhash64(body).alias("its"))
    found = shared_units(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("mark"), body.alias("text")), longest, hot)
    joined = whole.join(found, (F.col("own") == F.col("id")) & (F.col("its") == F.col("mark")), "left")
    done = joined.select("row", apply("own", "body", "shared").alias("done"))
    return done.select(*(F.col("done.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != removed_col), F.col("done.removed").alias(removed_col))
