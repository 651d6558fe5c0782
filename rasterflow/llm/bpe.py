"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can never end up in one token,
so every place where such a pair meets is a certain cut. A word is cut there, its fragments are encoded each on
its own, and their ids follow one another; no merge could have crossed a cut, so the ids are those of the whole.
Fragments are short even where words are not, which keeps the merge loop small. Fragments of one length are the rows
of a matrix and take their merges together, each its own lowest at every step.

The tokenizer file is a parameter; it is read, never copied or trained. What is supported is what word-level
BPE files of this kind hold: NFC, white space to one space, lower case, a split by pattern, byte symbols, an end
of word suffix, and added tokens that are looked for in the raw text.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import column_of

#: Chunks or words of one generation of a memo, the longest that is kept, and chunks of one of the library's memo.
MEMO, MEMO_CHARS, LIBRARY_MEMO = 300_000, 48, 600_000
#: Symbols up to which a plain scan for the lowest rank beats a queue, and fragments of one length from which a matrix beats both.
_SHORT, _MANY = 40, 16
_PIECE = 1 << 20
_WHITE = regex.compile(r"\p{White_Space}+")
_ODD = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next
    free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def text_pieces(text: str) -> Iterator[str]:
    """text in order, in pieces of about a million characters that end at white space."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            stop = _WHITE.search(text, end)
            end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end


def chunks_of(piece: str) -> list[str]:
    """Runs without white space; str.split() also cuts at four control characters that are no white space."""
    return [c for c in _WHITE.split(piece) if c] if _ODD.search(piece) else piece.split()


class Memo(dict):
    """key -> ids as bytes. Of two generations, so that its size is bounded and what is in use outlives a new one."""

    def __init__(self, encode, most: int = MEMO):
        super().__init__()
        self.encode, self.most = encode, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.turn()
            self[key] = ids
        return ids

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def lacks(self, keys: set[str]) -> list[str]:
        """Those that neither generation holds; what the old one holds moves to the new one. A full one is turned first."""
        if len(self) >= self.most:
            self.turn()
        lost = []
        for key in keys.difference(self):
            if (ids := self.old.get(key)) is None:
                lost.append(key)
            else:
                self[key] = ids
        return lost

    def forget(self) -> None:
        self.clear()
        self.old = {}


class SplitBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.symbol = byte_symbols()
        byte_of = {s: b for b, s in enumerate(self.symbol)}
        self.apart = {(a, b) for a in range(256) for b in range(256)}
        for token in self.vocab:
            raw = [byte_of[c] for c in token.removesuffix(self.suffix)]
            self.apart.difference_update(zip(raw, raw[1:]))
        size = 1 + max([*self.vocab.values(), *self.added.values()])
        self.tokens = [""] * size
        for token, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        self.cuts = np.zeros((256, 256), bool)
        self.cuts[tuple(np.array([*self.apart], np.intp).reshape(-1, 2).T)] = True
        # byte -> its symbol's id within a word and at its end; pairs of ids, sorted, with their ranks; rank -> what it makes
        self.first, self.last = (np.array([self.vocab.get(c + end, -1) for c in self.symbol]) for end in ("", self.suffix))
        made = sorted((self.vocab[a] << 32 | self.vocab[b], r) for (a, b), r in self.ranks.items())
        self.pairs, self.pair_ranks = np.array([*made, (1 << 62, len(made))], np.int64).T.copy()
        self.made = np.array([self.vocab[a + b] for a, b in self.ranks], np.int64)
        # a chunk is a word and the signs that stand at it: many chunks have a word in common
        self.memo, self.words = Memo(self.encode_chunk), Memo(self.encode_word)

    def fragments(self, word: bytes) -> list[bytes]:
        apart = self.apart
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair in apart]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def merge(self, parts: list[str]) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost among equals, until no pair of the list is left."""
        if len(parts) > _SHORT:
            return self.merge_long(parts)
        ranks, never = self.ranks.get, len(self.ranks)
        of = [ranks(pair, never) for pair in zip(parts, parts[1:])]
        while of and (low := min(of)) < never:
            i = of.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del of[i]
            if i:
                of[i - 1] = ranks((parts[i - 1], parts[i]), never)
            if i < len(of):
                of[i] = ranks((parts[i], parts[i + 1]), never)
        return [self.vocab[p] for p in parts]

    def merge_long(self, parts: list[str]) -> list[int]:
        """The same with a queue, for fragments of any length."""
        n = len(parts)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = left + right, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (r, a, parts[a], parts[b]))
        return [self.vocab[parts[i]] for i in range(n) if alive[i]]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], len(self.ranks))

    def merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """merge() for rows of symbols of one length: numbers of rows that are done at the same step, and their ids."""
        never, rows = len(self.ranks), np.arange(len(ids))
        ranks = self.ranks_of(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), at]
            if not (on := low < never).all():
                yield rows[~on], ids[~on]
                rows, ids, ranks, at, low = rows[on], ids[on], ranks[on], at[on], low[on]
                if not len(rows):
                    return
            every = np.arange(len(rows))
            ids[every, at] = self.made[low]
            kept = np.ones(ids.shape, bool)
            kept[every, at + 1] = False
            ids = ids[kept].reshape(len(rows), -1)
            kept = np.ones(ranks.shape, bool)
            kept[every, at] = False
            ranks = ranks[kept].reshape(len(rows), -1)
            for row, k in ((every[at > 0], at[at > 0] - 1), (every[at < ranks.shape[1]], at[at < ranks.shape[1]])):
                ranks[row, k] = self.ranks_of(ids[row, k], ids[row, k + 1])
        yield rows, ids

    def encode_words(self, words: list[str]) -> list[bytes]:
        """encode_word() of each, with fragments of one length merged together."""
        if len(words) < _MANY:
            return [self.encode_word(w) for w in words]
        raw = [w.encode() for w in words]
        ends = np.cumsum([*map(len, raw)])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        cut = np.ones(len(flat), bool)
        cut[1:] = self.cuts[flat[:-1], flat[1:]]
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(flat))
        ids = self.first[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        if (ids < 0).any():
            raise KeyError("a byte that is no token")
        done, sizes, tokens = [], np.zeros(len(starts), np.int64), self.tokens
        for n in np.flatnonzero(np.bincount(lengths)).tolist():
            group = np.flatnonzero(lengths == n)
            if n <= _SHORT and len(group) >= _MANY:
                done += ((group[rows], x) for rows, x in self.merge_rows(ids[starts[group][:, None] + np.arange(n)]))
            else:
                done += ((np.array([g]), np.array([self.merge([tokens[i] for i in ids[a : a + n].tolist()])])) for g, a in zip(group.tolist(), starts[group].tolist()))
        for group, x in done:
            sizes[group] = x.shape[1]
        stops = np.cumsum(sizes)
        out = np.empty(stops[-1], "<u4")
        for group, x in done:
            out[(stops - sizes)[group][:, None] + np.arange(x.shape[1])] = x
        whole, at = out.tobytes(), (4 * stops[np.searchsorted(starts, ends) - 1]).tolist()
        return [whole[a:b] for a, b in zip([0, *at], at)]

    def parted(self, chunks: list[str]) -> list[list[str]]:
        """The words of each chunk, none of which holds an added token. The pattern goes over all of them at once, and over each where it
        does not take every character and no space, as then its matches do not say where a chunk ends."""
        plain = [c.lower() if c.isascii() else self.plain(c) for c in chunks]
        words = self.word.findall(" ".join(plain))
        if "".join(words) != "".join(plain):
            return [*map(self.word.findall, plain)]
        at = (np.searchsorted(np.cumsum([*map(len, words)]), np.cumsum([*map(len, plain)])) + 1).tolist()
        return [words[a:b] for a, b in zip([0, *at], at)]

    def learn(self, chunks: set[str]) -> tuple[list[str], list[str]]:
        """Puts the chunks into the memo, their words together; returns the chunks and words that are too long to stay there."""
        memo, known = self.memo, self.words
        new = memo.lacks(chunks)
        if not new:
            return [], []
        whole = " ".join(new)
        if found := [t for t in self.added if t in whole]:
            rare = {c for c in new if any(t in c for t in found)}
            memo.update((c, self.encode_chunk(c)) for c in rare)
            new = [c for c in new if c not in rare]
        parts = self.parted(new) if new else []
        lost = known.lacks({w for words in parts for w in words})
        known.update(zip(lost, self.encode_words(lost)))
        for c, words in zip(new, parts):
            memo[c] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        return [c for c in chunks if len(c) > MEMO_CHARS], [w for w in lost if len(w) > MEMO_CHARS]

    def forget(self) -> None:
        self.memo.forget()
        self.words.forget()

    def encode_word(self, word: str) -> bytes:
        ids: list[int] = []
        pieces, symbol = self.fragments(word.encode()), self.symbol
        for k, piece in enumerate(pieces, 1):
            parts = [symbol[b] for b in piece]
            if k == len(pieces):
                parts[-1] += self.suffix
            ids += self.merge(parts)
        return array("I", ids).tobytes()

    def plain(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letters count one by one
        return text.lower()

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.word.findall(self.plain(text))))

    def encode_chunk(self, chunk: str) -> bytes:
        parts, at = [], 0
        for m in self.special.finditer(chunk) if self.special else ():
            parts += self.encode_plain(chunk[at : m.start()]), array("I", [self.added[m[0]]]).tobytes()
            at = m.end()
        return b"".join([*parts, self.encode_plain(chunk[at:])])

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of a whole text as little-endian unsigned 32-bit integers, in pieces of bounded size."""
        for piece in text_pieces(text or ""):
            yield from self._group([chunks_of(piece)])

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[Iterable[bytes]]:
        """encode() of each text, to be read in order; what texts of some two million characters have in common is encoded once."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            if text and len(text) > _PIECE:
                yield from ([ids] for ids in self._group(group))
                group, size = [], 0
                yield self.encode(text)
            else:
                group.append(chunks_of(text or ""))
                size += len(text or "")
                if size > 2 * _PIECE:
                    yield from ([ids] for ids in self._group(group))
                    group, size = [], 0
        yield from ([ids] for ids in self._group(group))

    def _group(self, group: list[list[str]]) -> Iterator[bytes]:
        # nothing made here refers back to itself, and the collector would walk through all of it time and again
        pause = gc.isenabled()
        gc.disable()
        try:
            chunks, words = self.learn(set().union(*group))
        finally:
            if pause:
                gc.enable()
        for c in group:
            yield b"".join(map(self.memo.__getitem__, c))
        for c in chunks:
            self.memo.pop(c, None)
        for w in words:
            self.words.pop(w, None)

    def decode(self, ids: bytes) -> str:
        """Tokens as they stand in the vocabulary, with spaces between: what a file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def simple(chunk: str) -> tuple[str, str] | None:
    """A chunk of letters with at most one sign behind them, as the word, in lower case where it is ASCII, and the sign.
    Letters and signs never share a token, so the ids are those of the one and then of the other; a letter that comes apart into
    one and a mark, composed or in lower case, is none here, as its mark would stand by the sign."""
    word, sign = (chunk, "") if chunk.isalpha() else (chunk[:-1], chunk[-1])
    if sign and not (sign in ".,;:!?" and word.isalpha()):
        return None
    if word.isascii():
        return word.lower(), sign
    return (word, sign) if unicodedata.normalize("NFC", word).lower().isalpha() else None


class LibraryEncoder:
    """Whole texts through the tokenizers library, which sees a distinct chunk once as long as a memo holds it. White
    space always ends a word, so the ids of a text are those of its chunks one after the other. The memo has two
    generations of LIBRARY_MEMO chunks of at most MEMO_CHARS characters, some 400 MB at worst. It serves all tasks of a worker,
    as most chunks of the next one are in it already, and goes with the worker, which Spark ends when it is idle."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would also keep memory each
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> list[str]:
        """Puts the chunks into the memo; returns those that are too long to stay there."""
        if len(self.memo) > LIBRARY_MEMO:
            self.memo, self.old = {}, self.memo
        new = []
        known, old, made = self.memo, self.old, []
        for c in chunks.difference(known):
            if (ids := old.get(c)) is not None:
                known[c] = ids
            elif (part := simple(c)) is None:
                new.append(c)
            else:
                made.append((c, *part))
        # a word is encoded once, whatever signs and capitals it comes with
        new += {s for _, _, s in made if s}.difference(known)
        words = []
        for w in {w for _, w, _ in made}.difference(known):
            if (ids := old.get(w)) is not None:
                known[w] = ids
            else:
                words.append(w)
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            found = self.together(part)
            if found is None:
                new += part
            else:
                known.update(zip(part, found))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            known.update((c, array("I", e.ids).tobytes()) for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)))
        for c, w, s in made:
            known[c] = known[w] + known[s] if s else known[w]
        return [c for c in {*chunks, *words} if len(c) > MEMO_CHARS]

    def together(self, words: list[str]) -> list[bytes] | None:
        """The ids of words of letters, as one text, which costs half of what they do one by one. Each word ends with a token that has
        the suffix; None where there are more of those than words, as a library may part a word that Python does not."""
        (e,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return None
        raw, at = ids.tobytes(), (4 * stops).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            if text and len(text) > _PIECE:
                yield from self._group(group)
                group, size = [], 0
                yield b"".join(x for piece in text_pieces(text) for x in self._group([chunks_of(piece)]))
            else:
                group.append(chunks_of(text or ""))
                size += len(text or "")
                if size > 2 * _PIECE:
                    yield from self._group(group)
                    group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[bytes]:
        # nothing made here refers back to itself, and the collector would walk through all of it time and again
        pause = gc.isenabled()
        gc.disable()
        try:
            long = self.learn(set().union(*group))
        finally:
            if pause:
                gc.enable()
        for chunks in group:
            yield b"".join(map(self.memo.__getitem__, chunks))
        for c in long:
            del self.memo[c]


@lru_cache(maxsize=2)
def load(path: str) -> SplitBPE:
    return SplitBPE(path)


@lru_cache(maxsize=2)
def load_library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array<int>): the encoding of each whole text; a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [np.frombuffer(b"".join(ids), "<u4").astype(np.int32) for ids in bpe.encode_all(b["text"])]})
        bpe.forget()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, text: ids (array<int>) back as text; null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [bpe.decode(np.asarray(() if x is None else x, "<u4").tobytes()) for x in b["ids"]]})

    return encoded.select(F.col(id_col).cast("long").alias("id"), "ids").mapInPandas(run, "id long, text string").withColumnRenamed("id", id_col)


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_sha256, decoded_sha256, without holding the ids of more than
    a piece of a text at once. A null or empty text has no tokens; repeated rows stay rows of their own, null ids stay null.
    Further columns are left out, whatever their names; an empty table gives no rows."""

    def digest(bpe: SplitBPE, pieces: Iterable[bytes]) -> tuple[int, str, str]:
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for piece in pieces:
            if piece:
                back.update((" " * bool(n) + bpe.decode(piece)).encode())
                ids.update(piece)
                n += len(piece) // 4
        return n, ids.hexdigest(), back.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            if b.num_rows:
                n, ids, back = zip(*(digest(bpe, pieces) for pieces in bpe.encode_all(column_of([b], "text"))))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
