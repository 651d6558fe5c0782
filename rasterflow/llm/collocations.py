"""Phrase collocations, mined by pivot partitioning as MG-FSM does.

Texts are cut into pieces, pieces into words. An n-gram belongs to its rarest word, its pivot; of equal words the first
one counts. So each occurrence of a word routes a rewritten fragment to the partition of that word: what stands around it,
up to the longest phrase's reach, as far as no word is rarer (to the left none as rare either), and cut at words that
are too rare to be in any frequent phrase. A partition mines its pivots one after the other and emits the n-grams that
they own, so every occurrence of an n-gram is counted in exactly one place, and nothing needs a second count.

How rare a word is comes from a table of fixed size, broadcast: counts of all words, by hash. Words that share a slot
seem more frequent than they are, which costs work and no result, since any order that all tasks agree on will do. Equal
fragments of a task are one row with a count before they are shuffled. Pivots with a large part of all words are dealt
over sub-keys by fragment, and their counts are summed once more.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT, SALT, cut, join_hot

#: Slots of the table of word counts; words of one flush, distinct words that it knows at most, and rows handed back at once.
SLOTS, FLUSH_WORDS, FLUSH_VOCABULARY, _ROWS = 1 << 22, 1 << 20, 200_000, 1 << 15
#: Tasks' shares of a language's list before its first rows are taken.
TOP_SALT = 64
#: Where pieces end; 0xff is in no UTF-8 text.
END = b"\xff"
_FLAT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a whole text with A-Z in lower case; END wherever a piece ends."""
    return text.translate(_FLAT).replace(END, b" \xff ").split() if text else []


def slot(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(b"\t".join((lang, word)), 42)


def word_counts(slim: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                met[lang].update(tokens(text.as_py()))
                if sum(map(len, met.values())) > FLUSH_VOCABULARY:
                    yield from flat(met)
                    met.clear()
        yield from flat(met)

    def flat(met: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in met.items():
            words.pop(END, None)
            keys, n = list(words), list(words.values())
            for at in range(0, len(keys), _ROWS):
                part = keys[at : at + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array(n[at : at + _ROWS], pa.int64())], ["lang", "word", "n"])

    return slim.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """word -> code for one language; what is new gets the next code of all languages."""

    def __init__(self, lang: bytes, words: list[bytes], hashes: list[int]):
        super().__init__({END: 0})
        self.lang, self.words, self.hashes = lang, words, hashes

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(slot(self.lang, word))
        return code


def extents(rare: np.ndarray, never: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left of each are less rare, and to the right no rarer, without a gap and `reach` at most.
    rare: a rank per word; `never` is that of what ends a fragment."""
    n = len(rare)
    wide = np.concatenate([np.full(reach, never), rare, np.full(reach, never)])
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for out, side in ((left, -1), (right, 1)):
        alive = rare < never
        for k in range(1, reach + 1):
            other = wide[reach + side * k : reach + side * k + n]
            alive = alive & (other < rare if side < 0 else other <= rare)
            out += alive
    return left, right


class Fragments:
    """The fragments of some texts, equal ones together."""

    def __init__(self, often: np.ndarray, least: int, longest: int, hot_from: float):
        self.often, self.least, self.reach, self.hot_from = often, least, longest - 1, hot_from
        self.clear()

    def clear(self) -> None:
        self.words, self.hashes = [END], [0]
        self.of: dict[str, Vocabulary] = {}
        self.codes: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.langs: list[tuple[str, int]] = []
        self.size = 1

    def add(self, lang: str, text: bytes | None) -> bool:
        """Takes in a text; says if it is time to flush."""
        words = tokens(text)
        if words:
            v = self.of.get(lang)
            if v is None:
                v = self.of[lang] = Vocabulary(lang.encode(), self.words, self.hashes)
            self.codes += np.fromiter(map(v.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)
            self.langs.append((lang, len(words) + 1))
            self.size += len(words) + 1
        return self.size > FLUSH_WORDS or len(self.words) > FLUSH_VOCABULARY

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(key, hot, lang, at, fragment, n): at is the pivot's place in the fragment."""
        code = np.concatenate(self.codes)
        hashes = np.array(self.hashes, np.uint64)
        n = self.often[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((hashes, -n))] = np.arange(len(n))
        never = len(n)
        rank[n < self.least] = never
        rank[0] = never
        rare = rank[code]
        left, right = extents(rare, never, self.reach)
        at = np.flatnonzero(left + right)
        if not len(at):
            return
        where = np.arange(-self.reach, self.reach + 1)
        inside = (where >= -left[at, None]) & (where <= right[at, None])
        window = np.where(inside, code[np.clip(at[:, None] + where, 0, len(code) - 1)], -1)
        mixed = np.zeros(len(at), np.uint64)
        for column in window.T:
            mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        # equal windows are neighbours; should others stand between them, they are merely not put together
        order = np.argsort(mixed, kind="stable")
        sorted_windows = window[order]
        first = np.flatnonzero(np.r_[True, (sorted_windows[1:] != sorted_windows[:-1]).any(1)])
        times = np.diff(np.r_[first, len(order)])
        at, mixed = at[order[first]], mixed[order[first]]
        hot = n[code[at]] > self.hot_from
        key = hashes[code[at]] ^ np.where(hot, (mixed % np.uint64(SALT) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), np.uint64(0))
        ends = np.cumsum([x for _, x in self.langs])
        lang = np.searchsorted(ends, at - 1, side="right")
        names, word = [x for x, _ in self.langs], self.words
        for s in range(0, len(at), _ROWS):
            part = slice(s, s + _ROWS)
            spans = zip((at[part] - left[at[part]]).tolist(), (at[part] + right[at[part]] + 1).tolist())
            texts = [b" ".join([word[c] for c in code[a:b].tolist()]) for a, b in spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[part].view(np.int64)), pa.array(hot[part]), pa.array([names[i] for i in lang[part].tolist()], pa.string()), pa.array(left[at[part]]), pa.array(texts, pa.binary()), pa.array(times[part])],
                ["key", "hot", "lang", "at", "fragment", "n"])


def owned(rows: pa.Table, least: int, longest: int) -> list[tuple[str, bytes, int, bool]]:
    """(lang, n-gram, count, partial) of the n-grams of 2 to `longest` words that the pivots of some fragments own; rows are sorted
    by key, hot and lang, and hold all of a pivot's. Counts under `least` are left out, but where they are partial, and so is
    what can't reach it: an n-gram is at most as frequent as its pivot with the word beside it."""
    key, at, n = (rows.column(c).to_numpy() for c in ("key", "at", "n"))
    partial = np.asarray(rows.column("hot").combine_chunks().cast(pa.int8()))
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    lang = np.asarray(langs.indices)
    group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (partial[1:] != partial[:-1]) | (lang[1:] != lang[:-1])])
    floor = np.where(partial == 1, 1, least)
    split = pc.split_pattern(rows.column("fragment").combine_chunks(), pattern=b" ")
    begin = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    code, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
    place, size = begin[:-1] + at, np.diff(begin)

    def often(has: np.ndarray, step: int) -> np.ndarray:
        """Rows whose pivot stands beside that word often enough."""
        idx = np.flatnonzero(has)
        pairs, which = np.unique(group[idx] * len(words) + code[place[idx] + step], return_inverse=True)
        out = np.zeros(len(has), bool)
        out[idx] = np.bincount(which, n[idx], len(pairs))[which] >= floor[idx]
        return out

    left, right = often(at > 0, -1), often(at + 1 < size, 1)
    live = np.flatnonzero(left | right)
    counts: Counter = Counter()
    of = zip(group[live].tolist(), place[live].tolist(), np.where(left, at, 0)[live].tolist(), np.where(right, size - 1 - at, 0)[live].tolist(), n[live].tolist())
    for g, i, most_left, most_right, times in of:
        w = [words[c] for c in code[i - most_left : i + most_right + 1].tolist()]
        for a in range(most_left + 1):
            for b in range(0 if a else 1, min(most_right, longest - 1 - a) + 1):
                counts[g, b" ".join(w[most_left - a : most_left + b + 1])] += times
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    names = langs.dictionary.to_pylist()
    told = [(names[lang[i]], bool(partial[i]), int(floor[i])) for i in first.tolist()]
    return [(told[g - 1][0], phrase, times, told[g - 1][1]) for (g, phrase), times in counts.items() if times >= told[g - 1][2]]


def phrase_counts(slim: DataFrame, words: DataFrame, least: int, longest: int, hot: int = HOT) -> DataFrame:
    """(lang, phrase, f): all n-grams of 2 to `longest` words with f >= least occurrences."""
    by = words.groupBy(F.xxhash64(F.concat_ws("\t", "lang", F.col("word").cast("string"))).bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.sum("n").alias("n"))
    # SLOTS rows at most, whatever the vocabulary
    found = by.filter(F.col("n") >= least).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[found["slot"].to_numpy()] = found["n"].to_numpy()
    total = int(by.agg(F.sum("n")).first()[0] or 0)
    sent = slim.sparkSession.sparkContext.broadcast(np.minimum(often, (1 << 31) - 1).astype(np.int32))
    hot_from = min(total / hot, float((1 << 31) - 2))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Fragments(sent.value, least, longest, hot_from)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                if held.add(lang, text.as_py()):
                    yield from held.rows()
                    held.clear()
        yield from held.rows()

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so those of a pivot stand together; the last pivot of a batch waits for the next one."""
        held: list[pa.RecordBatch] = []
        waiting = 0
        for b in batches:
            key = b.column("key").to_numpy()
            ends = np.flatnonzero(key[1:] != key[:-1])
            if waiting and len(key) and held[-1].column("key")[-1].as_py() != key[0] and waiting >= _ROWS:
                yield from flat(owned(pa.Table.from_batches(held), least, longest))
                held, waiting = [], 0
            if len(ends) and waiting + ends[-1] + 1 >= _ROWS:
                held.append(b.slice(0, ends[-1] + 1))
                yield from flat(owned(pa.Table.from_batches(held), least, longest))
                held, waiting, b = [], 0, b.slice(ends[-1] + 1)
            held.append(b)
            waiting += len(b)
        if waiting:
            yield from flat(owned(pa.Table.from_batches(held), least, longest))

    def flat(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(out), _ROWS):
            columns = zip(zip(*out[s : s + _ROWS]), (pa.string(), pa.binary(), pa.int64(), pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["lang", "phrase", "f", "partial"])

    fragments = slim.mapInArrow(route, "key long, hot boolean, lang string, at byte, fragment binary, n long")
    mined = fragments.repartition("key").sortWithinPartitions("key", "hot", "lang").mapInArrow(mine, "lang string, phrase binary, f long, partial boolean")
    mined = cut(mined)
    whole = mined.filter("NOT partial").select("lang", "phrase", "f")
    summed = mined.filter("partial").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return whole.union(summed).withColumn("phrase", F.col("phrase").cast("string"))


def _words(phrase: str, start: Column | int, n: Column | int) -> Column:
    """n words of a phrase, from the start-th on, counted from 1."""
    of = F.split(phrase, " ")
    return F.array_join(F.slice(of, start, n), " ")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hot: int = HOT) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: lang, rank (from 1), phrase, a, l, r, n, score.

    a is how often the phrase occurs within pieces (at least `least` times), n the number of the language's words, l and r
    how often the two parts occur into which a cut parts the phrase: the cut of the lowest score counts, where
    score = floor(1000 * a * n / (l * r)), then the earliest. A phrase goes if a longer one that holds it is as frequent. The order
    is by score and a, descending, then by phrase. Null texts have no words; a null language is `und`, as is one of that
    name; repeated rows count each time; ids don't matter; an empty table gives no rows."""
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    words = cut(word_counts(slim))
    phrases = cut(phrase_counts(slim, words, least, longest, hot))
    single = words.filter(F.col("n") >= least).select("lang", F.col("word").cast("string").alias("phrase"), F.col("n").alias("f"))
    every = single.union(phrases)

    size = F.size(F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words("phrase", 1, F.col("k")).alias("head"), _words("phrase", F.col("k") + 1, size - F.col("k")).alias("tail"))
    total = cuts.count()
    for side, name in (("head", "l"), ("tail", "r")):
        keyed = cuts.groupBy("lang", side).agg(F.count("*").alias("n")).join(every.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
        cuts = join_hot(cuts, keyed, ["lang", side], "phrase", total, hot=hot)
    per_lang = phrases.groupBy("lang").agg(F.count("*").alias("n")).join(words.groupBy("lang").agg(F.sum("n").alias("words")), "lang")
    counted = join_hot(cuts, per_lang, ["lang"], "phrase", phrases.count(), hot=hot)
    # products of three longs may pass 64 bits; the decimals hold them exactly
    score = "(CAST(1000 AS DECIMAL(4,0)) * (CAST(a AS DECIMAL(17,0)) * CAST(words AS DECIMAL(17,0)))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))"
    counted = counted.withColumn("score", F.expr(score).cast("long"))
    best = counted.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("m")).select("lang", "phrase", "m.*")

    longer = phrases.filter(size > 2).select("lang", "f", F.explode(F.array(_words("phrase", 1, size - 1), _words("phrase", 2, size - 1))).alias("phrase"))
    # a phrase that is as frequent as a much longer one is also as frequent as what stands between them
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALT)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
