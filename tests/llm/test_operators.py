"""The corpus operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows,
empty tables and columns whose names clash."""

from __future__ import annotations

import collections
import gzip
import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterflow.llm import bpe, embedding_dedup, line_dedup, oracles, packing, quality, sharding, simhash, token_counts, toxicity, warc
from rasterflow.llm.common import components, join_hot
from rasterflow.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark string, row string, id long"
ODD = [(None, None), (None, ""), (10**6, ""), (10**6 + 1, "one two"), (10**6 + 2, "One two"), (3, "other text of an id that is there already, with some words"), (10**6 + 5, "x y z"), (10**6 + 5, "x y z"), (10**6 + 6, " \n\t \n"), (10**6 + 7, "word " * 30_000), (10**6 + 8, "x" * 200_000)]
key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The smallest documents and odd rows, with extra columns named like the operators' own."""
    extra = [F.lit("m").alias("mark"), F.lit("r").alias("row"), F.lit(7).cast("long").alias("id")]
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", *extra)
    odd = spark.createDataFrame([(d, t, None, None, None, "m", "r", 7) for d, t in ODD], DOCS)
    out = base.union(odd).repartition(3).cache()
    out.count()
    return out


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def groups(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def lowest(ids, roots):
    low = {}
    for i, r in zip(ids, roots):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in roots]


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    roots = groups(2100, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = dict(components(spark.createDataFrame(links + [(5, 5), (None, 4)], "a long, b long")).collect())
    assert got == {x: roots[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 1 << 20])
def test_join_hot(spark, hot):
    """No key, one key and every key is hot; null keys meet nothing."""
    data = [(k, i) for k, n in ((1, 50), (2, 30), (3, 1), (4, 7), (None, 5)) for i in range(n)]
    rows = spark.createDataFrame(data, "k long, i long")
    keyed = spark.createDataFrame([(1, "a", 50), (2, "b", 30), (4, "d", 7), (9, "z", 0)], "k long, v string, n long")
    for how in ("inner", "left"):
        got = collections.Counter(map(tuple, join_hot(rows, keyed, ["k"], "i", 93, how, hot=hot).select("k", "i", "v").collect()))
        of = {1: "a", 2: "b", 4: "d"}
        assert got == collections.Counter((k, i, of.get(k)) for k, i in data if how == "left" or k in of)


def test_words_apart_from_signs():
    """The encoder of whole texts takes words, signs and capitals apart; the library's ids come out, of any letters."""
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(8)
    parts = list("abcXYZéÉİßΣσςñ.,;:!?'\u2019\"0123 \n\t\u1100각é中文ǅªⅷ|<>") + ["<|endoftext|>", "it's ", "don't.", "A.", "ΑΣ. ", "ΑΣ ", "x" * 60 + " ", "\u0958? ", "e\u0301. "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(120))) for _ in range(1500)] + ["", None, "word " * 5000]
    encoder = bpe.LibraryEncoder(path)
    for text, ids in zip(texts, list(encoder.encode_all(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert max(map(len, encoder.memo)) <= bpe.MEMO_CHARS


def test_collector_rests_while_words_are_learned():
    """Learning makes nothing that needs the collector, which is on again after it; all words of a large task stay known."""
    import gc

    encoder, seen = bpe.LibraryEncoder(P.path("word_bpe_49k.json")), []
    learn = encoder.learn
    encoder.learn = lambda chunks: seen.append(gc.isenabled()) or learn(chunks)
    assert len(list(encoder.encode_all(["one two", None, "three"]))) == 3
    assert seen == [False] and gc.isenabled()
    encoder.memo = dict.fromkeys(map(str, range(500_000)), b"")
    learn({"four"})
    assert len(encoder.memo) > 500_000 and not encoder.old



# 1 sharding


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 1000, 4097):
        ids = spark.range(n).select("id", sharding.permute(F.col("id"), n).alias("at"))
        got = ids.select("id", "at", sharding.unpermute(F.col("at"), n).alias("back")).collect()
        assert sorted(r.at for r in got) == list(range(n)) and all(r.id == r.back for r in got)


def test_shards(docs, rows, none):
    got = sharding.shards(docs).collect()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shards(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert sharding.shards(none).count() == 0


# 2 line dedup


def test_line_dedup(docs, rows, none):
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows)
    first, cut = {}, {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for no, (_, _, _, h) in enumerate(line_dedup.units(t)):
            first.setdefault(h, d)
    for r in got:
        text = dict_text(rows, r)
        seen, runs, before = set(), [], -2
        for no, (a, b, n, h) in enumerate(line_dedup.units(text)):
            if h in seen or (r.doc_id is not None and first[h] != r.doc_id):
                if before == no - 1:
                    runs[-1] = [runs[-1][0], b, runs[-1][2] + n, max(runs[-1][3], n)]
                else:
                    runs.append([a, b, n, n])
                before = no
            seen.add(h)
        exp = [(a, b, n) for a, b, n, m in runs if n >= line_dedup.MIN_WORDS and m >= line_dedup.LONGEST]
        assert [(x.start, x.stop, x.words) for x in r.removed] == exp
        if not exp:
            assert r.text == text
    assert line_dedup.line_dedup(none).count() == 0
    del cut


def dict_text(rows, r):
    """The original of a cleaned row: among the texts of its id, the one that its stretches fit."""
    texts = [t for d, t in rows if d == r.doc_id]
    fits = [t for t in texts if (line_dedup.without(t, [tuple(x) for x in r.removed]) if r.removed else t) == r.text]
    assert fits
    return fits[0]


def test_pasted_passage_goes(spark):
    passage = "This passage was pasted into the middle of a line. It goes on for quite a few more words than that. And then it ends here."
    a = f"Some words first. {passage} Then other words."
    b = f"Another beginning, without an end {passage} more of it"
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame([(1, a), (2, b), (3, "clean words only")], "doc_id long, text string")).collect()}
    assert got[1].text == a and got[3].text == "clean words only"
    assert got[2].text == "Another beginning, without an end  more of it" and got[2].removed[0].first_doc_id == 1


def test_whole_lines_go(spark):
    """Lines of short units, of one unit in a script without spaces, and of one long string; not their words by chance."""
    bar = "Home About Us Contact Privacy Policy Terms Of Service Sign In Create Account"
    lines = [bar, "BUY!! NOW!! ONLY!! TODAY!! HERE!! AND!! THERE!!", "\u8fd9\u662f\u4e00\u4e2a\u6ca1\u6709\u7a7a\u683c\u7684\u53e5\u5b50\u5b83\u5f88\u957f", "https://example.org/" + "path/" * 20]
    data = [(2 * i + j, f"begin{2 * i + j}\n{x}\nend{2 * i + j}") for i, x in enumerate(lines) for j in range(2)]
    data += [(50, "Service In Home Us Of Account Contact"), (51, f"{bar} Now")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string"), min_words=5).collect()}
    for d, text in data:
        again = d < 50 and d % 2
        assert got[d].text == (f"begin{d}\nend{d}" if again else text)
        assert [r.first_doc_id for r in got[d].removed] == ([d - 1] if again else [])


def test_rows_that_share_an_id(spark):
    """Each row is cut by its own text: what one repeats takes nothing from another row of the same id."""
    a = "A passage of several words stands here. It has a second sentence of some length too, and after that it ends."
    b = "Nothing of this text is anywhere else in the table, whatever its id may be. It comes back as it was given here."
    c = "A third text that stands for itself, with words of its own in quite a number, so that it would be removed if repeated."
    data = [(1, a), (5, a), (5, b), (5, b), (7, f"{a} {c}"), (3, c), (None, a), (None, b)]
    got = line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(1, a), (5, ""), (5, b), (5, b), (7, ""), (3, c), (None, a), (None, b)])
    assert next(r for r in got if r.doc_id == 7).removed[0].keepers == [1, 3]


@pytest.mark.parametrize("hot", [2, 1 << 20])
def test_hot_digests_are_dealt(spark, hot):
    """Alike whether only the shared line is hot, or every unit is."""
    line = "One line that most documents of this table share, and that is long enough to be removed wherever it is found again."
    data = [(i, f"{line}\nown words of document {i} that nobody else has in the whole table") for i in range(200)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string"), hot=hot).collect()}
    assert got[0].removed == [] and all([x.first_doc_id for x in got[i].removed] == [0] and got[i].text == data[i][1].partition("\n")[2] for i in range(1, 200))


# 3 quality


def test_quality_measures(docs, rows, none):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
    exp = collections.Counter()
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = collections.Counter(grams)
        again = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        exp[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", "".join(w))), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))] += 1
    assert got == exp
    assert quality.quality(none).count() == 0


def test_divergence_rejects_what_is_unlike(spark):
    rnd = random.Random(2)
    common = "the of and to in is that for it was".split()
    prose = [" ".join(rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(200)) for _ in range(60)]
    odd = ["".join(rnd.choice("0123456789#$%") for _ in range(900)).replace("5", " ") for _ in range(2)]
    got = quality.quality(spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + odd)], "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {60, 61}


def test_languages_beyond_the_broadcast(docs):
    """Which references are broadcast changes no verdict."""
    many = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 6, None).otherwise(F.concat(F.col("lang"), (F.col("doc_id") % 3).cast("string"))))
    refs = quality.cut(quality.references(many))
    assert refs.count() > 6
    rows = [collections.Counter(map(str, quality.measured(many, refs, languages=n).select("row.doc_id", "row.lang", "n_words", "class_distance", "word_distance", "kept").collect())) for n in (200, 2)]
    assert rows[0] == rows[1] and rows[0].total() == docs.count()


# 4 WARC


def test_warc(spark, docs, none, tmp_path):
    pages = [(1, "http://a b", "x" * 2000), (2, "u", "x" * 2000), (2, "u", "x" * 2000), (None, None, None), (None, "u", "x" * 2000), (5, "u", "y" * 999), (6, "u", "y" * 999), (7, "\r\n", "a\r\n\r\nWARC/1.1\r\n" * 100), (8, "u", "é" * 700_000)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    folder = str(tmp_path / "w")
    got = collections.Counter(map(tuple, warc.archive_round_trip(df, folder).collect()))
    exp = collections.Counter()
    for i, _, h in pages:
        p = (h or "").encode()
        again = h is not None and h[0] == "x" and i != 2
        exp[(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 2 if again else None)] += 1
    assert got == exp
    for name in os.listdir(folder):
        if name.startswith("members") and name.endswith(".gz"):
            data = open(f"{folder}/{name}", "rb").read()
            index = [json.loads(x) for x in open(f"{folder}/{name}.idx")]
            assert sum(x["length"] for x in index) == len(data)
            for x in index:
                assert gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none")).count() == 0


def test_warc_that_breaks_off(spark, tmp_path):
    one = warc.record("response", 1, "u", "d", 3, None, b"abc")
    whole = gzip.compress(one + one[:-30])
    (tmp_path / "whole-a.warc.gz").write_bytes(whole)
    (tmp_path / "whole-b.warc.gz").write_bytes(gzip.compress(one * 3)[:-20])
    (tmp_path / "whole-c.warc.gz").write_bytes(b"no gzip")
    got = warc.normalise(spark.createDataFrame([(f"whole-{x}.warc.gz",) for x in "abc"], "archive string"), str(tmp_path)).collect()
    assert [r.page_id for r in got if r.archive == "members-a.warc.gz"] == [1, None] and all(any(r.error for r in got if r.archive == f"members-{x}.warc.gz") for x in "abc")


# 5 SimHash


def test_bk_tree():
    rnd = np.random.default_rng(3)
    points = np.unique(np.concatenate([rnd.integers(0, 2**63, 400, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << rnd.integers(0, 60, 200, dtype=np.uint64))]))
    for radius in (0, 2, 20):
        got = {(int(a), int(b)) for q, n in simhash.BKTree(points).search(points, radius) for a, b in zip(q, n)}
        d = np.bitwise_count(points[:, None] ^ points[None, :])
        assert got == set(zip(*(x.tolist() for x in np.nonzero(d <= radius))))


def test_simhash_components(docs, rows, none, spark):
    fp = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64)
        fp.append(sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h)))
    roots = groups(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    exp = collections.Counter((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fp, lowest([d for d, _ in rows], roots)))
    assert collections.Counter(map(tuple, simhash.simhash_components(docs, k=3, radius=2).collect())) == exp
    assert simhash.simhash_components(none).count() == 0
    # crowded buckets are cut again and lose nothing
    rnd = random.Random(4)
    fps = sorted({1 << 40 | sum(1 << rnd.randrange(14) for _ in range(rnd.randrange(5))) for _ in range(700)})
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, bucket_rows=20, shard_rows=100)
    got = dict(components(links).collect())
    roots = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert [got.get(f, f) for f in fps] == [fps[r] for r in roots]


@pytest.mark.parametrize("bucket_rows", [4096, 8])
def test_near_duplicates(spark, docs, rows, none, bucket_rows):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    near = [(2 * 10**6 + i, " ".join(w if rnd.random() > 0.006 else f"n{i}" for w in base)) for i in range(40)]
    some = rows + near
    df = docs.select("doc_id", "text", "mark", "row").union(spark.createDataFrame([(*x, "m", "r") for x in near], "doc_id long, text string, mark string, row string"))
    words = [simhash.words_of(t) for _, t in some]
    sets = [set(simhash.shingle_set(w, 5).tolist()) for w in words]
    alike = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b)
    roots = groups(len(some), [(i, j) for i in range(len(some)) for j in range(i) if words[i] == words[j] or alike(sets[i], sets[j])])
    exp = collections.Counter((d, c) for (d, _), c in zip(some, lowest([d for d, _ in some], roots)))
    got = simhash.near_duplicates(df, bucket_rows=bucket_rows, shard_rows=200).collect()
    assert collections.Counter((r.doc_id, r.group_id) for r in got) == exp
    kept = simhash.drop_near_duplicates(df, bucket_rows=bucket_rows, shard_rows=200)
    assert kept.columns == df.columns and kept.count() == len(set(roots))
    assert simhash.drop_near_duplicates(none).count() == 0


def test_near_duplicates_by_sets(spark):
    """A line repeated twenty times or once: the sets are nearly equal, whatever the numbers of repeats."""
    rnd, some = random.Random(5), []
    for i in range(30):
        body, line = ([f"w{rnd.randrange(10**6)}" for _ in range(n)] for n in (800, 8))
        some += [(2 * i, " ".join(body + line)), (2 * i + 1, " ".join(body + line * 20))]
    got = simhash.near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.group_id) for r in got) == [(i, i - i % 2) for i in range(60)]


@pytest.mark.parametrize("bucket_rows", [4096, 4])
def test_near_duplicates_without_luck(spark, monkeypatch, bucket_rows):
    """Least hashes on which no two texts agree: every pair is found by its prefixes, at 0.8 too, none below it."""
    monkeypatch.setattr(simhash, "_bucket_trees", lambda least, radius: lambda g: g.loc[g["node"] < 0, ["task", "node", "fp"] if least is None else ["node", "fp"]].set_axis(["task", "node", "fp"] if least is None else ["a", "b"], axis=1))
    rnd, some, exp = random.Random(8), [], []
    common = [f"c{i}" for i in range(60)]
    for i in range(12):
        body = [f"w{rnd.randrange(10**6)}" for _ in range(104)]
        # 100 shingles; a text of 80 of them, one of 79 that the second links to the first, or one of many common shingles
        some += [(3 * i, " ".join(body)), (3 * i + 1, " ".join(body[:84])), (10**4 + i, " ".join(body[:83]) if i % 2 else " ".join(common + body[:20]))]
        exp += [(3 * i, 3 * i), (3 * i + 1, 3 * i), (10**4 + i, 3 * i if i % 2 else 10**4 + i)]
    got = simhash.near_duplicates(spark.createDataFrame(some, "doc_id long, text string"), bucket_rows=bucket_rows).collect()
    assert sorted((r.doc_id, r.group_id) for r in got) == sorted(exp)


def test_near_duplicates_of_null_ids(spark):
    words = [f"w{i}" for i in range(200)]
    some = [(None, " ".join(words)), (7, " ".join([*words[:-1], "end"])), (None, "other words that are like no text here")]
    got = simhash.near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.group_id, r.kept) for r in got), key=key) == [(7, 7, True), (None, 7, False), (None, None, True)]


# 6 toxicity


def test_toxicity(spark, docs, rows, none):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    data = []
    for i in range(600):
        t = [rnd.choice(words) for _ in range(40)]
        if i % 5 == 0:
            t[rnd.randrange(40)] = rnd.choice(["zzidiot", "vvscum"])
        data.append((i, " ".join(t), i % 5 == 0))
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in data], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    out = [(got[i].predicted, int(y)) for i, _, y in data if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in data)
    assert len(out) > 100 and sum(a == b for a, b in out) >= 0.97 * len(out)
    model = toxicity.trained(df, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored) and toxicity.score(none, model).count() == 0
    one = toxicity.trained(df, labels.withColumn("toxic", F.lit(0)))
    assert all(r.score < 0.3 for r in toxicity.score(df, one).collect())


def test_toxicity_by_brute_force(spark, monkeypatch):
    """Ratios over all labelled rows and the fitted weights, counted and fitted anew in plain Python."""
    monkeypatch.setattr(toxicity, "ROUNDS", 40)
    rnd = random.Random(12)
    data = [(i, "".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 80))) + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(120)]
    model = toxicity.train(spark.createDataFrame([*data, (None, "vile", None)], "doc_id long, text string, toxic int"), features=300)
    own = lambda t: sorted(set(np.concatenate([*toxicity.buckets(t), np.zeros(0, np.uint32)]).tolist()))
    sets, y = [own(t) for _, t, _ in data], [label for *_, label in data]
    count = [collections.Counter(b for s, label in zip(sets, y) if label == k for b in s) for k in (0, 1)]
    size = [y.count(0), y.count(1)]
    ratio = {b: np.log((count[1][b] + 1) / (size[1] + 2)) - np.log((count[0][b] + 1) / (size[0] + 2)) for b in count[0] | count[1]}
    said = sorted(ratio, key=lambda b: (-abs(ratio[b]) * min(count[0][b] + count[1][b], 50) ** 0.5, b))[:300]
    place = {b: k for k, b in enumerate(sorted(said))}
    x = np.zeros((len(data), len(place)))
    for i, s in enumerate(sets):
        for b in s:
            if b in place:
                x[i, place[b]] = ratio[b]
    w, speed, bias, drift, y = np.zeros(len(place)), np.zeros(len(place)), 0.0, 0.0, np.array(y)
    share = np.where(y == 1, 0.5 / size[1], 0.5 / size[0])
    rate = 4 / (1 + (x * x).sum(1).mean())
    for _ in range(40):
        g = share * (1 / (1 + np.exp(-(x @ w + bias))) - y)
        speed = 0.9 * speed - rate * (x.T @ g + toxicity.DECAY / len(place) * w)
        drift = 0.9 * drift - 0.1 * g.sum()
        w, bias = w + speed, bias + drift
    assert set(np.flatnonzero(model.weights).tolist()) <= set(place)
    assert np.allclose([model.weights[b] for b in sorted(place)], [w[place[b]] * ratio[b] for b in sorted(place)], atol=1e-4) and abs(model.bias - bias) < 1e-4
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(data, "doc_id long, text string, toxic int"), model).collect()}
    z = {i: bias + sum(w[place[b]] * ratio[b] for b in s if b in place) for (i, *_), s in zip(data, sets)}
    assert all(abs(got[i] - 1 / (1 + np.exp(-v))) < 1e-3 for i, v in z.items())


def test_fit_is_a_task(spark, monkeypatch):
    """The fitted rows meet in a task, not in the driver."""
    from pyspark import TaskContext

    real = toxicity._fit

    def fit(*args):
        assert TaskContext.get() is not None
        return real(*args)

    monkeypatch.setattr(toxicity, "_fit", fit)
    data = [(i, ("vile words here " if i % 2 else "a kind remark ") + str(i), i % 2) for i in range(60)]
    model = toxicity.train(spark.createDataFrame(data, "doc_id long, text string, toxic int"))
    scores = toxicity.score(spark.createDataFrame(data, "doc_id long, text string, toxic int"), model).collect()
    assert all((r.score > 0.5) == bool(r.toxic) for r in scores)



def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    text = "".join(random.Random(7).choice("abcdé ") for _ in range(5000))
    met = toxicity.Distinct()
    whole = set(met.of(text).tolist())
    assert len(whole) == len(met.of(text))
    monkeypatch.setattr(toxicity, "_PIECE", 700)
    assert set(toxicity.Distinct().of(text).tolist()) == whole


# 7, 8, 10: tokens


@pytest.fixture(scope="module")
def strange(spark, docs):
    rnd = random.Random(8)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x400), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x180E, 0x4E2D, 0xAC00, 0x1100, 0x1161, 0x1F600, 0xFB01, 0x130, 0x3A3, 0x3C2, 0xFEFF, 0x200B, 0x85, 0xE000]]
    pool += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", "  ", "\n", "a" * 30, "the", "it's"]
    odd = [(3 * 10**6 + i, "".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 60)))) for i in range(500)]
    return docs.select("doc_id", "text", "mark", "id").union(spark.createDataFrame([(*x, "m", 1) for x in odd], "doc_id long, text string, mark string, id long")).cache()


def test_forced_boundaries(strange, none):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    exp = collections.Counter()
    for r in strange.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        exp[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, bpe.encoding_digests(strange, path).collect())) == exp
    back = bpe.decode_documents(bpe.encode_documents(strange.filter("doc_id = 3000001"), path), path).first()
    assert back.text == lib.decode(lib.encode(strange.filter("doc_id = 3000001").first().text, add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encoding_digests(none, path).count() == 0
    own = bpe.load(path)
    for w in ("abcabcabc" * 30, "the" * 40):
        assert own.merge(list(w)) == own.merge_long(list(w))


def test_fragments_merge_together():
    """Words of many texts take their merges in matrices, not one by one, and the library's ids come out; nothing long stays known."""
    path = P.path("word_bpe_49k.json")
    lib, own, rnd, calls = Tokenizer.from_file(path), bpe.SplitBPE(path), random.Random(7), []
    one = own.merge
    own.merge = lambda parts: calls.append(len(parts)) or one(parts)
    letters = "aabcdeeefghiijklmnooprsttuéèßñçêöüİΣ中"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14))) + rnd.choice(["", "", ".", ",%%%", "'s", "12", "'LL!"])
    texts = [" ".join(word() for _ in range(200)) for _ in range(100)] + ["a" * k for k in range(1, 60)] + [None, "", " ", "x<|endoftext|>THE ", "\x1c. a\x1db", "é" * 500 + "the", "Wörd abcabc. " * 100_000]
    for text, pieces in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == lib.encode(text or "", add_special_tokens=False).ids
    assert len(calls) < 1500 and max(map(len, [*own.memo, *own.words])) <= bpe.MEMO_CHARS
    own.memo.most = own.words.most = 50
    again = [b"".join(pieces) for text in texts[:9] for pieces in own.encode_all([text])]
    assert again == [b"".join(own.encode(text)) for text in texts[:9]] and len(own.memo) < 500
    # a pattern that leaves characters out, or takes spaces, says nothing of where chunks end
    for pattern in (r"\p{L}+", r"\s?\p{L}+", "x"):
        own.forget()
        own.word = regex.compile(pattern)
        chunks = sorted({c for text in texts[:3] for c in text.split()})
        own.learn({*chunks})
        assert [own.memo[c] for c in chunks] == [b"".join(map(own.encode_word, own.word.findall(own.plain(c)))) for c in chunks]


def test_token_counts(strange, none):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    exp = sorted(((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in strange.collect()), key=key)
    for common in (200_000, 50):
        assert sorted(map(tuple, token_counts.token_counts(strange, path, common=common).collect()), key=key) == exp
    assert token_counts.token_counts(none, path).count() == 0


def test_packing(strange, none):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack_documents(strange, path, window=4).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    texts = collections.defaultdict(list)
    for r in strange.collect():
        texts[r.doc_id].append([*lib.encode(r.text or "", add_special_tokens=False).ids, 2])
    for d, all_ids in texts.items():
        assert sum(r.length for r in by[d]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for r in sorted(by[d], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(all_ids[0])
                assert r.ids_crc32 == zlib.crc32(np.array(all_ids[0][at : at + r.length], "<u4").tobytes())
                at += r.length
    padded = 0
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        padded += 4096 - at if at & (at - 1) else 0
    assert padded == 0
    assert packing.pack_documents(none, path).count() == 0


def test_packing_balances_cost():
    """The rule by brute force, and how far the costs of a window's sequences lie apart."""
    rnd = random.Random(13)
    for most, spread in ((400, 0.03), (9000, 1.0)):
        lengths, total = [], 0
        while total < 64 * 4096:
            lengths.append(min(rnd.randrange(1, most), 64 * 4096 - total))
            total += lengths[-1]
        packer = packing.Packer(4096, 4096.0, 0)
        items = [p for i, n in enumerate(lengths) for p in packer.pieces(i, bytes(4 * n))]
        assert packer.pack(items, [4096] * 64) == []
        cost = lambda n: n + n * n / 4096
        room, costs, late, exp = [4096] * 64, [0.0] * 64, [], collections.Counter()

        def put(n, at):
            room[at] -= n
            costs[at] += cost(n)
            exp[(at, n)] += 1

        for n in sorted((len(p[2]) // 4 for p in items), reverse=True):
            fits = [(costs[k], k) for k in range(64) if room[k] >= n]
            put(n, min(fits)[1]) if fits else late.append(n)
        for n in late:
            while n:
                at = min((costs[k], k) for k in range(64) if room[k])[1]
                part = min(n, room[at])
                n -= part
                put(part, at)
        assert collections.Counter((r[5], r[2]) for r in packer.rows) == exp and not any(room)
        assert max(costs) - min(costs) <= spread * min(costs)


# 9 embeddings


@pytest.mark.parametrize("chunk_rows", [16_384, 40])
def test_embeddings(spark, sf_dir, chunk_rows):
    nan, inf = float("nan"), float("inf")
    odd = [(None, None), (10**6, [0.0] * 64), (10**6 + 1, [nan] + [1.0] * 63), (10**6 + 2, [1.0] * 64), (10**6 + 3, [2.0] * 64), (10**6 + 4, [1.0] * 3), (10**6 + 5, [None] * 64), (10**6 + 6, [inf] * 64), (10**6 + 7, []), (10**6 + 2, [1.0] * 64)]
    rnd = np.random.default_rng(9)
    base = rnd.standard_normal(64)
    odd += [(2 * 10**6 + i, (base + 0.12 * rnd.standard_normal(64)).tolist()) for i in range(60)]
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("key"), F.lit(2).alias("n"))
    df = df.union(spark.createDataFrame([(*x, 1, 2) for x in odd], "vec_id long, embedding array<float>, key int, n int")).cache()
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ok = [v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = np.array([v if o else [0.0] * 64 for (_, v), o in zip(rows, ok)], float)
    size = np.linalg.norm(x, axis=1)
    u = x / np.where(size, size, 1)[:, None]
    link = (u @ u.T >= 0.95) & np.outer(ok, ok)
    np.fill_diagonal(link, False)
    low = lowest([i for i, _ in rows], groups(len(rows), zip(*(a.tolist() for a in np.nonzero(link)))))
    exp = collections.Counter((i, int(n), c, i is not None and i == c) for (i, _), n, c in zip(rows, link.sum(1), low))
    assert link.sum() > 500
    assert collections.Counter(map(tuple, embedding_dedup.embedding_components(df, chunk_rows=chunk_rows).collect())) == exp


def test_no_embeddings(spark):
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# Registered queries with SQL


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.sql(oracles.SQL[name])
    assert sorted(rel.columns) == cols
    exp = rel.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall()
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(exp, key=key)
