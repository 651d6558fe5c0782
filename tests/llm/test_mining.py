"""Vector codes, personal data and collocations against brute force, on odd rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rasterflow.llm import collocations as mining
from rasterflow.llm import pii, vector_codes

# 11 vector codes


def lloyd(rows, parts, entries, rounds, scale=1024):
    """rows: (id, vector). Codes, errors and entries, by comparing every part with every entry."""
    q = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    width = len(q[0][1]) // parts
    seeds = sorted(q, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    of = lambda v, p: v[p * width : (p + 1) * width]
    books = [[of(v, p) for _, v in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda j: (far(x, book[j]), j))
    for _ in range(rounds):
        for p in range(parts):
            mine = collections.defaultdict(list)
            for _, v in q:
                mine[near(of(v, p), books[p])].append(of(v, p))
            books[p] = [[sum(c) // len(mine[j]) for c in zip(*mine[j])] if j in mine else e for j, e in enumerate(books[p])]
    out = []
    for i, v in q:
        js = [near(of(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for j in js), min(sum(far(of(v, p), books[p][j]) for p, j in enumerate(js)), 2**63 - 1)))
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, said


def test_vector_codes(spark):
    rnd = random.Random(11)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(8)], rnd.choice(["a", "b", "", None])) for i in range(300)]
    rows += [(5, [0.25] * 8, "a"), (5, [0.25] * 8, "a"), (None, [-0.1] * 8, None), (900, [9000.5] * 8, "wide"), (901, [-3e14] + [0.0] * 7, "wide")]
    odd = [(902, None, "a"), (903, [], "a"), (904, [1.0, None] + [0.0] * 6, "a"), (905, [float("nan")] * 8, "a"), (906, [float("inf")] * 8, "b"), (907, [1.0] * 4, "a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, label string, code string, n int").repartition(4)
    got = vector_codes.vector_codes(df, parts=4, entries=16, rounds=4).collect()
    exp, said = lloyd([r[:2] for r in rows], 4, 16, 4)
    labels = collections.defaultdict(int)
    for (_, _, label), (_, _, e) in zip(rows, exp):
        labels[label] += e
    want = collections.Counter((i, c, e, min(labels[label], 2**63 - 1)) for (_, _, label), (i, c, e) in zip(rows, exp))
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {said}


def test_vector_codes_of_few_or_none(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, [float(i % 2)] * 4) for i in range(3)]
    got = vector_codes.vector_codes(spark.createDataFrame([(*r, None) for r in rows], schema)).collect()
    exp, said = lloyd(rows, 4, 256, 4)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == exp and got[0].codebooks_sha256 == said  # equal entries: the lower index


def test_bounds_save_scans_and_no_result():
    rnd = np.random.default_rng(4)
    x = np.floor(rnd.normal(0, 900, (64, 16))[np.arange(4000) % 64] + rnd.normal(0, 90, (4000, 16))).astype(np.int64)
    x[2000:2200] = x[0]
    start = x[:64].copy()
    book, state, scanned = vector_codes.Book(start), None, []
    for _ in range(8):
        at, upper, lower, n = vector_codes.assign(x, book, *(state or ()))
        d = ((x[:, None] - book.entries[None]) ** 2).sum(2)
        assert (at == d.argmin(1)).all()
        rows = np.arange(len(x))
        assert (upper >= np.sqrt(d[rows, at])).all()
        d[rows, at] = np.iinfo(np.int64).max
        assert (lower <= np.sqrt(d.min(1))).all()
        scanned.append(n)
        new = np.array([x[at == j].sum(0) // max((at == j).sum(), 1) if (at == j).any() else e for j, e in enumerate(book.entries)])
        book = vector_codes.Book(new, np.sqrt(((new - book.entries).astype(float) ** 2).sum(1)) * (1 + vector_codes.SLACK))
        state = at, upper, lower
    assert scanned[0] == len(x) and scanned[-1] < len(x) / 2


# 12 personal data


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    t, out = text or "", []
    # the plain forms take very long over one long run without a match
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if "@" in t else "")]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t if "." in t else "") if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


ODD = [
    None, "", "a@b.c", "a@b.c%d@e.f", "a@b@c.d", "x..y@h.i..j@k.l", "\U0001f600é a+b@c-d.ef.", "1.2.3.4.5.6.7.8", "300.2.3.4.5", "000001.02.003.255", "1.2.3.99999999999999999999", "4111 1111-1111 1111", "4111111111111111 4111111111111111",
    "4111111111111112", "0000 0000 0000", "12-34 56-78 90-12 3456", "+1 (017) 555-7713", "+1 (017) 555-7713 4111111111111111", "+12345678", "+1+2+123456789", "+1 ((((", "x" * 200_000, "1" * 100_000, "+1" * 3000, "a@" * 3000, "1.1.1.1 " * 500, "@" * 5000,
]


@pytest.fixture(scope="module")
def private(spark, sf_dir):
    rnd = random.Random(12)
    soup = ["".join(rnd.choice(list("0123456789") * 3 + list(" -.+()@ab") + ["@b.c ", "+1 ", "4111111111111111"]) for _ in range(rnd.randrange(1, 120))) for _ in range(400)]
    texts = ODD + soup + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)] + [(3, "a@b.c", "x")] * 2
    got = pii.private_spans(spark.createDataFrame(rows, "doc_id long, text string, base string").repartition(4)).collect()
    return rows, got


def test_base_spans(private):
    rows, got = private
    said = lambda s: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s)
    exp = collections.Counter()
    for i, t, _ in rows:
        s = base_spans(t)
        exp[(i, *(sum(k == x for _, k, _ in s) for x in range(4)), hashlib.sha256(said(s).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == exp


def test_base_spans_stay_and_others_keep_clear(private):
    for r in private[1]:
        spans = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert {(x.start, pii.KINDS[x.kind], x.end) for x in r.base} | {(x.start, pii.KINDS[x.kind], x.end) for x in r.added} == set(spans)
        assert all(a.end <= b.start or b.end <= a.start for a in r.added for b in r.base)
        assert all(a.end <= b.start for a, b in zip(r.added, r.added[1:]))


def test_the_model_adds_what_runs_hide(spark):
    rnd = random.Random(5)

    def card(ok):
        while True:
            d = "4" + "".join(rnd.choice("0123456789") for _ in range(15))
            if luhn(d) == ok:
                return d

    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    data = [f"{word()} {word()} {card(i % 3 > 0)} {word()}, {word()} +1 (200) 555-{rnd.randrange(1000, 9999)} {word()} 10.{rnd.randrange(400)}.3.4 {word()}@{word()}.org" for i in range(600)]
    two, bad = f"{card(True)} {card(True)}", f"{card(False)} {card(False)}"
    hidden = [f"pay {two} now", f"pay {bad} now", "write to ann [at] example [dot] org please", "call (200) 555-1234 or not", "we met at noon. Then 12 more came", f"+1 (200) 555-7713 {card(True)}"]
    got = {r.doc_id: r for r in pii.private_spans(spark.createDataFrame(list(enumerate(data + hidden)), "doc_id long, text string")).collect()}
    added = [[(pii.KINDS[x.kind], text[x.start : x.end]) for x in got[len(data) + i].added] for i, text in enumerate(hidden)]
    assert added[0] == [("card", c) for c in two.split()] and added[1] == [] and added[4] == []
    assert added[2] == [("email", "ann [at] example [dot] org")] and added[3] == [("phone", "(200) 555-1234")]
    assert added[5][0] == ("phone", "+1 (200) 555-7713") and len(added[5]) == 2
    failing = [i for i in range(len(data)) if got[i].n_card == 0]
    assert len(failing) == 200 and not any(x.kind == pii.CARD for i in failing for x in got[i].added)


def test_no_private_data(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.private_spans(none).count() == 0
    got = pii.private_spans(spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")).collect()
    assert all(r.spans == "" and r.added == [] for r in got)


# 13 collocations


def mined(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[(lang, *w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if a >= least and len(k) > 2}
    held = {(k[0], *k[i : i + m]) for k, a in found.items() for m in range(2, len(k) - 1) for i in range(1, len(k) - m + 1) if 100 * a >= 100 * f[(k[0], *k[i : i + m])]}
    out = collections.defaultdict(list)
    for k, a in found.items():
        if k not in held:
            lang, *w = k
            score, _, left, right = min((1000 * a * n[lang] // (f[(lang, *w[:c])] * f[(lang, *w[c:])]), c, f[(lang, *w[:c])], f[(lang, *w[c:])]) for c in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


@pytest.mark.parametrize("hot", [4, 1 << 20])
def test_collocations(spark, hot):
    rnd = random.Random(13)
    words = [chr(97 + i) * (1 + i % 3) for i in range(14)] + ["É", "İx", "\U0001f600", "\x01", "\x1c"]
    rows = [(rnd.choice(["en", "de", "und", None]), "".join(rnd.choice(words[: rnd.choice([2, 6, 19])]) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b"]) for _ in range(rnd.randrange(60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), ("en", "Of The of the OF"), ("en", "a b c d e " * 3000), ("de", "very common words here " * 400), ("en", "z" * 100_000), ("x\ty", "a a a a a a " * 5)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, doc_id int").repartition(5)
    got = mining.collocations(df, least=7, top=40, hot=hot).collect()
    assert {tuple(r) for r in got} == mined(rows, 7, 5, 40) and len(got) == len(set(got))


def test_collocations_of_nothing(spark):
    assert mining.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert mining.collocations(spark.createDataFrame([(None, None), ("en", "few words")], "lang string, text string")).count() == 0


def test_an_occurrence_is_counted_once():
    often = np.full(mining.SLOTS, 9, np.int32)
    held, n = mining.Fragments(often, 1, 3, 1e9), collections.Counter()
    for text in (b"a b c a b", b"c, a b"):
        held.add("en", text)
    rows = pa.Table.from_batches(list(held.rows())).sort_by("key")
    for lang, phrase, times, partial in mining.owned(rows, 1, 3):
        assert lang == "en" and not partial
        n[phrase] += times
    assert n == {b"a b": 3, b"b c": 1, b"c a": 1, b"a b c": 1, b"b c a": 1, b"c a b": 1}
