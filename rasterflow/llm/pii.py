"""Personal data by candidates and gradient boosting, in DataFrame functions alone.

Four base patterns find what is formed as it should be: e-mail addresses, IP addresses, payment cards that pass Luhn's
check, phone numbers. They are taken as they are. Besides, generators of high recall propose further spans, which may
overlap each other and the base ones: card and phone numbers inside longer runs of digits, where the base pattern takes
the whole run and drops it, spelt-out addresses, defanged and long IP addresses, numbers without a country code. Boosted
trees on features of format and context give each candidate a score, and a threshold per kind selects what is redacted.

Nobody labels spans, so the base patterns do: what they accept is a positive, what they match and then drop (a card
that fails Luhn, an address part over 255, too few digits) a negative. The trees are fitted on the texts of three folds
of four and their thresholds calibrated on the fourth. All features are small integers, so that the labelled candidates of
any corpus come down to a table of counts by feature values; a level of a tree is one aggregation of it, and what
reaches the driver are sums by node, feature and value. Sums are of integers, so a model does not depend on the order of rows.

A text is read once; its candidates stay in its row, as an array, so no text moves and a document with very many
candidates is one row like any other.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: The base patterns. Possessive and anchored at the start of a run, so that a long run without a match is read once; runs
#: that the plain forms match are the same.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: What a text must hold for a base pattern to be tried.
BASE_GATE = ("@", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[ -]?[0-9]){11}", r"\+[0-9]")

_AT, _DOT = r" ?[\[({]at[\])}] ?", r" ?[\[({]dot[\])}] ?"
_HOST = r"[a-z0-9-]{1,63}"


@dataclass(frozen=True)
class Generator:
    """Proposes spans of a kind: pattern has them as group 1 of a lookahead, so they may overlap; gate: what a text must
    hold; label: 0 where all it finds is known not to be personal data, else None."""

    kind: int
    gate: str
    pattern: str
    label: int | None = None


GENERATORS = (
    Generator(EMAIL, rf"(?i)[\[({{]at[\])}}]| dot ", rf"(?i)(?<![a-z0-9._%+-])(?=([a-z0-9._%+-]{{1,64}}{_AT}{_HOST}(?:(?:{_DOT}|\.){_HOST}){{1,8}}|[a-z0-9._%+-]{{1,64}} at {_HOST}(?: dot {_HOST}){{1,8}}))"),
    Generator(EMAIL, "@", r"(?<!\S)(?=([^\s@]{1,64}@[^\s@.]{1,64})(?:\s|$))", 0),
    Generator(IP, r"[0-9](?:\[\.\]|\(\.\)| \. |\[dot\])[0-9]", r"(?<![0-9.])(?=([0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. |\[dot\])[0-9]{1,3}){3})(?![0-9]))"),
    Generator(IP, r"(?:[0-9A-Fa-f]{1,4}:){7}", r"(?<![0-9A-Za-z:])(?=((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:]))"),
    Generator(CARD, r"[0-9](?:[ .-]?[0-9]){11}", r"(?<![0-9])(?=([0-9]{12,19}|[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5})(?![0-9]))"),
    Generator(PHONE, r"\+[0-9]", r"(?=(\+[0-9]{9,15}|\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4})(?![0-9]))"),
    Generator(PHONE, r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9A-Za-z+])(?<![0-9][ .-])(?=((?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z]))"),
)

#: Words that announce a kind.
CUES = (r"(?i)mail|contact|@", r"(?i)\bip\b|host|server|addr|client", r"(?i)card|visa|master|amex|payment|credit|\bcc\b", r"(?i)phone|tel|call|mobile|fax|whatsapp")
BEFORE, AFTER = 40, 8
#: Features of a candidate and the number of values of each, 0 to that less 1.
FEATURES = {"kind": 4, "valid": 2, "digits": 21, "lead": 11, "groups": 9, "marks": 5, "left": 4, "right": 4, "cue": 2, "near": 4}
#: Trees, their depth, shrinkage, the ridge on leaf values; what of the selected spans of a calibration fold must be right.
TREES, DEPTH, SHRINK, RIDGE, PRECISION = 8, 3, 0.5, 1.0, 0.98
FOLDS, HELD_OUT = 4, 2
#: Sums of gradients are of integers: this many to 1.
UNITS = 4096
_SPAN = "struct<start:int,end:int,kind:int,base:boolean,label:int,f:struct<" + ",".join(f"{f}:int" for f in FEATURES) + ">>"
_EMPTY = f"array<{_SPAN}>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: int, m: Column, digits: Column) -> Column:
    """Whether a span passes the check of its kind."""
    if kind == EMAIL:
        return m.rlike(r"(?i)[.\])} ](?:dot[\])} ])? ?[a-z0-9-]+$")
    if kind == IP:
        return m.contains(":") | F.forall(F.filter(F.split(m, "[^0-9]+"), lambda p: p != ""), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == CARD:
        return F.call_function("luhn_check", digits) & F.length(digits).between(12, 19)
    return F.length(digits).between(9, 15)


def _beside(char: Column) -> Column:
    """0 for none or white space, 1 for a letter, 2 for a digit, 3 for a sign."""
    return F.when(char.rlike(r"^\s?$"), 0).when(char.rlike(r"^[0-9]"), 2).when(char.rlike(r"^\p{L}"), 1).otherwise(3)


def _features(kind: int, m: Column, before: Column, after: Column, digits: Column, valid: Column) -> Column:
    signs = F.regexp_replace(m, "[0-9A-Za-z]", "")
    near = F.length(_digits(before))
    of = {
        "kind": F.lit(kind),
        "valid": valid.cast("int"),
        "digits": F.least(F.length(digits), F.lit(20)),
        "lead": F.when(F.length(digits) > 0, F.substring(digits, 1, 1).cast("int")).otherwise(10),
        "groups": F.least(F.length(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "\u0001"), "[^\u0001]", "")), F.lit(8)),
        "marks": F.when(signs == "", 0).when(signs.rlike(r"^ +$"), 1).when(signs.rlike("^-+$"), 2).when(signs.rlike(r"^\.+$"), 3).otherwise(4),
        "left": _beside(F.substring(before, -1, 1)),
        "right": _beside(F.substring(after, 1, 1)),
        "cue": before.rlike(CUES[kind]).cast("int"),
        "near": F.when(near == 0, 0).when(near < 5, 1).when(near < 10, 2).otherwise(3),
    }
    return F.struct(*(of[f].cast("int").alias(f) for f in FEATURES))


def _spans(text: Column, gate: str, pattern: str, kind: int, group: int, label: Callable[[Column], Column] | None) -> Column:
    """All matches of a pattern in a text that starts with a line end, as spans. What stands between matches gives their
    places. label: of the check's outcome; None for base patterns, whose spans are base where the check passes and
    negatives where it fails."""

    def found(s: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def span(x: Column) -> Column:
                m, start = x["m"], x["start"]
                before = F.substring(x["gap"], -BEFORE, BEFORE)
                after = F.substring(x["rest"], 1, AFTER) if group == 0 else x["rest"].substr(F.length(m) + 1, F.lit(AFTER))

                def made(v: Column) -> Column:
                    own = (v["valid"], F.when(v["valid"], 1).otherwise(0)) if label is None else (F.lit(False), label(v["valid"]))
                    features = _features(kind, m, before, after, v["digits"], v["valid"])
                    return F.struct((start - 1).alias("start"), (start - 1 + F.length(m)).alias("end"), F.lit(kind).alias("kind"), own[0].alias("base"), own[1].cast("int").alias("label"), features.alias("f")).cast(_SPAN)

                one = _let(_digits(m), lambda d: _let(F.struct(d.alias("digits"), _valid(kind, m, d).alias("valid")), made))
                return F.struct((start + (F.length(m) if group == 0 else F.lit(0))).cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

            gap = F.element_at(s["gaps"], i)
            return _let(F.struct(gap.alias("gap"), F.element_at(s["gaps"], i + 1).alias("rest"), F.element_at(s["m"], i).alias("m"), (acc["at"] + F.length(gap)).alias("start")), span)

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("out"))
        return F.when(F.size(s["m"]) > 0, F.aggregate(F.sequence(F.lit(1), F.size(s["m"])), begin, step, lambda acc: acc["out"])).otherwise(F.array().cast(_EMPTY))

    has = text.contains(gate) if gate == "@" else text.rlike(gate)
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("m"))
    return F.when(has, _let(both, found)).otherwise(F.array().cast(_EMPTY))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held, base, more): base spans and all other candidates of each text, by place; held: whether the text belongs
    to the fold that calibrates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.concat(F.lit("\n"), text).alias("t"))
    t = F.col("t")
    base = F.concat(*(_spans(t, BASE_GATE[k], BASE[k], k, 0, None) for k in range(4)))
    more = F.concat(*(_spans(t, g.gate, g.pattern, g.kind, 1, lambda v, g=g: F.lit(g.label)) for g in GENERATORS))
    rows = rows.select("id", (F.pmod(F.xxhash64("t"), F.lit(FOLDS)) == HELD_OUT).alias("held"), base.alias("seen"), more.alias("more"))
    found = F.filter("seen", lambda s: s["base"])
    other = F.concat(F.filter("seen", lambda s: ~s["base"]), F.col("more"))
    return rows.select("id", "held", F.array_sort(found).alias("base"), F.array_sort(other).alias("more"))


@dataclass
class Model:
    """bias and trees; a tree is a leaf's value or (feature, at most, tree, tree). least: the score per kind from which a
    candidate is selected; over 1 where none is."""

    bias: float = 0.0
    trees: list = field(default_factory=list)
    least: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def margin(self, of: Callable[[str], Column]) -> Column:
        def value(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, most, low, high = tree
            return F.when(of(name) <= most, value(low)).otherwise(value(high))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + value(tree)
        return total

    def score(self, of: Callable[[str], Column]) -> Column:
        return 1 / (1 + F.exp(-self.margin(of)))

    def selects(self, f: Column) -> Column:
        bar = F.get(F.array(*map(F.lit, self.least)), f["kind"])
        return self.score(lambda name: f[name]) >= bar


def _best(cells: dict[str, dict[int, tuple[int, int]]]) -> tuple[float, str, int, tuple[int, int], tuple[int, int]] | None:
    """The split of most gain of one node: (gain, feature, at most, sums below, sums above); cells: sums of gradients and
    their weights by feature and value."""
    worth = lambda g, h: (g / UNITS) ** 2 / (h / UNITS + RIDGE)
    best = None
    for name in FEATURES:
        values = sorted(cells.get(name, {}).items())
        all_g, all_h = (sum(x[i] for _, x in values) for i in (0, 1))
        g = h = 0
        for v, (dg, dh) in values[:-1]:
            g, h = g + dg, h + dh
            if min(h, all_h - h) < UNITS // 4:
                continue
            gain = worth(g, h) + worth(all_g - g, all_h - h) - worth(all_g, all_h)
            if gain > 1e-3 and (best is None or gain > best[0]):
                best = gain, name, v, (g, h), (all_g - g, all_h - h)
    return best


def _grown(table: DataFrame, model: Model) -> list:
    """The next tree as nested lists [feature, at most, below, above]; table: features, pos, neg."""
    n, p = F.col("pos") + F.col("neg"), model.score(F.col)
    sums = table.select(*FEATURES, p.alias("p"), n.alias("n"), "pos").select(*FEATURES, F.round(UNITS * (F.col("n") * F.col("p") - F.col("pos"))).cast("long").alias("g"), F.round(UNITS * F.col("n") * F.col("p") * (1 - F.col("p"))).cast("long").alias("h"))
    root: list = [None]
    open_: dict[int, tuple[list, int]] = {0: (root, 0)}  # node -> where its tree goes
    place = F.lit(0)
    for level in range(DEPTH):
        cell = F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).alias("v")) for f in FEATURES))).alias("c")
        rows = sums.select(place.alias("node"), "g", "h", cell).filter(F.col("node").isin(*open_)).groupBy("node", "c.name", "c.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        cells: dict[int, dict] = defaultdict(lambda: defaultdict(dict))
        for r in rows:
            cells[r["node"]][r["name"]][r["v"]] = r["g"], r["h"]
        following, moved = {}, []
        for node, (parent, side) in open_.items():
            split = _best(cells[node])
            if split is None:
                if parent[side] is None:
                    parent[side] = 0.0
                continue
            _, name, most, below, above = split
            leaves = [-SHRINK * (g / UNITS) / (h / UNITS + RIDGE) for g, h in (below, above)]
            tree = [name, most, *leaves]
            parent[side] = tree
            low, high = 2 * node + 1, 2 * node + 2
            moved.append((node, name, most, low, high))
            following |= {low: (tree, 2), high: (tree, 3)}
        if not following:
            break
        then = F.lit(-1)
        for node, name, most, low, high in moved:
            then = F.when(place == node, F.when(F.col(name) <= most, low).otherwise(high)).otherwise(then)
        place, open_ = then, following
    return root[0]


def fitted(found: DataFrame) -> Model:
    """A model from candidates(); with one class only, or none, it scores the share of positives and, as nothing tells
    right from wrong, selects what scores as high as they do."""
    one = found.select("held", F.explode(F.concat("base", "more")).alias("s")).filter("s.label IS NOT NULL")
    table = one.groupBy("held", *(F.col(f"s.f.{f}").alias(f) for f in FEATURES)).agg(F.sum(F.col("s.label").cast("long")).alias("pos"), F.sum(1 - F.col("s.label").cast("long")).alias("neg"))
    table = cut(table)
    model = Model()
    fit = table.filter("NOT held")
    pos, neg = (int(x or 0) for x in fit.agg(F.sum("pos"), F.sum("neg")).first())
    model.bias = math.log((pos + 1) / (neg + 1))
    if pos and neg:
        for _ in range(TREES):
            tree = _grown(fit, model)
            if isinstance(tree, float):
                break
            model.trees.append(tree)
    # the lowest score at which the calibration fold is right often enough, by kind; bins of a thousandth
    scored = table.withColumn("bin", F.floor(1000 * model.score(F.col)).cast("int")).groupBy("kind", "held", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    for kind in range(len(KINDS)):
        own = [r for r in scored if r["kind"] == kind]
        held = [r for r in own if r["held"]]
        right = wrong = 0
        for r in sorted(held if any(r["pos"] for r in held) else own, key=lambda r: (-r["bin"], r["neg"])):
            right, wrong = right + r["pos"], wrong + r["neg"]
            if r["pos"] and right >= PRECISION * (right + wrong):
                model.least[kind] = r["bin"] / 1000
    return model


def _chosen(model: Model) -> Column:
    """Of the candidates in `more`: those that the model selects, less those that overlap a base span, and of several
    that overlap each other the longest, then the first. One pass over all spans by place."""
    picked = F.filter("more", lambda s: model.selects(s["f"]))

    def step(acc: Column, s: Column) -> Column:
        apart = acc["cur"].isNull() | (acc["cur"]["end"] <= s["start"])
        settled = F.when(acc["cur"].isNotNull() & apart, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        taken = F.when(s["start"] < acc["until"], F.when(apart, F.lit(None)).otherwise(acc["cur"]))
        longer = (s["end"] - s["start"]) > (acc["cur"]["end"] - acc["cur"]["start"])
        cur = F.when(s["base"], F.lit(None)).when(s["start"] < acc["until"], taken).when(apart | longer, s).otherwise(acc["cur"])
        until = F.when(s["base"], F.greatest(acc["until"], s["end"])).otherwise(acc["until"])
        return F.struct(until.alias("until"), cur.cast(_SPAN).alias("cur"), settled.alias("out"))

    begin = F.struct(F.lit(0).alias("until"), F.lit(None).cast(_SPAN).alias("cur"), F.array().cast(_EMPTY).alias("out"))
    done = lambda acc: F.when(acc["cur"].isNotNull(), F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
    return _let(picked, lambda p: F.when(F.size(p) > 0, F.aggregate(F.array_sort(F.concat("base", p)), begin, step, done)).otherwise(F.array().cast(_EMPTY)))


def _said(spans: Column) -> Column:
    """kind:start:end of each span, by start, kind and end."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base spans as text),
    base (array of spans), added (those that the model adds), spans (all as text: kind:start:end, code points, end exclusive).

    A null or empty text has no spans. Repeated rows come back alike, null ids stay null, whatever further columns there
    are; an empty table gives no rows. Without any labelled candidate nothing is added."""
    found = cut(candidates(docs, id_col, text_col))
    model = fitted(found)
    rows = found.select("id", "base", _chosen(model).alias("added"))
    n = [_count(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select(F.col("id").alias(id_col), *n, F.sha2(_said(F.col("base")), 256).alias("base_sha256"), "base", "added", _said(F.concat("base", "added")).alias("spans"))
