"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

A text's features are the distinct character n-grams of its lower-cased form, hashed into a fixed number of
buckets. Each bucket's log-count ratio r = log((toxic + a) / |toxic|) - log((clean + a) / |clean|) is counted over
every labelled row by Spark; a logistic regression is then fitted on r-scaled features, so that w * r is a
bucket's weight. The fit runs over a bounded sample (FIT_ROWS) of the labelled rows and over the buckets that say
most; scoring reads every whole text, in bounded pieces, and adds up the weights of the buckets it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, cut

#: n of the n-grams, buckets, labelled rows that are fitted, buckets with a weight.
GRAMS, BUCKETS, FIT_ROWS, FEATURES = (4, 5, 6, 7), 1 << 20, 8000, 40_000
#: Features of all fitted rows together: what one task holds of them is 16 bytes each.
FIT_CELLS = 40_000_000
SMOOTH, DECAY, ROUNDS = 1.0, 0.02, 300
#: Labels (an id and a number each) that are broadcast at most; beyond, documents meet them by a shuffle.
BROADCAST_ROWS = 1_000_000
_PIECE = 1 << 18
#: Rows of an Arrow batch that a task hands back.
_ROWS = 16_384
_SAMPLE = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("f", pa.binary())])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    steep: float


def buckets(text: str | None, size: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hashed n-grams of a whole text, repeats included, in pieces."""
    text = f" {(text or '').lower()} " if text else ""
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[at : at + _PIECE + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        more = at + _PIECE < len(text)
        for n in GRAMS:
            m = min(len(c) - n + 1, _PIECE if more else len(c))
            if m > 0:
                h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for i in range(n):
                    h = (h ^ c[i : i + m]) * np.uint32(0x01000193)
                    h ^= h >> np.uint32(15)
                yield (h * np.uint32(0x85EBCA6B) >> np.uint32(7)) & np.uint32(size - 1)


class Distinct:
    """The distinct buckets of one text after another, without sorting: a bucket keeps its last position only."""

    def __init__(self, size: int = BUCKETS):
        self.last = np.zeros(size, np.int64)
        self.clock = 1

    def of(self, text: str | None) -> np.ndarray:
        begun, found = self.clock, []
        for h in buckets(text, len(self.last)):
            fresh = h[self.last[h] < begun]
            place = np.arange(self.clock, self.clock + len(fresh))
            self.last[fresh] = place
            found.append(fresh[self.last[fresh] == place])
            self.clock += len(fresh)
        self.clock += 1
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


def train(labelled: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, features: int = FEATURES, fit_cells: int = FIT_CELLS) -> Model:
    """labelled: id, text and a 0/1 label; rows with a null label are left out. Log-count ratios are counted over
    all of them; at most fit_rows, those with the lowest hash of their id, fit the weights, as long as they have fit_cells
    features together. With one class only,
    or none, the model scores the share of label 1 for every text."""
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, n = Distinct(), np.zeros((2, BUCKETS), np.int32)  # a partition has fewer than 2^31 rows
        for b in batches:
            for text, y in zip(column_of([b], "text"), b.column("y").to_pylist()):
                n[y, met.of(text)] += 1
        at = np.flatnonzero(n.any(0)).astype(np.int32)
        for i in range(0, len(at), _ROWS):
            part = at[i : i + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[0, part]), pa.array(n[1, part])], ["bucket", "clean", "toxic"])

    found = rows.select("text", "y").mapInArrow(count, "bucket int, clean int, toxic int")
    size = dict(rows.groupBy("y").count().collect())
    base = size.get(1, 0) / max(1, sum(size.values()))
    if min(size.get(0, 0), size.get(1, 0)) == 0:
        return Model(np.zeros(BUCKETS, np.float32), float(np.clip(np.log((base + 1e-6) / (1 - base + 1e-6)), -9, 9)), 1.0)
    n = found.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = lambda c, y: F.log((F.col(c) + SMOOTH) / (size[y] + 2 * SMOOTH))
    n = n.withColumn("ratio", share("toxic", 1) - share("clean", 0))
    said = F.abs("ratio") * F.sqrt(F.least(F.col("clean") + F.col("toxic"), F.lit(50)))
    # at most `features` rows, whatever the input
    pick = n.select("bucket", "ratio", said.alias("said")).orderBy(F.desc("said"), "bucket").limit(features).select("bucket", "ratio").toArrow().sort_by("bucket")
    where, scale = pick["bucket"].to_numpy(), pick["ratio"].to_numpy()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Distinct()
        slot = np.full(BUCKETS, -1, np.int32)
        slot[where] = np.arange(len(where))
        for b in batches:
            sets = (slot[met.of(t)] for t in column_of([b], "text"))
            f = pa.array([np.sort(s[s >= 0]).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), f], ["id", "y", "f"])

    part = rows
    if sum(size.values()) > fit_rows:  # ids alone tell which rows are fitted, so that no other text moves
        last = rows.select(F.xxhash64("id").alias("h")).orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
        part = rows.filter(F.xxhash64("id") <= last)
    order = [F.xxhash64("id").alias("h"), "id", "y"]
    found = cut(part.mapInArrow(chosen, "id long, y int, f binary").orderBy(*order).limit(fit_rows))
    # first the rows' sizes alone, then as many rows as there is room for
    sizes = found.select(*order, (F.octet_length("f") / 4).cast("long").alias("cells")).toArrow().to_pandas().sort_values(["h", "id", "y"], kind="stable")
    fits = sizes[sizes["cells"].cumsum() <= fit_cells]
    if len(fits) < len(sizes):
        found = found.filter(F.xxhash64("id") <= (int(fits["h"].iloc[-1]) if len(fits) else -(1 << 63))).limit(len(fits))
    rounds = ROUNDS

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(batches, _SAMPLE).to_pandas().sort_values(["id", "y"], kind="stable")
        w, bias = _fit(sample, scale, rounds)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["w", "bias"])

    # one task holds the fitted rows, which are bounded; only the weights come to the driver
    done = found.select("id", "y", "f").coalesce(1).mapInArrow(fit, "w binary, bias double").first()
    w, bias = (np.frombuffer(done.w), done.bias) if done else _fit(_SAMPLE.empty_table().to_pandas(), scale, rounds)
    weights = np.zeros(BUCKETS, np.float32)
    weights[where] = w
    return Model(weights, float(bias), 1.0)


def _fit(sample: pd.DataFrame, scale: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of the features, and the bias: logistic regression on r-scaled presence, by gradient steps with momentum over
    all rows; both classes weigh the same."""
    sets = [np.frombuffer(f, np.int32) for f in sample["f"]]
    y = sample["y"].to_numpy(float)
    col = np.concatenate(sets) if sets else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    val = scale[col].astype(np.float32)
    w, speed, bias, bias_speed = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0
    weigh = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    norm = np.bincount(row, val * val, len(sets))
    rate = 4.0 / (1 + norm.mean())
    for _ in range(rounds):
        z = np.bincount(row, val * w[col], len(sets)) + bias
        g = weigh * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        speed = 0.9 * speed - rate * (np.bincount(col, val * g[row], len(scale)) + DECAY / len(scale) * w)
        bias_speed = 0.9 * bias_speed - 0.1 * g.sum()
        w, bias = w + speed, bias + bias_speed
    return w * scale, bias


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column: the score of each whole text, 0 to 1; a null or empty one has the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, a fixed size

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, met = sent.value, Distinct()
        for t in texts:
            z = np.array([m.bias + m.weights[met.of(x)].sum(dtype=np.float64) for x in t], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labels (id_col, label_col) of docs that are not held out. A document with several labels counts
    with each, and so does every row that repeats an id; labels without a document, or null ones, count nothing."""
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).alias("label")).filter(~held_out("label_id"))
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return train(own.join(known, own["id"] == known["label_id"]).select("id", "body", "label"), "label", "id", "body")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, score, predicted (1 if score >= threshold) for every row of docs. A null or empty text has the model's
    bias for a score; repeated rows come back alike, null ids stay null and are learned from nowhere; further columns are left
    out, whatever their names; an empty table gives no rows."""
    scored = score(docs.select(id_col, F.col("text")), trained(docs, labels))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
