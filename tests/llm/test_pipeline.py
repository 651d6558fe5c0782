"""The pipeline's stages in order, and what they keep."""

import collections

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from rasterflow.llm import quality, simhash, toxicity

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
ODD = [(None, None), (None, ""), (10**6, ""), (10**6 + 1, "one two"), (10**6 + 2, "One two"), (10**6 + 5, "x y z"), (10**6 + 5, "x y z"), (3, "another text of an id that is there"), (10**6 + 6, " \n\t \n"), (10**6 + 7, LONG), (10**6 + 8, LONG + " end")]


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Documents and odd rows, with extra columns named like what the stages make for themselves."""
    extra = [F.lit("x").alias(c) for c in ("toxicity", "removed", "kept", "row", "score")]
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cp.COLUMNS, *extra)
    more = spark.createDataFrame([(d, t, "en", None, None) for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    out = base.union(more.select("*", *extra)).repartition(3).cache()
    out.count()
    return out


def rows(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_each_stage_on_odd_rows(spark, sf_dir, odd):
    """What a stage keeps is what its operator says of each row, and the columns pass through as they are."""
    stages = dict(cp.STAGES)
    kept = {name: stages[name](spark, odd, sf_dir).cache() for name in ("toxicity", "quality", "near_duplicates", "line_dedup")}
    assert all(df.columns == odd.columns and df.filter("kept <> 'x' OR removed <> 'x' OR toxicity <> 'x'").count() == 0 for df in kept.values())
    model = toxicity.trained(odd, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert rows(kept["toxicity"]) == rows(toxicity.score(odd, model, score_col="s").filter("s < 0.3"))
    assert kept["toxicity"].filter(f"doc_id IS NULL OR doc_id = {10**6}").count() == 3
    judged = quality.measured(odd, quality.cut(quality.references(odd)))
    assert rows(kept["quality"]) == rows(judged.filter("kept").select("row.doc_id", "row.text"))
    assert kept["quality"].filter("text IS NULL OR length(trim(text)) = 0 OR text = 'one two'").count() == 0
    best = {bytes(r.mark) for r in simhash.near_duplicates(odd).collect() if r.kept}
    left = kept["near_duplicates"].collect()
    assert sorted(map(bytes, best)) == sorted(simhash._mark(simhash.words_of(r.text)) for r in left) and len({r.doc_id for r in left if (r.doc_id or 0) >= 10**6}) == len([r for r in left if (r.doc_id or 0) >= 10**6])
    own = {r.doc_id for r in left}
    assert {10**6, 10**6 + 1, 10**6 + 5, 10**6 + 7} <= own and not {None, 10**6 + 2, 10**6 + 6, 10**6 + 8} & own
    assert kept["line_dedup"].count() == odd.count() and kept["line_dedup"].filter("n_chars <> length(text)").count() == 0
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    need = sum(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert stages["packing"](spark, odd, sf_dir).agg(F.sum("length")).first()[0] == need


def test_stages_on_nothing(spark, sf_dir, odd):
    none = odd.filter("false")
    for name, stage in cp.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "line_dedup", "packing"]
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == cp.COLUMNS, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] > 0.4 * counts[0]
    assert docs.filter("n_chars <> length(text)").count() == 0
    pieces = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == counts[-1]


def test_run(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() > 0
