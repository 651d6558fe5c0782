"""Quality rules by distribution divergence.

A document's histograms, one of character classes and one of its language's most common words, are compared with
those of its language by the Jensen-Shannon distance (base 2, so 0 to 1). Both references come from the whole
corpus: every word of every document is counted by language, the commonest words are read off those counts, and
so are the character classes, since a class count of the corpus is the sum over its words. Short documents have
no reliable histogram, so they pass; a language with too little text is compared with the pooled reference.

Everything is a DataFrame expression: one aggregation of (language, word) and one pass over the documents. The
references of the LANGUAGES largest languages are broadcast; were there more, the documents of the others would be
joined to theirs by a shuffle, as none of those has more than 1/LANGUAGES of the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WHITE, BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"
#: Character classes, each counted on what the ones before it leave; the last one is whatever is left.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"\p{L}+", r"[.,;:!?'\"()\-]+")
#: Stands for a common word by its rank, 1 and up; the first character is for all other words.
MARKS = "-ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Common words of a language, languages whose references are broadcast, and words that a reference needs.
COMMON, LANGUAGES, REFERENCE_WORDS = 20, 200, 2000
#: Words below which no verdict is given, and the distances above which a document is rejected.
MIN_WORDS, CLASS_DISTANCE, WORD_DISTANCE = 60, 0.30, 0.40


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def class_counts(df: DataFrame, column: str, to: str, rest: str | None = None) -> DataFrame:
    """df with an array `to` of the counts by CLASSES, and of the rest, in a column without white space; and the rest
    itself, if it is given a name. Each class is taken out of what the ones before it left, column by column, so that
    every pattern runs once per row."""
    left = [column, *(f"{to}{i}" for i in range(len(CLASSES)))]
    for pattern, before, after in zip(CLASSES, left, left[1:]):
        df = df.withColumn(after, F.regexp_replace(before, pattern, ""))
    sizes = [F.length(c).cast("double") for c in left]
    df = df.withColumn(to, F.array(*(a - b for a, b in zip(sizes, sizes[1:])), sizes[-1]))
    return (df.withColumn(rest, F.col(left[-1])) if rest else df).drop(*left[1:])


def shares(df: DataFrame, column: str) -> DataFrame:
    """df with an array of counts turned into shares of their sum, zeros where that is 0."""
    df = df.withColumn("__total", F.aggregate(column, F.lit(0.0), lambda a, x: a + x))
    return df.withColumn(column, F.transform(column, lambda x: F.when(F.col("__total") > 0, x / F.col("__total")).otherwise(F.lit(0.0)))).drop("__total")


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two arrays of shares."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m) / 2).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))))


def references(docs: DataFrame, common: int = COMMON, least: int = REFERENCE_WORDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(ref_lang, ref_total, ref_classes, ref_words, ref_list, ref_shares), a row per language, ref_total being its words. The row
    whose ref_lang is null is the pooled reference: languages with fewer words than `least` use it, as do null ones.
    common is at most 52."""
    each = docs.select(F.col(lang_col).cast("string").alias("lang"), F.explode(words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("word"))
    counts = each.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # a class count of the corpus is the sum over its distinct words; lower case comes after, as classes need the case
    counts = class_counts(counts, "word", "c").withColumn("word", F.lower("word"))
    sums = [F.sum(F.col("c")[i] * F.col("n")).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    counts = cut(counts.groupBy("lang", "word").agg(F.sum("n").alias("n"), *sums))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(CLASSES) + 1)))
    own = totals.filter((F.col("total") >= least) & F.col("lang").isNotNull())
    pooled = totals.agg(F.sum("total").alias("total"), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(CLASSES) + 1))).filter("total > 0")
    by_lang = counts.filter("lang IS NOT NULL").select("lang", "word", "n")
    everywhere = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(common)
    top = by_lang.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY n DESC, word)")).filter(F.col("rank") <= common)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word")))
    top = top.groupBy("lang").agg(listed.alias("top"))
    whole = everywhere.agg(listed.alias("top")).withColumn("lang", F.lit("all"))
    pooled = pooled.withColumn("lang", F.lit("all")).join(whole, "lang")
    both = own.join(top, "lang").select("lang", "total", *_class_names(), "top").union(pooled.select(F.lit(None).cast("string"), "total", *_class_names(), "top"))
    both = shares(both.withColumn("classes", F.array(*_class_names())), "classes").withColumn("shown", F.transform("top", lambda t: -t["n"] / F.col("total")))
    rest = F.lit(1.0) - F.aggregate("shown", F.lit(0.0), lambda a, x: a + x)
    return both.select(F.col("lang").alias("ref_lang"), F.col("total").alias("ref_total"), F.col("classes").alias("ref_classes"), F.col("top.word").alias("ref_words"), F.array_join(F.transform("top", lambda t: _listed(t["word"])), ",").alias("ref_list"), F.concat("shown", F.array(rest)).alias("ref_shares"))


def _listed(word: Column) -> Column:
    """A word as it stands in a list of words parted by commas: white space, which no word has, for its own commas."""
    return F.replace(word, F.lit(","), F.lit("\t"))


def _class_names() -> list[str]:
    return [f"c{i}" for i in range(len(CLASSES) + 1)]


def with_references(df: DataFrame, refs: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    """df (with lang) and the reference of its language, or the pooled one where there is none."""
    refs = refs.withColumnRenamed("ref_lang", "lang")
    top = refs.filter("lang IS NOT NULL").orderBy(F.desc("ref_total"), "lang").limit(languages)
    large = F.broadcast(top.union(refs.filter("lang IS NULL")).drop("ref_total").withColumnRenamed("lang", "ref_lang"))
    known = F.broadcast(top.select("lang", F.lit(True).alias("has")))

    def pooled(rows: DataFrame) -> DataFrame:
        rows = rows.join(known, "lang", "left").withColumn("of", F.when(F.col("has"), F.col("lang"))).drop("has", "lang")
        return rows.join(large, F.col("of").eqNullSafe(F.col("ref_lang")), "left").drop("of", "ref_lang")

    if refs.count() <= languages + 1:
        return pooled(df)
    small = refs.filter("lang IS NOT NULL").drop("ref_total").join(known, "lang", "left_anti")
    own = df.join(known, "lang", "left_anti").join(small, "lang").drop("lang")
    return pooled(df.join(small.select("lang"), "lang", "left_anti")).unionByName(own)


def measured(docs: DataFrame, refs: DataFrame, min_words: int = MIN_WORDS, class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE, languages: int = LANGUAGES, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(row struct of all input columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed, kept), one per input row.

    A null text has no words, so it fails the base rules. The distances are null where the document is shorter than
    min_words or the corpus has no reference. Repeated rows, ties and null ids change nothing. Columns of any name come
    back in `row`; an empty table gives no rows."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df = with_references(df, refs, languages)
    df = df.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("n_words", F.size("w").cast("long")).withColumn("lines", lines)
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines", "text")
    df = class_counts(df.withColumn("solid", F.array_join("w", "")), "solid", "p", rest="odd")
    # none of the symbols is in a class, so all of them are in what the classes leave
    df = df.withColumn("n_symbols", (F.length("odd") - F.length(F.translate("odd", "#*$%&|<>", ""))).cast("long")).withColumn("word_chars", F.length("solid").cast("long"))
    judged = F.col("n_words") >= min_words
    df = shares(df.drop("solid", "odd"), "p").withColumn("p", F.when(judged, F.col("p")))
    # a word's rank among the common ones as a character
    rank = lambda x: F.find_in_set(_listed(F.lower(x)), F.col("ref_list")) + 1
    df = df.withColumn("at", F.when(judged, F.array_join(F.transform("w", lambda x: F.substring(F.lit(MARKS), rank(x), F.lit(1))), "")))
    times = lambda k: F.length("at") - F.length(F.replace("at", F.substring(F.lit(MARKS), k + 2, F.lit(1)), F.lit("")))
    seen = F.transform("ref_words", lambda x, k: times(k) / F.col("n_words"))
    df = df.withColumn("q", F.when(judged & F.col("ref_words").isNotNull(), F.concat(seen, F.array(1 - (F.col("n_words") - times(F.lit(-1))) / F.col("n_words"))))).drop("at")
    df = df.withColumn("hashes", F.when(F.col("n_words") > 5, F.transform("w", lambda x: F.xxhash64(x))))
    df = df.withColumn("grams", F.expr("if(n_words > 5, transform(sequence(0, size(w) - 5), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2], hashes[i + 3], hashes[i + 4])), array())")).drop("hashes")
    # windows with hashes of their own differ; where hashes repeat they stand side by side once sorted, and then the
    # windows themselves decide. Each adds the words that the window before it left
    df = df.withColumn("sorted", F.expr("if(size(array_distinct(grams)) = size(grams), array(), array_sort(transform(grams, (h, i) -> struct(h, i))))")).drop("grams")
    df = df.withColumn("alike", F.expr("filter(sorted, (x, k) -> coalesce(get(sorted, k - 1).h = x.h, false) OR coalesce(get(sorted, k + 1).h = x.h, false))")).drop("sorted")
    df = df.withColumn("spelt", F.expr("array_sort(transform(alike, x -> struct(x.h AS h, array_join(slice(w, x.i + 1, 5), ' ') AS g, x.i AS i)))")).drop("alike", "w")
    df = df.withColumn("again", F.expr("array_sort(transform(filter(spelt, (x, k) -> coalesce(get(spelt, k - 1).g = x.g, false) OR coalesce(get(spelt, k + 1).g = x.g, false)), x -> x.i))")).drop("spelt")
    df = df.withColumn("n_repeat_words", F.expr("aggregate(again, struct(-5L AS last, 0L AS total), (s, i) -> struct(CAST(i AS long) AS last, s.total + least(5L, i - s.last) AS total), s -> s.total)")).drop("again")
    df = df.withColumn("class_distance", js_distance(F.col("p"), F.col("ref_classes"))).withColumn("word_distance", js_distance(F.col("q"), F.col("ref_shares")))
    df = df.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    far = F.coalesce((F.col("class_distance") > class_distance) | (F.col("word_distance") > word_distance), F.lit(False))
    found = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]
    # generated, so that a filter on the verdict is applied to it, and not to all the steps that lead to it, written out anew
    return df.withColumn("kept", ~F.col("base_failed") & ~far).select("row", F.inline(F.array(F.struct(*found))))


def quality(docs: DataFrame, id_col: str = "doc_id", **limits) -> DataFrame:
    """The measures and verdict of every document, by its id; the references are those of docs itself."""
    found = measured(docs, cut(references(docs)), **limits)
    return found.select(F.col("row")[id_col].alias(id_col), *found.columns[1:])
